"""Training-data operators: classification, deduplication, search, packing, archives."""
