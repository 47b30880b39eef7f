"""Registered queries of this subpackage: one per operator, plus the pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "line_dedup", "partition_ann", "quotes", "shard_tree", "packing", "zipwarc", "pivots", "ngram_join", "mixing",
           "mask_search", "merkle", "swap_packing")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def _pipeline():
    return import_module("corpus_pipeline")


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out | {"pipeline": _pipeline().run}


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    sql = _pipeline().ORACLE_SQL
    return out | ({"pipeline": sql} if sql else {})
