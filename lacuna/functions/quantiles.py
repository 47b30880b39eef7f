"""Exact order statistics of numeric columns at any size.

Each wanted rank is narrowed by histograms: the interval that holds it is cut into equal
buckets, one job counts the rows per bucket (with the smallest and largest value in each),
and the bucket with the rank becomes the next interval, until it holds a single value.
Only counts reach the driver; no task sorts a column; all columns share each job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _bucket(x, lo: float, hi: float, buckets: int):
    width = hi - lo
    share = (x - lo) / width if math.isfinite(width) else (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], ends: dict, buckets: int = BUCKETS) -> dict:
    """{(column, rank)}: the value at that 0-based rank among the non-null values.
    ``ends``: {column: (smallest, largest)}."""
    state = {(c, r): (*ends[c], r) for c, rs in ranks.items() for r in rs}
    while True:
        open_ = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in state.items() if lo < hi})
        if not open_:
            return {k: lo for k, (lo, _, _) in state.items()}
        hits = [F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), _bucket(F.col(c).cast("double"), lo, hi, buckets).alias("b"),
                                                          F.col(c).cast("double").alias("x")))
                for i, (c, lo, hi) in enumerate(open_)]
        rows = (df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.i", "h.b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("h.x").alias("lo"), F.max("h.x").alias("hi")).collect())
        found = {}
        for row in sorted(rows, key=lambda r: (r["i"], r["b"])):
            found.setdefault(open_[row["i"]], []).append(row)
        for key, (lo, hi, rank) in state.items():
            if lo < hi:
                for row in found[(key[0], lo, hi)]:
                    if rank < row["n"]:
                        state[key] = (row["lo"], row["hi"], rank)
                        break
                    rank -= row["n"]


def quantiles(df: DataFrame, shares: dict[str, float], buckets: int = BUCKETS) -> dict:
    """{column: value} with linear interpolation between order statistics; columns without
    a value are left out."""
    if not shares:
        return {}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(shares)
                   for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ends = {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(shares) if row[f"n_{i}"]}
    at = {c: (row[f"n_{i}"] - 1) * shares[c] for i, c in enumerate(shares) if c in ends}
    values = order_statistics(df, {c: sorted({math.floor(p), math.ceil(p)}) for c, p in at.items()}, ends, buckets)
    out = {}
    for c, p in at.items():
        low, high = values[c, math.floor(p)], values[c, math.ceil(p)]
        out[c] = low if low == high else low + (high - low) * (p - math.floor(p))
    return out
