"""Seeded, partition-independent randomness and exact-k selection.

Every random choice is a function of ``md5(seed | salt | row_id)``: the same rows
are chosen whatever the partitioning, the executor count or the task retries.
Exact-k ("the k rows with the smallest keys") never sorts the table: a histogram
of key prefixes (<= 4096 buckets per group) is refined until the bucket holding
the k-th key is small, and only that bucket is ranked.  The selection itself is
then a narrow filter ``key <= threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEX_STEP = 3  # prefix digits added per refinement level (16**3 = 4096 buckets)
RANK_LIMIT = 200_000  # a bucket at most this large is ranked directly


def hash_key(seed, salt: str, row_id: Column | str) -> Column:
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), rid.cast("string")))


def hash_index(key: Column | str, n: int, start: int = 25) -> Column:
    """Uniform integer in [0, n) from 8 hex digits of the key (independent of the
    leading digits used for ordering)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(k, start, 8), 16, 10).cast("bigint"), F.lit(n))


def hash_unit(key: Column | str, start: int = 17) -> Column:
    """Uniform double in [0, 1) from 8 hex digits of the key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(k, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# ---- SQL twins (DuckDB / ANSI) -------------------------------------------------

def sql_hash_key(seed, salt: str, row_id_expr: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{salt}', CAST({row_id_expr} AS VARCHAR)))"


def sql_hash_index(key_expr: str, n: int, start: int = 25) -> str:
    return f"((('0x' || substr({key_expr}, {start}, 8))::BIGINT) % {n})"


def sql_hash_unit(key_expr: str, start: int = 17) -> str:
    return f"((('0x' || substr({key_expr}, {start}, 8))::BIGINT)::DOUBLE / 4294967296.0)"


# ---- exact-k -----------------------------------------------------------------

def _cut(hist: list[tuple[str, int]], need: int):
    """Bucket holding the need-th smallest key: (prefix, rank inside it, size)."""
    before = 0
    for prefix, cnt in sorted(hist):
        if before + cnt >= need:
            return prefix, need - before, cnt
        before += cnt
    raise ValueError(f"asked for {need} rows, only {before} available")


def kth_keys(df: DataFrame, key: str, need: dict, group: str | None = None,
             level1: dict | None = None, rank_limit: int = RANK_LIMIT) -> dict:
    """For each group g with need[g] = k > 0, the k-th smallest ``key`` value.

    ``df`` holds only the candidate rows.  ``level1`` may carry a precomputed
    first-level histogram {g: [(prefix3, count), ...]}.  Returns {g: key}.
    Jobs: one histogram per refinement level (usually 1-2) + one small rank job.
    """
    gcol = F.col(group) if group else F.lit("__all__")
    state = {g: ("", k) for g, k in need.items() if k > 0}
    out = {}
    width = 0
    hist = level1
    while state:
        width += HEX_STEP
        if hist is None:
            cond = None
            for g, (prefix, _) in state.items():
                c = (gcol == F.lit(g)) if group else F.lit(True)
                if prefix:
                    c = c & (F.substring(F.col(key), 1, len(prefix)) == F.lit(prefix))
                cond = c if cond is None else (cond | c)
            rows = (df.where(cond)
                    .groupBy(gcol.alias("g"), F.substring(F.col(key), 1, width).alias("p"))
                    .count().collect())
            hist = {}
            for r in rows:
                hist.setdefault(r["g"], []).append((r["p"], r["count"]))
        final = {}
        nxt = {}
        for g, (_, k) in state.items():
            prefix, rank, size = _cut(hist.get(g, []), k)
            if size <= rank_limit or width >= 30:
                final[g] = (prefix, rank)
            else:
                nxt[g] = (prefix, rank)
        if final:
            cond = None
            for g, (prefix, _) in final.items():
                c = F.substring(F.col(key), 1, len(prefix)) == F.lit(prefix)
                if group:
                    c = (gcol == F.lit(g)) & c
                cond = c if cond is None else (cond | c)
            ranks = F.create_map(*[x for g, (_, r) in final.items() for x in (F.lit(g), F.lit(r))])
            w = Window.partitionBy("g").orderBy(key)
            rows = (df.where(cond).select(gcol.alias("g"), F.col(key))
                    .withColumn("rn", F.row_number().over(w))
                    .where(F.col("rn") == ranks[F.col("g")])
                    .select("g", key).collect())
            for r in rows:
                out[r["g"]] = r[key]
        state = nxt
        hist = None
    return out


def first_k(df: DataFrame, key: str, k: int) -> Column:
    """Predicate selecting the k rows of ``df`` with the smallest ``key``."""
    if k <= 0:
        return F.lit(False)
    thr = kth_keys(df, key, {"__all__": k})["__all__"]
    return F.col(key) <= F.lit(thr)
