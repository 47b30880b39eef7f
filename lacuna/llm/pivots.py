"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(256 x) per component.  A table holds every vector's
distances to ``PIVOTS`` pivots.  For a query q, a row x and any pivot p the triangle
inequality gives |x - q| >= |d(x, p) - d(q, p)|; the largest of these bounds over all
pivots bounds the distance from below and so the inner product
(|x|^2 + |q|^2 - |x - q|^2) / 2 from above.  In each block a query evaluates its candidates
in the order of that bound and stops when the k-th best score found beats every bound that
is left; a first threshold comes from exact scores on the pivot sample.  The result is
exact: a bound only ever saves evaluations.

Pivots are picked on a sample of at most ``SAMPLE`` rows by farthest-first traversal; they
decide the speed alone.  Vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; of rows that repeat an id, the smallest vector counts;
only vectors of equal length are compared; fewer than k candidates give them all; an empty
table gives an empty result.  Vectors so long that double precision would not hold their
products are scored in integers, by themselves and as queries against all rows of their
block; a score that passes 64 bits raises an error.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, finite, meet, one_per_id
from .common import Scratch, draw, table

K = 5
EVERY = 50
PIVOTS = 32
SAMPLE = 2_048
SEED = 8
STEP = 256  # candidates evaluated between two looks at the bound


def quantised(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint"))


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``sample`` that are far from each other, the first the longest; ties to the
    first of them."""
    chosen = [int(np.argmax((sample * sample).sum(axis=1)))]
    far = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(np.argmax(far)))
    return sample[chosen]


def _long(v: np.ndarray) -> np.ndarray:
    """Rows whose products with others like them may not be exact in double precision."""
    if not v.size:
        return np.zeros(len(v), bool)
    return np.abs(v.astype(np.float64)).max(axis=1) ** 2 * v.shape[1] >= 2.0 ** 52


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as 64-bit integers."""
    largest = [max((abs(int(x)) for x in (v.max(initial=0), v.min(initial=0))), default=0) for v in (rows, query)]
    if largest[0] * largest[1] * len(query) < 1 << 63:
        return rows @ query
    scores = rows.astype(object) @ query.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
        raise OverflowError("no exact integer scores: an inner product passes 64 bits")
    return scores.astype(np.int64)


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, v, dim, square (|v|^2), far (distances to the pivots of that dimension), long."""

    def measure(batches):
        import pandas as pd
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                v = np.stack(part["v"]).astype(np.float64) if dim else np.zeros((len(part), 0))
                square = (v * v).sum(axis=1)
                p = pivots.get(dim, np.zeros((0, dim)))
                d2 = square[:, None] - 2 * v @ p.T + (p * p).sum(axis=1)
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "dim": int(dim), "square": square,
                                    "far": list(np.sqrt(np.maximum(d2, 0))), "long": _long(v)})

    return rows.mapInPandas(measure, "vec_id long, v array<long>, dim int, square double, far array<double>, long boolean")


def search_block(q_id, q, q_sq, q_far, r_id, r, r_sq, r_far, floor, k: int, q_long=None, r_long=None):
    """(query_id, vec_id, score) of the k best of this block per query, and the number of
    candidates evaluated.  ``q`` and ``r`` are integers; long rows have no bound."""
    out, evaluated = [], 0
    q_long = np.zeros(len(q), bool) if q_long is None else q_long
    r_long = np.zeros(len(r), bool) if r_long is None else r_long
    r_double = r.astype(np.float64)
    for a in range(0, len(q), 64):
        low = np.zeros((len(q[a:a + 64]), len(r)))
        for p in range(r_far.shape[1]):
            np.maximum(low, np.abs(q_far[a:a + 64, p, None] - r_far[None, :, p]), out=low)
        # rounding can only loosen the bound
        top = (r_sq[None] + q_sq[a:a + 64, None] - low * low) / 2 + 1e-6 * (r_sq[None] + q_sq[a:a + 64, None]) + 1e-6
        for i in range(len(low)):
            mine, bound = a + i, top[i].copy()
            bound[r_long | q_long[mine]] = np.inf
            left = np.flatnonzero((bound >= floor[mine]) & (r_id != q_id[mine]))  # ties with the threshold stay
            left = left[np.argsort(-bound[left], kind="stable")]
            ids, scores, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), floor[mine]
            for s in range(0, len(left), STEP):
                part = left[s:s + STEP]
                if bound[part[0]] < kth:
                    break
                evaluated += len(part)
                if q_long[mine] or r_long[part].any():
                    found = exact_products(r[part], q[mine])
                else:
                    found = (r_double[part] @ q[mine].astype(np.float64)).astype(np.int64)
                ids, scores = np.concatenate([ids, r_id[part]]), np.concatenate([scores, found])
                keep = np.lexsort((ids, np.invert(scores)))[:k]  # ~x falls as x grows, without overflow
                ids, scores = ids[keep], scores[keep]
                kth = max(kth, scores[-1]) if len(scores) == k else kth
            out += [(int(q_id[mine]), int(x), int(v)) for x, v in zip(ids, scores)]
    return out, evaluated


def topk_products(df: DataFrame, every: int = EVERY, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
                  pivots: int = PIVOTS, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: exact, for every id divisible by ``every``."""
    scratch = scratch or Scratch(df.sparkSession, "pivots")
    rows = scratch.write(one_per_id(df.where(finite(vector)), vec_id, quantised(vector)), "vectors")
    n = rows.count()
    # a bounded sample by the hash of the id: twice the share asked for is never reached in practice, and cut if it is
    taken = rows.where(draw(SEED, "pivot", "vec_id") < min(1.0, sample / max(n, 1))).limit(2 * sample).collect()
    taken = sorted(taken, key=lambda x: x["vec_id"])
    known, chosen, starts = {}, {}, {}
    for dim in {len(x["v"]) for x in taken}:
        part = [x for x in taken if len(x["v"]) == dim]
        held = np.array([x["v"] for x in part], np.float64).reshape(len(part), dim)
        short = ~_long(held)
        known[dim], starts[dim] = held[short], np.array([x["vec_id"] for x in part])[short]
        chosen[dim] = farthest_first(known[dim], pivots) if dim and short.any() else np.zeros((0, dim))
    whole = scratch.write(pivot_table(rows, chosen), "pivot-table")

    def run(key, r, q):
        import pandas as pd
        dim = int(key[0])
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        as_matrix = lambda s, w, kind=np.float64: np.stack(s).astype(kind).reshape(len(s), -1) if w else np.zeros((len(s), 0), kind)
        q_id, r_id = q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        qv, rv = as_matrix(q["v"], dim, np.int64), as_matrix(r["v"], dim, np.int64)
        width = len(q["far"].iloc[0])
        floor = np.full(len(q), -np.inf)
        if dim in known and len(known[dim]) > k:
            s = qv.astype(np.float64) @ known[dim].T
            s[q_id[:, None] == starts[dim][None]] = -np.inf
            floor = np.where(q["long"].to_numpy(), -np.inf, np.partition(s, -k, axis=1)[:, -k])
        out, _ = search_block(q_id, qv, q["square"].to_numpy(), as_matrix(q["far"], width), r_id, rv,
                              r["square"].to_numpy(), as_matrix(r["far"], width), floor, k,
                              q["long"].to_numpy(), r["long"].to_numpy())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    queries = whole.where(F.col("vec_id") % every == 0)
    left, right = meet(whole, queries, "dim")
    found = left.cogroup(right).applyInPandas(run, "query_id long, vec_id long, score long")
    return best(found, k, smallest=False)


def op8_pivot_topk(spark, sf_dir: str) -> DataFrame:
    return topk_products(table(spark, sf_dir, "embeddings"))


_SQL = f"""
WITH e AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e x ON len(q.v) = len(x.v) AND q.vec_id <> x.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op8_pivot_topk": op8_pivot_topk}
ORACLE = {"op8_pivot_topk": _SQL}
