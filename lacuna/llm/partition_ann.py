"""Approximate nearest neighbours with learned partitions.

On a sample of at most about ``SAMPLE`` vectors: build the graph of each vector's nearest
neighbours, cut it into ``PARTITIONS`` parts of equal size with few edges between them
(recursive bisection along the graph's slowest-varying vector, then swaps of pairs that
shorten the cut), and train a small network to tell a vector's part from its coordinates.
Every row of the table is then indexed under its most probable part.  A query visits parts
in the order of its probabilities until they add up to a share that, on held-out vectors of
the sample, found the target part of their true neighbours; inside the visited parts all
rows are ranked by exact Euclidean distance in double precision.

The recall is a matter of the data: on vectors without structure the visited share is
large, which costs time, not recall.  Vectors that are null, all zero or hold null or
non-finite components take no part, nor do rows without an id; of rows that repeat an id
the smallest vector counts; only vectors of equal length are compared (each length has an
index of its own); fewer candidates than k give them all; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, finite, meet, one_per_id
from .common import Scratch, draw, table

K = 10
EVERY = 100
SAMPLE = 4_096
PARTITIONS = 16
NEIGHBOURS = 10
HIDDEN = 64
TARGET_RECALL = 0.97
SEED = 3


# ---- the sample's graph and its balanced parts ------------------------------------------

def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    sq = (x * x).sum(axis=1)
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        d = sq[a:a + 512, None] - 2 * x[a:a + 512] @ x.T + sq
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out[a:a + 512] = np.argsort(d, axis=1, kind="stable")[:, :out.shape[1]]
    return out


def _bisect(members: np.ndarray, edges: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` with few of ``edges`` (pairs) between them."""
    place = {int(m): i for i, m in enumerate(members)}
    inside = np.array([[place[a], place[b]] for a, b in edges.tolist() if a in place and b in place], np.int64).reshape(-1, 2)
    n = len(members)
    a, b = inside[:, 0], inside[:, 1]
    degree = np.bincount(np.concatenate([a, b]), minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):  # power steps on the lazy walk, without its constant direction
        v -= (v @ degree) / degree.sum()
        v = 0.5 * v + 0.5 * (v + np.bincount(a, v[b], n) + np.bincount(b, v[a], n)) / degree
        v /= np.abs(v).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2:]] = True
    for _ in range(20):  # swap the pairs that gain most; balance stays
        other = np.bincount(a, side[a] != side[b], n) + np.bincount(b, side[a] != side[b], n)
        gain = 2 * other - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = max(1, min(len(left), len(right)) // 20)
        good = gain[left[:m]] + gain[right[:m]] > 2
        if not good.any():
            break
        cut = (side[a] != side[b]).sum()
        trial = side.copy()
        trial[left[:m][good]], trial[right[:m][good]] = True, False
        if (trial[a] != trial[b]).sum() >= cut:
            break
        side = trial
    return members[~side], members[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """A part for every row, sizes at most one apart per bisection."""
    rng = np.random.default_rng(seed)
    edges = np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()], axis=1)
    groups = [np.arange(len(graph))]
    while len(groups) < parts and max(map(len, groups)) > 1:
        groups = [half for g in groups for half in _bisect(g, edges, rng) if len(half)]
    out = np.zeros(len(graph), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


# ---- the router -------------------------------------------------------------------------

@dataclass
class Router:
    """A one-layer network: vector -> probabilities of the parts; ``mass`` is the share of
    probability that a query visits."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """For every row, a flag per part: visited until the mass is reached."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        flags = np.zeros(p.shape, bool)
        np.put_along_axis(flags, order, before < self.mass, axis=1)
        return flags


def train_router(x: np.ndarray, target: np.ndarray, hidden: int, seed: int, steps: int = 300) -> Router:
    """Cross-entropy against the parts of each vector and its neighbours (rows of
    ``target`` add up to 1); full-batch Adam steps, deterministic."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], target.shape[1]
    scale = 1 / max(1e-12, float(np.sqrt((x * x).mean())))
    p = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim) * scale, np.zeros(hidden),
         rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    rates = [0.01 * scale, 0.01, 0.01, 0.01]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.maximum(x @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        e = (z / z.sum(axis=1, keepdims=True) - target) / len(x)
        back = (e @ p[2].T) * (h > 0)
        for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rates[i] * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-12)
    return Router(*p, mass=1.0)


def fit_router(x: np.ndarray, parts: int = PARTITIONS, k: int = NEIGHBOURS, hidden: int = HIDDEN,
               target_recall: float = TARGET_RECALL, seed: int = SEED) -> Router:
    """Parts and router on three quarters of ``x``; the visited mass on the rest."""
    train, held = x[np.arange(len(x)) % 4 != 3], x[np.arange(len(x)) % 4 == 3]
    if len(train) < 4 * parts or not len(held):  # too few to learn from: one part, always visited
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbour_graph(train, k)
    part = balanced_parts(graph, parts, seed)
    count = int(part.max()) + 1
    target = 0.5 * np.eye(count)[part] + 0.5 * np.eye(count)[part[graph]].mean(axis=1)
    router = train_router(train, target, hidden, seed)
    # the mass at which held-out vectors reach the target share of their true neighbours
    home = router.probabilities(train).argmax(axis=1)
    d = (held * held).sum(axis=1)[:, None] - 2 * held @ train.T + (train * train).sum(axis=1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    p = router.probabilities(held)
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_p = np.take_along_axis(p, order, 1)
    before = np.empty_like(p)  # mass that comes before a part is visited
    np.put_along_axis(before, order, np.cumsum(sorted_p, axis=1) - sorted_p, axis=1)
    needed = np.sort(np.take_along_axis(before, home[near], 1).ravel())
    router.mass = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))))], 2))
    return router


# ---- index and search -------------------------------------------------------------------

def _cells(rows: DataFrame, routers: dict[int, Router], visits: bool) -> DataFrame:
    """vec_id, v, cell ("dimension/part"): the home part of each row, or all visited parts."""

    def run(batches):
        import pandas as pd
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                dim, x = int(dim), np.stack(part["v"]).astype(np.float64)
                router = routers.get(dim)
                if router is None:
                    cells = [[f"{dim}/0"]] * len(part)
                elif visits:
                    cells = [[f"{dim}/{c}" for c in np.flatnonzero(f)] for f in router.visits(x)]
                else:
                    cells = [[f"{dim}/{c}"] for c in router.probabilities(x).argmax(axis=1)]
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "cells": cells})

    out = rows.mapInPandas(run, "vec_id long, v array<double>, cells array<string>")
    return out.select("vec_id", "v", F.explode("cells").alias("cell"))


def _nearest(k: int):
    def run(key, r, q):
        import pandas as pd
        out = []
        if len(q) and len(r):
            rv, qv = np.stack(r["v"]).astype(np.float64), np.stack(q["v"]).astype(np.float64)
            r_id, q_id = r["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            rs = (rv * rv).sum(axis=1)
            for a in range(0, len(qv), 64):
                x = qv[a:a + 64]
                xs = (x * x).sum(axis=1)
                d2 = xs[:, None] - 2 * x @ rv.T + rs
                d2[q_id[a:a + 64, None] == r_id[None]] = np.inf
                for i in range(len(x)):
                    row = d2[i]
                    if len(row) > 4 * k:
                        # everything that rounding could hide among the k nearest
                        edge = np.partition(row, k - 1)[k - 1]
                        some = np.flatnonzero(row <= edge + 1e-9 * (xs[i] + rs.max()) + 1e-300)
                    else:
                        some = np.arange(len(row))
                    some = some[np.isfinite(row[some])]
                    exact = np.sqrt(((rv[some] - x[i]) ** 2).sum(axis=1))
                    for j in np.lexsort((r_id[some], exact))[:k]:
                        out.append((int(q_id[a + i]), int(r_id[some[j]]), float(exact[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def ann(df: DataFrame, every: int = EVERY, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
        sample: int = SAMPLE, parts: int = PARTITIONS, target_recall: float = TARGET_RECALL,
        scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every id divisible by ``every``."""
    scratch = scratch or Scratch(df.sparkSession, "ann")
    usable = df.where(finite(vector)).where(F.exists(vector, lambda x: x != 0))
    rows = scratch.write(one_per_id(usable, vec_id, F.transform(vector, lambda x: x.cast("double"))), "vectors")
    n = rows.count()
    taken = rows.where(draw(SEED, "ann", "vec_id") < min(1.0, sample / max(n, 1))).limit(2 * sample).collect()
    taken = sorted(taken, key=lambda x: x["vec_id"])
    routers = {}
    for dim in sorted({len(x["v"]) for x in taken}):
        routers[dim] = fit_router(np.array([x["v"] for x in taken if len(x["v"]) == dim]), parts, target_recall=target_recall)
    index = scratch.write(_cells(rows, routers, visits=False), "index")
    queries = scratch.write(_cells(rows.where(F.col("vec_id") % every == 0), routers, visits=True), "queries")
    left, right = meet(index, queries, "cell")
    found = left.cogroup(right).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    return best(found, k, smallest=True)


def op3_learned_partitions(spark, sf_dir: str) -> DataFrame:
    return ann(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_learned_partitions": op3_learned_partitions}
ORACLE = {}
