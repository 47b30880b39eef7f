"""Nearest neighbours by cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from lacuna.operators.impute import neighbour as N
from lacuna.operators.impute.cells import Cells


def _tables(seed, ties):
    rng = np.random.default_rng(seed)
    q, d = rng.normal(size=(400, 2)), rng.normal(size=(3000, 2))
    if ties:
        q, d = np.round(q), np.round(d)
    qc, dc = rng.integers(0, 3, (400, 1)).astype(float), rng.integers(0, 3, (3000, 1)).astype(float)
    q[rng.random(q.shape) < 0.3] = np.nan
    qc[rng.random(qc.shape) < 0.3] = np.nan
    return q, qc, d, dc, rng.permutation(3000)


def _frame(spark, key, ids, x, c, extra=()):
    rows = [[int(i), *[None if np.isnan(v) else float(v) for v in a], *[None if np.isnan(v) else int(v) for v in b]] for i, a, b in zip(ids, x, c)]
    return spark.createDataFrame([[*r, *e] for r, e in zip(rows, extra or [[]] * len(rows))],
                                 f"{key} long, a double, b double, c int" + (", v string" if extra else "")).repartition(3)


@pytest.mark.parametrize("seed,ties", [(0, False), (1, True)])
def test_cells_give_what_all_pairs_give(spark, monkeypatch, seed, ties):
    monkeypatch.setattr(N, "DONOR_CELL", 64)
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    q, qc, d, dc, ids = _tables(seed, ties)
    assert np.isnan(np.hstack([q, qc])).all(axis=1).any()  # some miss every coordinate
    got = N.knn_topk(_frame(spark, "qid", range(400), q, qc), _frame(spark, "did", ids, d, dc, [[f"v{i}"] for i in ids]), 5, "qid", "did",
                     ["a", "b"], ["c"], [3], carry=["v"]).toPandas().sort_values(["qid", "rank"])
    dist, near = N._best(N._pair_dist(q, qc, d, dc, 5.0, [3]), ids, 5)
    assert got["rank"].tolist() == [1, 2, 3, 4, 5] * 400
    assert np.array_equal(got["did"].to_numpy().reshape(400, 5), near)
    assert np.array_equal(got["dist"].to_numpy().reshape(400, 5), dist)
    assert (got["v"] == "v" + got["did"].astype(str)).all()


def test_few_donors(spark):
    q = spark.createDataFrame([(1, 0.0), (2, None)], "qid long, a double")
    got = N.knn_topk(q, spark.createDataFrame([(7, 1.0), (5, 3.0)], "did long, a double"), 3, "qid", "did", ["a"]).collect()
    assert sorted((r.qid, r.rank, r.did) for r in got) == [(1, 1, 7), (1, 2, 5), (2, 1, 5), (2, 2, 7)]
    assert N.knn_topk(q, spark.createDataFrame([], "did long, a double"), 3, "qid", "did", ["a"]).count() == 0
    assert N.knn_topk(q.limit(0), spark.createDataFrame([(7, 1.0)], "did long, a double"), 3, "qid", "did", ["a"]).count() == 0


@pytest.mark.parametrize("rows", [4_000, 16_000])
def test_cells_a_query_meets_do_not_grow_with_the_donors(spark, rows):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(rows, 2))
    df = spark.createDataFrame(pd.DataFrame({"__did": np.arange(rows), "__held": 3, "__x0": d[:, 0], "__x1": d[:, 1]})).selectExpr(
        "__did", "CAST(__held AS int) AS __held", "__x0", "__x1")
    cells = Cells.cut(df, [3], ["__x0", "__x1"], 2, [], 2.0, 128)
    cells.bound(cells.deal(df))
    assert cells.cells >= rows / 200
    q = rng.normal(size=(500, 2))
    kth = N._best(N._pair_dist(q, np.zeros((500, 0)), d, np.zeros((rows, 0)), 2.0, []), np.arange(rows), 5)[0][:, 4]
    assert len(cells.not_farther(q, kth, 3, -1)[0]) < 3 * 500


def test_search_leaves_only_what_its_result_reads(spark):
    """Queries, and donors copied for every combination, are gone before the caller's next step."""
    from pathlib import Path

    from lacuna.session import ensure_checkpoint_dir
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    names = lambda: {p.name for p in root.glob("lacuna-*")}
    before = names()
    donors = spark.range(300).selectExpr("id AS d", "cast(id % 17 AS double) AS x", "cast(id % 5 AS double) AS y")
    queries = spark.range(40).selectExpr("id AS q", "if(id % 3 = 0, null, id / 2.0D) AS x", "cast(id % 7 AS double) AS y")
    near = N.knn_topk(queries, donors, 3, "q", "d", ["x", "y"])
    left = {n.split("-")[1] for n in names() - before}
    assert left == {"neighbours"}
    assert near.count() == 120 and near.where("rank <= 3").count() == 120
