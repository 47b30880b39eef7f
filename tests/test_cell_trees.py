"""trees from counts by cell are Spark ML's trees."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from lacuna.operators import boosting as B
from lacuna.operators import cell_trees as T
from lacuna.operators.encode import OneHotScale
from lacuna.operators.models import stable_input
from lacuna.operators.split import kfold


def _rows(spark, n=1500):
    rng = np.random.default_rng(5)
    x, y, k = rng.normal(0, 1, n), np.round(rng.exponential(1, n), 2), rng.integers(0, 4, n)
    label = (x + (k == 2) * 1.5 - y + rng.normal(0, 1, n) > 0).astype(int)
    rows = [(i, None if i % 50 == 3 else float(a), float(b), None if i % 40 == 7 else "pqrs"[c], int(d)) for i, (a, b, c, d) in enumerate(zip(x, y, k, label))]
    return spark.createDataFrame(rows, "row_id bigint, x double, y double, k string, label int")


def test_losses_are_those_of_the_row_learner(spark, monkeypatch):
    df, grid = _rows(spark), [{"maxDepth": 3, "minInstancesPerNode": 20}, {"maxDepth": 4, "minInstancesPerNode": 10}]
    folded = kfold(df, 1, 2)
    want = {}
    for f in range(2):
        known, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        feats = OneHotScale(["x", "y"], ["k"]).fit(known)
        a = stable_input(feats.transform(known).select("row_id", "features", "label"))
        b = feats.transform(held).select("features", F.col("label").cast("double").alias("label"))
        for i, p in enumerate(grid):
            want[i, f] = GBTClassifier(maxIter=5, seed=1, **p).fit(a).evaluateEachIteration(b)
    monkeypatch.setattr(B, "GBTClassifier", lambda *a, **k: pytest.fail("rows were fitted"))
    losses, _, model, feats = B.early_stopped_cv(df, ["x", "y"], ["k"], grid, max_rounds=5, patience=2, folds=2, seed=1)
    for r in losses.collect():
        assert r["loss"] == pytest.approx(want[r["set"], r["fold"]][r["round"] - 1], rel=1e-9)
    assert model.transform(feats.transform(df)).where(F.col("prediction") == F.col("label")).count() > 1000


def test_cuts_come_from_the_sample_of_the_row_learner(spark):
    rng = np.random.default_rng(6)
    n = 24_000
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, n), rng.integers(0, 2, n)))], "row_id bigint, x double, label int")
    feats = OneHotScale(["x"], []).fit(df)
    a = stable_input(feats.transform(df).select("row_id", "features", "label")).cache()
    grid = T.Grid.of(a, n, feats, 9)
    tree = DecisionTreeClassifier(seed=9, maxDepth=6).fit(a)._to_java().toDebugString()
    used = {float(line.split("<=")[1].strip(" )")) for line in tree.splitlines() if "<=" in line}
    assert len(grid.cuts[0]) > 20 and used and used <= set(grid.cuts[0])


def test_a_shallow_tree_is_the_top_of_a_deep_one(spark):
    df = _rows(spark)
    feats = OneHotScale(["x", "y"], ["k"]).fit(df)
    a = stable_input(feats.transform(df).select("row_id", "features", "label", "x", "y", "k")).cache()
    grid = T.Grid.of(a, a.count(), feats, 3)
    cells = grid.count(a, feats)
    for impurity in ("gini", "entropy"):
        shares = T.tree_shares(cells, [2, 5, 8], 5, impurity)
        for d in (2, 5, 8):
            got = T.CellModel(grid, np.isin(np.arange(np.prod(grid.shape)), cells.cell[shares[d] > 0.5]))
            want = DecisionTreeClassifier(seed=3, maxDepth=d, minInstancesPerNode=5, impurity=impurity).fit(a)
            p, q = ({r["row_id"]: r["prediction"] for r in m.transform(a).select("row_id", "prediction").collect()} for m in (got, want))
            assert sum(p[i] != q[i] for i in p) <= (0 if d < 8 else 15)  # ties of few rows


def test_no_cells_for_other_labels_or_wide_tables(spark, monkeypatch):
    df = _rows(spark, 200)
    feats = OneHotScale(["x", "y"], ["k"]).fit(df)
    rows = stable_input(feats.transform(df))
    grid = T.Grid.of(rows, 200, feats, 3)
    assert grid.count(rows.withColumn("label", F.lit(2)), feats) is None
    monkeypatch.setattr(T, "MAX_CELLS", 100)
    assert T.Grid.of(rows, 200, feats, 3) is None
