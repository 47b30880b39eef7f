"""Exact quantiles, blocked neighbours, reports with several keys, and other corrected operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.predicates import Range, sql_condition
from lacuna.functions.quantiles import quantiles
from lacuna.operators import models as M
from lacuna.operators import report as R
from lacuna.operators.encode import OneHotScale
from lacuna.operators.graphprep import dense_index
from lacuna.operators.impute import neighbour as K
from lacuna.operators.impute.factor import als_impute
from lacuna.operators.impute.simple import ranked_values
from lacuna.operators.inject_cells import poisson_bars
from lacuna.operators.split import capped_slices


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_exact_quantiles_over_many_levels(spark, buckets):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.standard_normal(300) * 1e-9, rng.standard_normal(200) * 1e9, [5.0] * 50])
    b = rng.integers(0, 4, 550).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        got = quantiles(df, {"a": p, "b": p, "c": p}, buckets=buckets)
        assert "c" not in got
        assert got["a"] == pytest.approx(np.quantile(a, p), rel=1e-12, abs=1e-300)
        assert got["b"] == pytest.approx(np.quantile(b, p), rel=1e-12)
    assert quantiles(df.limit(0), {"a": 0.5}) == {}


def test_ranked_values_beyond_the_first(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbbccd"] + [(None,)], "v string")
    assert [ranked_values(df, ["v"], r).get("v") for r in (1, 2, 3, 4, 5)] == ["a", "b", "c", "d", None]


def test_ranges():
    assert sql_condition("x", {"lt": 3, "ge": 1}) == "COALESCE((x >= 1 AND x < 3), FALSE)"
    for bad in ({}, {"ge": 1, "gt": 2}, {"le": 1, "lt": 2}, {"eq": 1}):
        with pytest.raises(ValueError):
            Range.of(bad)


@pytest.mark.parametrize("qb,db", [(8192, 16384), (7, 11)])
def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch, qb, db):
    monkeypatch.setattr(K, "QUERY_BLOCK", qb)
    monkeypatch.setattr(K, "DONOR_BLOCK", db)
    rng = np.random.default_rng(2)
    q, d = np.round(rng.standard_normal((30, 3)), 1), np.round(rng.standard_normal((60, 3)), 1)
    qd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, v array<double>")
    dd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], "did long, v array<double>")
    got = {(r["qid"], r["rank"]): r["did"] for r in K.knn_topk(qd, dd, 4, "qid", "did", ["v"], metric="euclidean").collect()}
    for i in range(30):
        dist = np.sqrt(((d - q[i]) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(60), dist))[:4]
        assert [got[i, r] for r in (1, 2, 3, 4)] == list(want)


def test_one_hot_uses_train_labels_and_population_std(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, k string")
    other = spark.createDataFrame([(2.0, "z"), (None, None), (3.0, "b")], "x double, k string")
    feats = OneHotScale(("x",), ("k",)).fit(train)
    assert feats.names == ["x", "k=a", "k=b", "k=c"]
    z = 1 / np.sqrt(2 / 3)
    got = [list(r["features"].toArray()) for r in feats.transform(other).collect()]
    assert got == [[0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], [pytest.approx(z), 0.0, 1.0, 0.0]]
    dropped = OneHotScale(("x",), ("k",), drop_first=True).fit(train)
    assert dropped.names == ["x", "k=b", "k=c"]


def test_tuning_scores_are_held_out(spark):
    """Labels that only the row id explains: held-out scores stay near chance, training ones would not."""
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.standard_normal()), f"c{i % 4}", int(rng.integers(2))) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, x double, k string, label int")
    tuned, fitted, feats = M.tune(df, ["x"], ["k"], names=("dt_clf",), grid="small")
    r = tuned.first()
    assert 0.35 < r["accuracy_score"] < 0.62 and 0.3 < r["f1_score"] < 0.62
    train_acc = M.macro_f1_and_accuracy(fitted["dt_clf"].transform(feats.transform(df)))[1]
    assert train_acc > r["accuracy_score"]
    assert {len(v[1]) for v in [M.model_registry(grid="full")["dt_clf"]]} == {40}


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 1.0), (1, 0.0)], "label int, prediction double")
    f1, acc = M.macro_f1_and_accuracy(df)
    assert f1 == pytest.approx((0.5 + 2 / 3) / 2) and acc == pytest.approx(0.6)


def test_fit_partitions_depend_on_rows_alone(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    parts = [[sorted(r[0] for r in p) for p in M.stable_input(df.repartition(n)).rdd.glom().collect()] for n in (1, 3, 7)]
    assert parts[0] == parts[1] == parts[2]


def test_grouping_sets_with_two_keys_and_a_null(spark):
    df = spark.createDataFrame([("a", None, 1, 1.0), ("a", None, 2, 3.0), ("a", "x", 1, 5.0)], "g string, h string, experiment_seed int, m double")
    out = {(r["g"], r["h"], r["experiment_seed"]): r["m_mean"] for r in R.summary_with_grouping_sets(df, ["m"], by=("g", "h")).collect()}
    assert out == {("a", None, "all"): 2.0, ("a", None, "1"): 1.0, ("a", None, "2"): 3.0, ("a", "x", "all"): 5.0, ("a", "x", "1"): 5.0}


def test_train_mechanism_takes_the_first_allowed_scenario(spark):
    from lacuna.plans.scenarios import EVALUATION_SCENARIOS
    s = spark.createDataFrame([(k, i) for i, k in enumerate(EVALUATION_SCENARIOS)], "evaluation_scenario string, position int")
    m = spark.createDataFrame([("MCAR3",), ("MCAR1",), ("MNAR5",), ("MCAR2",)], "train_mechanism string")
    got = {r[0]: r[1] for r in R.train_mechanism_to_scenario(m, s).collect()}
    assert got == {"MCAR3": "exp1_mcar3", "MCAR1": "exp2_3_mcar1", "MNAR5": "exp2_3_mnar5", "MCAR2": None}


def test_factorisation_keeps_cold_cells(spark):
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(i + j)) for i in range(6) for j in range(4)], "row_id string, col_id string, value double")
    ask = spark.createDataFrame([("r1", "c2"), ("new", "c1"), ("r1", "none")], "row_id string, col_id string")
    out = {(r["row_id"], r["col_id"]): r for r in als_impute(cells, candidates=ask).collect()}
    assert len(out) == 3 and not out["r1", "c2"]["cold"]
    assert out["new", "c1"]["cold"] and out["r1", "none"]["cold"] and out["new", "c1"]["value"] == pytest.approx(4.0)


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "d", "a", "c"]], "k string")
    assert sorted((r["k"], r["i"]) for r in dense_index(df, "k", "i").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert dense_index(df.limit(0), "k").count() == 0


def test_bootstrap_bars_reach_the_resolution():
    assert poisson_bars()[-1] >= 1 - 2.0 ** -33 and len(poisson_bars()) > 12


def test_slices_with_a_cap(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    n = {r["part"]: r["count"] for r in capped_slices(df, 1, val_size=10, max_size=50).groupBy("part").count().collect()}
    assert n == {"X_test": 12, "X_val": 10, "X_train_val": 28}
    n = {r["part"]: r["count"] for r in capped_slices(df, 1, val_size=10).groupBy("part").count().collect()}
    assert n == {"X_test": 27, "X_val": 10, "X_train_val": 63}
