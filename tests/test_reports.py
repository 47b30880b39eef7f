"""Report operators and file sources against pandas / numpy on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import report as R


@pytest.fixture(scope="module")
def metrics(spark):
    rng = np.random.default_rng(1)
    rows = []
    for imp in ("a", "b"):
        for seed in (1, 2):
            for part in ("X_train_val", "X_test_MCAR3", "X_test_MAR1"):
                for sg in ("overall", "g_dis", "g_priv"):
                    rows.append(("d", imp, "s", seed, part, "x", sg, float(rng.random())))
    return spark.createDataFrame(rows, "dataset_name string, null_imputer_name string, evaluation_scenario string, "
                                       "experiment_seed int, dataset_part string, column_with_nulls string, "
                                       "subgroup string, rmse double")


def test_box_stats_match_numpy(spark, metrics):
    got = {r.null_imputer_name: r for r in R.box_stats(metrics, "rmse", ["null_imputer_name"]).collect()}
    pdf = metrics.toPandas()
    for imp, g in pdf.groupby("null_imputer_name"):
        v = g["rmse"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[imp]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
        assert (r.whisker_low, r.whisker_high) == pytest.approx((inside.min(), inside.max()))


def test_disparity_left_join(spark, metrics):
    d = R.disparity(metrics.where("subgroup <> 'g_priv' OR experiment_seed = 1"), "rmse", "g").toPandas()
    assert len(d) == 12 and d["rmse_priv"].isna().sum() == 6
    ok = d.dropna()
    assert np.allclose(ok["rmse_difference"], ok["rmse_dis"] - ok["rmse_priv"])


def test_scenario_fields(spark, metrics):
    f = R.with_scenario_fields(metrics).select("dataset_part", "test_strategy", "test_error_rate").distinct().toPandas()
    got = {r.dataset_part: (r.test_strategy, round(r.test_error_rate, 9)) for r in f.itertuples()}
    assert got == {"X_test_MCAR3": ("MCAR", 0.3), "X_test_MAR1": ("MAR", 0.1)}


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 60).astype(float)
    y = x + rng.normal(0, 1, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = R.spearman(df, "x", "y").first().spearman
    rx, ry = pd.Series(x).rank(method="average"), pd.Series(y).rank(method="average")
    assert r == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_grouping_sets_rows(spark, metrics):
    s = R.summary_with_grouping_sets(metrics, ["rmse"], by=("null_imputer_name",)).toPandas()
    assert len(s) == 2 * 3 and set(s[s.all_seeds].experiment_seed) == {"all"}


def test_long_metrics(spark):
    from lacuna.operators.score.long_metrics import per_variable_metrics
    cells = spark.createDataFrame([(1, "a", 1.0, 3.0, True), (2, "a", 2.0, 2.0, True), (1, "b", 1.0, 0.7, True),
                                   (2, "b", 0.0, 0.6, True), (3, "b", 0.0, 0.2, False)],
                                  "row_id long, col string, truth double, pred double, is_target boolean")
    var = spark.createDataFrame([("a", "continuous", 0.0, 4.0), ("b", "binary", 0.0, 1.0)],
                                "name string, type string, lower double, upper double")
    m = {r.col: r for r in per_variable_metrics(cells, var).collect()}
    assert m["a"].rmse == pytest.approx(np.sqrt(2.0)) and m["a"].normalised_rmse == pytest.approx(np.sqrt(2.0) / 4)
    assert m["b"].fraction_incorrect == pytest.approx(0.5) and m["all"].n == 4


def test_file_sources(spark, tmp_path):
    from lacuna.sources.files import apply_missing_positions, flatten, read_csv_with_mask, triplets_last_wins, unflatten
    p = tmp_path / "d.csv"
    p.write_text("1,2.5,a\n2,,b\n3,4.0,\n")
    df, mask = read_csv_with_mask(spark, str(p), spark.createDataFrame([], "id int, x double, c string").schema)
    assert [tuple(r) for r in mask.collect()] == [(1, 1, 1), (1, 0, 1), (1, 1, 0)]
    t = spark.createDataFrame([(1, "x", 1.0, 1), (1, "x", 2.0, 2), (2, "x", 3.0, 1)], "row_id int, col_id string, value double, seq int")
    assert sorted(tuple(r) for r in triplets_last_wins(t).collect()) == [(1, "x", 2.0), (2, "x", 3.0)]
    nested = spark.createDataFrame([((1, (2, 3)),)], "s struct<a:int, b:struct<c:int, d:int>>")
    flat = flatten(nested)
    assert flat.columns == ["s.a", "s.b.c", "s.b.d"]
    assert unflatten(flat).schema.simpleString() == nested.schema.simpleString()
    base = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "row_id long, x double, y double")
    pos = spark.createDataFrame([(2, 1)], "row long, col int")
    out = {r.row_id: (r.x, r.y) for r in apply_missing_positions(base, pos, ["x", "y"]).collect()}
    assert out == {1: (1.0, 2.0), 2: (None, 4.0)}
