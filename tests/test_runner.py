"""The run with its model branch on a small table."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators.split import TRAIN
from lacuna.plans import runner as X
from lacuna.plans.experiment import prepare_parts
from lacuna.sources.store import MetricStore
from lacuna.sources.tables import load
from paths import SF_SMALL

RATE = X.RateModel("by_priority", ("o_orderpriority",))


@pytest.fixture(scope="module")
def spec(spark):
    return load(spark, SF_SMALL, "orders")


def test_rate_model(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("c", 0), (None, 1)], "g string, label int")
    predict = X.RateModel("m", ("g",)).fit(train, [], [])
    got = {r["g"]: r["prediction"] for r in predict(spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("new",)], "g string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, None: 1, "new": 0}  # the mean is 4/6


def test_run_writes_both_kinds_of_rows(spark, spec):
    store = MetricStore(spark)
    imputation, rows = X.run_experiment(spec, ["median-mode", "boost_clean"], [RATE], "exp1_mcar3", 100, store)
    assert {r[0] for r in imputation.select("null_imputer_name").distinct().collect()} == {"median-mode"}
    got = rows.groupBy("null_imputer_name", "model_name").agg(F.count_distinct("dataset_part").alias("parts"), F.count_distinct("metric").alias("metrics")).collect()
    assert {(r["null_imputer_name"], r["model_name"], r["parts"], r["metrics"]) for r in got} == {("median-mode", "by_priority", 3, 7), ("boost_clean", "by_priority", 3, 7)}
    assert rows.where("tag <> 'OK' OR exp_pipeline_guid IS NULL").count() == 0
    assert rows.where("subgroup = 'overall'").agg(F.min("sample_size"), F.max("sample_size")).first()[0] > 0


def test_models_do_not_see_sensitive_columns(spark, spec):
    seen = []

    class Spy:
        name = "spy"

        def fit(self, train, numeric, categorical):
            seen.append((set(train.columns), set(numeric) | set(categorical)))
            return lambda df: df.withColumn("prediction", F.lit(1))

    _, rows = X.run_experiment(spec, ["median-mode"], [Spy()], "exp1_mcar3", 100, MetricStore(spark))
    assert not (set(spec.sensitive_attrs) & (seen[0][0] | seen[0][1]))
    assert rows.where("subgroup <> 'overall'").count() > 0  # they still group the results


def test_accuracy_per_repair(spark, spec):
    parts = prepare_parts(spec, "exp1_mcar3", 100)
    got = {r["repair"]: r for r in X.accuracy_per_repair(spec, parts, RATE, "X_test_MCAR3", 100).collect()}
    assert {"truth", "mean repair", "mean-most_frequent", "median-constant"} <= set(got)
    assert got["mean repair"]["val_accuracy"] == got["mean-most_frequent"]["val_accuracy"]
    assert all(0 <= r["test_accuracy"] <= 1 for r in got.values())


def test_joint_rounds_are_the_best_on_validation(spark, spec):
    parts = prepare_parts(spec, "exp1_mcar3", 100)
    said, rounds = X.joint_predictions(spec, parts, RATE, 100, rounds=(1, 3))
    assert rounds in (1, 3)
    assert said.count() == parts.where(F.col("part") != TRAIN).count() and said.where("prediction NOT IN (0, 1)").count() == 0


def test_parameters_are_stored_by_version(spark):
    table = X.ParameterTable(MetricStore(spark))
    assert table.lookup("knn", "orders", "MCAR3") is None
    assert table.resolve("knn", "orders", "exp1_mcar3", lambda: {"k": 5}) == {"k": 5}
    assert table.resolve("knn", "orders", "exp1_mcar3", lambda: {"k": 9}) == {"k": 5}  # known, so not tuned again
    assert table.remember("knn", "orders", "MCAR3", {"k": 7}) == 2
    assert table.lookup("knn", "orders", "MCAR3") == {"k": 7} and table.lookup("knn", "orders", "MAR3") is None
    assert table.resolve("other", "orders", "exp1_mar3", None) == {} and table.rows().count() == 3
