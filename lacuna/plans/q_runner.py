"""The run with its model branch (L8, P1, L29, L17, L18, I34) on models whose predictions both
engines can compute, and on Spark ML models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_key, sql_hash_unit
from ..operators.impute.repairs import sql_repair_table
from ..operators.score.cells import REAL
from ..operators.score.groups import sql_membership
from ..operators.split import TRAIN
from ..sources.store import MetricStore
from ..sources.tables import DATASETS, load
from . import runner as X
from .catalog import register
from .experiment import prepare_parts, sql_impute, sql_prepare_parts

SEED = 100
SCENARIO = "exp1_mnar3"
TEST = "X_test_MCAR3"
ORD = DATASETS["orders"]
FEATS = [*ORD["numeric"], *ORD["categorical"]]
IMPUTERS = ["median-mode", "mean-mode", "median-dummy"]
MODELS = [X.RateModel("by_priority", ("o_orderpriority",)), X.RateModel("by_nation", ("c_nation",))]
_PARTS = sql_prepare_parts("orders", FEATS, SCENARIO, SEED, ORD["test_fraction"])


def _run(spark, sf, imputers, models):
    return X.run_experiment(load(spark, sf, "orders"), imputers, models, SCENARIO, SEED, MetricStore(spark))


def _said_sql(train: str, rows: str, by: str) -> str:
    """Rows with the prediction of a rate model by one column."""
    return (f"(SELECT r.*, coalesce(CASE WHEN t.p * w.n >= w.p * t.n THEN 1 ELSE 0 END, 0) AS prediction FROM {rows} r "
            f"LEFT JOIN (SELECT {by} AS k, sum(label) AS p, count(*) AS n FROM {train} GROUP BY 1) t ON r.{by} IS NOT DISTINCT FROM t.k "
            f"CROSS JOIN (SELECT sum(label) AS p, count(*) AS n FROM {train}) w)")


def _metrics_sql(said: str) -> str:
    """part, subgroup, sample_size, metric, metric_value."""
    return f"""SELECT part, subgroup, n AS sample_size,
      unnest(['TPR', 'TNR', 'FPR', 'FNR', 'Accuracy', 'F1', 'Selection_Rate']) AS metric,
      unnest([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0), fp / nullif(fp + tn, 0), fn / nullif(fn + tp, 0),
              (tp + tn) / n, 2 * tp / nullif(2 * tp + fp + fn, 0), (tp + fp) / n]) AS metric_value
      FROM (SELECT part, subgroup, count(*) AS n, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn
        FROM (SELECT part, label, prediction, unnest({sql_membership(ORD['sensitive'])}) AS subgroup FROM {said}) GROUP BY part, subgroup)"""


def _runs_sql() -> str:
    ctes, arms = [f"parts AS MATERIALIZED ({_PARTS})"], []
    for i, imputer in enumerate(IMPUTERS):
        ctes.append(f"imputed_{i} AS MATERIALIZED ({sql_impute('SELECT * FROM parts', imputer, ORD['numeric'], ORD['categorical'])})")
        for m in MODELS:
            said = _said_sql(f"(SELECT * FROM imputed_{i} WHERE part = '{TRAIN}')", f"(SELECT * FROM imputed_{i} WHERE part <> '{TRAIN}')", m.by[0])
            arms.append(f"SELECT 'orders' AS dataset_name, '{imputer}' AS null_imputer_name, '{SCENARIO}' AS evaluation_scenario, {SEED} AS experiment_seed, "
                        f"'{m.name}' AS model_name, part AS dataset_part, subgroup, sample_size, metric, metric_value FROM ({_metrics_sql(said)})")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(arms)}"


@register("run_model_metrics", _runs_sql(), doubles=("metric_value",), note="L8, P1, L7, L9: model rows of a run, sensitive columns dropped before the fit")
def _l8(spark, sf):
    rows = _run(spark, sf, IMPUTERS, MODELS)[1]
    return rows.select("dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed", "model_name", "dataset_part", "subgroup",
                       "sample_size", "metric", "metric_value")


@register("run_joint_cleaning", None, note="L8 joint branch, L17, L18: boosted repairs, rounds chosen by validation accuracy")
def _l8_joint(spark, sf):
    rows = X.run_experiment(load(spark, sf, "orders"), ["mean-mode", "boost_clean"], MODELS[:1], SCENARIO, SEED, MetricStore(spark))[1]
    return rows.drop("exp_pipeline_guid", "tag")


@register("run_logistic_metrics", None, note="L8 with a Spark ML model")
def _l8_ml(spark, sf):
    rows = _run(spark, sf, ["median-mode"], [X.SparkModel("lr_clf", lambda: LogisticRegression(regParam=0.01))])[1]
    return rows.drop("exp_pipeline_guid", "tag")


def _repairs_sql() -> str:
    held = f"{sql_hash_unit(sql_hash_key(SEED, 'repair-val', 'row_id'))} < CAST({X.VALIDATION} AS DOUBLE)"
    real = ", ".join(f"{REAL}{c} AS {c}" for c in FEATS)
    cols = "label, " + ", ".join(FEATS)
    by = MODELS[0].by[0]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
    return f"""WITH parts AS MATERIALIZED ({_PARTS}),
damaged AS MATERIALIZED (SELECT * FROM parts WHERE part = '{TRAIN}' AND NOT {held}),
rep AS MATERIALIZED ({sql_repair_table('SELECT * FROM damaged', 'SELECT * FROM damaged', ORD['numeric'], ORD['categorical'])}),
named AS (SELECT r.repair, d.label, {', '.join('r.' + c for c in FEATS)} FROM rep r JOIN damaged d USING (row_id)
  UNION ALL SELECT n.repair, {cols} FROM damaged, (SELECT DISTINCT repair FROM rep) n WHERE {whole}),
sets AS MATERIALIZED (SELECT * FROM named UNION ALL SELECT 'mean repair', {cols} FROM named WHERE repair = 'mean-most_frequent'
  UNION ALL SELECT 'truth', label, {real} FROM damaged),
ev AS MATERIALIZED (SELECT 'val' AS side, label, {real} FROM parts WHERE part = '{TRAIN}' AND {held}
  UNION ALL SELECT 'test', label, {real} FROM parts WHERE part = '{TEST}'),
rate AS (SELECT repair, {by} AS k, sum(label) AS p, count(*) AS n FROM sets GROUP BY 1, 2),
w AS (SELECT repair, sum(label) AS p, count(*) AS n FROM sets GROUP BY 1),
hit AS (SELECT w.repair, side, CASE WHEN coalesce(CASE WHEN r.p * w.n >= w.p * r.n THEN 1 ELSE 0 END, 0) = ev.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
  FROM w CROSS JOIN ev LEFT JOIN rate r ON r.repair = w.repair AND r.k = ev.{by})
SELECT repair, avg(CASE WHEN side = 'val' THEN hit END) AS val_accuracy, avg(CASE WHEN side = 'test' THEN hit END) AS test_accuracy FROM hit GROUP BY repair"""


@register("accuracy_per_repair", _repairs_sql(), doubles=("val_accuracy", "test_accuracy"), note="L29: a model per repair, on the truth and on the mean repair")
def _l29(spark, sf):
    spec = load(spark, sf, "orders")
    return X.accuracy_per_repair(spec, prepare_parts(spec, SCENARIO, SEED), MODELS[0], TEST, SEED)
