"""Single steps over the given tables: gains per row, rewards and observed sets (Q4, Q5, Q6),
masked cells (P14), binary and typed errors (M16, M20, M21), and the labels and filters of
model rows (A11, A23, A37, A38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquire as Q
from ..operators import models as M
from ..operators import report as R
from ..operators.nullops import keep_observed
from ..operators.score.long_metrics import binary_confusion, error_by_type, item_difficulty
from ..sources.tables import read
from .catalog import register
from .q_graph import _CANDS, _CELLS, _OBS, _RANDOM_SQL, SEED, _cells
from .q_runner import _l8, _runs_sql

# ---- Q4, Q5, Q6 -----------------------------------------------------------------------------------

_ROW_GAINS = (f"SELECT s.row_id, m.col_id, abs(m.m - s.s) AS gain FROM (SELECT col_id, avg(value) AS m FROM ({_OBS}) GROUP BY 1) m, "
              f"(SELECT row_id, avg(value) AS s FROM ({_OBS}) GROUP BY 1) s")


def _row_gains(observed):
    return Q.row_gains(observed.withColumn("strategy", F.lit("row"))).drop("strategy")


@register("next_feature_row_gain", f"""SELECT row_id, col_id, value, gain FROM (SELECT c.*, g.gain, row_number() OVER (PARTITION BY c.row_id ORDER BY g.gain DESC, c.col_id) AS r
  FROM ({_CANDS}) c JOIN ({_ROW_GAINS}) g ON g.row_id = c.row_id AND g.col_id = c.col_id) WHERE r <= 2""", doubles=("value", "gain"), note="Q4: the two best features of each row")
def _q4(spark, sf):
    cells, observed = _cells(spark, sf)
    return Q.next_by_row_gain(Q.observable(cells, observed), _row_gains(observed), 2)


@register("improvement_reward", f"""SELECT c.row_id, c.col_id, CASE WHEN o.row_id IS NOT NULL THEN NULL ELSE greatest(0.0::DOUBLE, c.value - m.m) END AS reward
  FROM ({_CELLS}) c JOIN (SELECT col_id, avg(value) AS m FROM ({_OBS}) GROUP BY 1) m USING (col_id)
  LEFT JOIN ({_OBS}) o ON o.row_id = c.row_id AND o.col_id = c.col_id""", doubles=("reward",), note="Q5: gain of a cell's value over the mean of its feature")
def _q5(spark, sf):
    cells, observed = _cells(spark, sf)
    old = cells.drop("value").join(observed.groupBy("col_id").agg(F.avg("value").alias("value")), "col_id")
    return Q.improvement_reward(cells, old, observed)


_TWO_STEPS = (f"SELECT row_id, col_id, 0 AS step FROM ({_RANDOM_SQL}) UNION ALL SELECT row_id, col_id, 1 AS step FROM (SELECT c.row_id, c.col_id, "
              f"row_number() OVER (PARTITION BY c.row_id ORDER BY g.gain DESC, c.col_id) AS r FROM ({_CANDS}) c JOIN ({_ROW_GAINS}) g "
              "ON g.row_id = c.row_id AND g.col_id = c.col_id) WHERE r = 1")


@register("observed_after_steps", f"""WITH ch AS MATERIALIZED ({_TWO_STEPS}), o AS MATERIALIZED ({_OBS})
SELECT k.row_id, CAST(k.step AS INT) AS step, (SELECT string_agg(DISTINCT col_id, ',' ORDER BY col_id) FROM (
  SELECT col_id FROM o WHERE o.row_id = k.row_id UNION ALL SELECT col_id FROM ch WHERE ch.row_id = k.row_id AND ch.step <= k.step)) AS observed
FROM (SELECT DISTINCT row_id, step FROM ch) k""", note="Q6: the observed set after a random and a gain-ranked step")
def _q6(spark, sf):
    cells, observed = _cells(spark, sf)
    left = Q.observable(cells, observed)
    first = Q.next_random(left, 1, SEED, 0).select("row_id", "col_id", F.lit(0).alias("step"))
    second = Q.next_by_row_gain(left, _row_gains(observed), 1).select("row_id", "col_id", F.lit(1).alias("step"))
    out = Q.observed_after_steps(observed, first.unionByName(second))
    return out.select("row_id", "step", F.array_join("observed", ",").alias("observed"))


# ---- P14, M16, M20, M21 -----------------------------------------------------------------------------

@register("keep_observed_cells", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END AS o_totalprice FROM orders""",
          doubles=("o_totalprice",), note="P14: the value where the mask says observed, else the sample")
def _p14(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3 != 0).cast("int").alias("mask_o_totalprice"),
                                         F.col("o_custkey").cast("double").alias("sample_o_totalprice"))
    return keep_observed(o, ["o_totalprice"], "mask_", "sample_").select("o_orderkey", "o_totalprice")


@register("binary_confusion", """WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS truth,
  CASE WHEN o_totalprice >= (SELECT avg(o_totalprice) FROM orders) THEN 1 ELSE 0 END AS pred FROM orders)
SELECT CAST(t.v AS INT) AS truth, CAST(p.v AS INT) AS pred, (SELECT count(*) FROM x WHERE truth = t.v AND pred = p.v) / CAST((SELECT count(*) FROM x WHERE truth = t.v) AS DOUBLE) AS share
FROM (VALUES (0), (1)) t(v), (VALUES (0), (1)) p(v)""", doubles=("share",), note="M16: class-normalised confusion of a price rule")
def _m16(spark, sf):
    o = read(spark, sf, "orders")
    mean = o.agg(F.avg("o_totalprice")).first()[0]
    cells = o.select(F.lit("done").alias("col"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("truth"),
                     F.when(F.col("o_totalprice") >= mean, 0.9).otherwise(0.2).alias("pred"), F.lit(True).alias("is_target"))
    return binary_confusion(cells, spark.createDataFrame([("done", "binary", 0.0, 1.0, 2)], "name string, type string, lower double, upper double, dim int"))


_TYPED = {"l_linenumber": ("ordinal", 1.0, 7.0, 7, "l_linenumber + l_partkey % 3"), "l_tax": ("continuous", 0.0, 0.08, 1, "l_tax + l_discount / 4"),
          "l_quantity": ("categorical", 1.0, 50.0, 50, "l_quantity + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END")}
_TYPED_SQL = {"ordinal": "abs(rint_pred - truth) / {3}", "continuous": "((pred - truth) / ({2}::DOUBLE - {1}::DOUBLE)) * ((pred - truth) / ({2}::DOUBLE - {1}::DOUBLE))",
              "categorical": "CASE WHEN rint_pred <> truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}


@register("error_by_type", " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{v[0]}' AS type, target AS was_missing, {'sqrt(avg(e))' if v[0] == 'continuous' else 'avg(e)'} AS error FROM (SELECT target, {_TYPED_SQL[v[0]].format(*v)} AS e "
    f"FROM (SELECT l_orderkey % 4 = 1 AS target, CAST({c} AS DOUBLE) AS truth, CAST({v[4]} AS DOUBLE) AS pred, round_even(CAST({v[4]} AS DOUBLE), 0) AS rint_pred FROM lineitem)) GROUP BY target"
    for c, v in _TYPED.items()), doubles=("error",), note="M20: the error that suits each kind of column, observed and missing cells apart")
def _m20(spark, sf):
    li = read(spark, sf, "lineitem")
    cells = li.select((F.col("l_orderkey") % 4 == 1).alias("is_target"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("col"), F.col(c).cast("double").alias("truth"), F.expr(v[4]).cast("double").alias("pred")) for c, v in _TYPED.items()])).alias("x")).select("is_target", "x.*")
    return error_by_type(cells, spark.createDataFrame([(c, *v[:4]) for c, v in _TYPED.items()], "name string, type string, lower double, upper double, dim int"))


@register("item_difficulty", "SELECT event_type AS col, avg(1 - value) AS difficulty FROM events GROUP BY 1", doubles=("difficulty",), note="M21")
def _m21(spark, sf):
    return item_difficulty(read(spark, sf, "events").select(F.col("event_type").alias("col"), F.col("value").alias("pred")))


# ---- A11, A23, A37, A38 -------------------------------------------------------------------------------

ORDER = ("overall", "c_mktsegment_priv", "c_mktsegment_dis")
_BEST = f"""WITH runs AS MATERIALIZED ({_runs_sql()}),
best AS (SELECT model_name FROM runs WHERE metric = 'F1' AND subgroup = 'overall' AND null_imputer_name = 'median-mode' GROUP BY 1 ORDER BY avg(metric_value) DESC LIMIT 1)
SELECT null_imputer_name, model_name, dataset_part, subgroup, metric, metric_value, model_name || '__' || null_imputer_name || '_' || experiment_seed AS comparison,
  CAST(CASE subgroup {' '.join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(ORDER))} ELSE {len(ORDER)} END AS INT) AS subgroup_order,
  'MNAR-' || regexp_extract(dataset_part, '(MCAR|MAR|MNAR)', 1) AS setting
FROM runs WHERE model_name IN (SELECT model_name FROM best)"""


@register("best_model_rows", _BEST, doubles=("metric_value",), note="A11, A23, A37, A38: rows of the best model with their labels")
def _a11(spark, sf):
    rows = _l8(spark, sf)
    marks = rows.where("metric = 'F1' AND subgroup = 'overall' AND null_imputer_name = 'median-mode'")
    best = M.best_model(marks.groupBy("dataset_name", "model_name").agg(F.avg("metric_value").alias("f1_score")), ["dataset_name"])
    kept = R.best_model_filter(rows, best).withColumns({"train_strategy": F.lit("MNAR"), "test_strategy": F.regexp_extract("dataset_part", "(MCAR|MAR|MNAR)", 1)})
    named = R.setting_dimension(R.display_order(R.comparison_name(kept), "subgroup", ORDER))
    return named.select("null_imputer_name", "model_name", "dataset_part", "subgroup", "metric", "metric_value", "comparison", "subgroup_order", "setting")
