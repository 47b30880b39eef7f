"""Rank correlation matrices (A25, A33), mixed tables as slots (E17, E18) and acquisition by
gains (Q0, Q3, Q4, Q7, Q8, Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_key
from ..operators import acquire as Q
from ..operators.correlation import rank_correlations, sql_rank_correlations
from ..operators.mixed import Layout
from ..operators.split import element_split
from ..sources.tables import read
from .catalog import register
from .q_graph import _CELLS, _OBS, SEED
from .q_reports import _w, report_store

# ---- A25, A33 -----------------------------------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("spearman_lineitem", sql_rank_correlations("SELECT * FROM lineitem", LINE), doubles=("spearman",), note="A33: all pairs, the whole table as one group")
def _a33(spark, sf):
    return rank_correlations(read(spark, sf, "lineitem"), LINE)


@register("spearman_by_flag", sql_rank_correlations("SELECT * FROM lineitem", LINE, ["l_returnflag", "l_linestatus"], ["l_extendedprice"]), doubles=("spearman",),
          note="A25: with a target, per group")
def _a25_groups(spark, sf):
    return rank_correlations(read(spark, sf, "lineitem"), LINE, ["l_returnflag", "l_linestatus"], ["l_extendedprice"])


_METRICS = ["f1_score", "precision", "recall"]
_BY = ["evaluation_scenario", "dataset_part"]


@register("metric_spearman_matrix", _w("SELECT * FROM (" + sql_rank_correlations("SELECT * FROM store WHERE column_type = 'categorical'", _METRICS, _BY) + ")"),
          doubles=("spearman",), note="A25: metric rows by setting and test part")
def _a25_store(spark, sf):
    return rank_correlations(report_store(spark, sf).where("column_type = 'categorical'"), _METRICS, _BY)


# ---- E17, E18 -----------------------------------------------------------------------------------

# Segments and priorities of the generated tables, bounds of a balance.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LAYOUT = Layout([("in_debt", "binary", None, "int"), ("c_acctbal", "continuous", (-1000.0, 10000.0), "double"),
                 ("c_mktsegment", "categorical", SEGMENTS, "string"), ("c_nationkey", "categorical", tuple(str(i) for i in range(25)), "int")])


def _mixed(spark, sf):
    """Customers; a seventh of the balances and of the segments are unknown."""
    c = read(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("in_debt"), F.when(F.col("c_custkey") % 7 != 3, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_custkey") % 7 != 5, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")


_MIXED = ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS in_debt, CASE WHEN c_custkey % 7 <> 3 THEN c_acctbal END AS c_acctbal, "
          "CASE WHEN c_custkey % 7 <> 5 THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
_SLOTS = " UNION ALL ".join([f"SELECT c_custkey, {s.start + i} AS slot, CAST({e} AS DOUBLE) AS value FROM m" for s in LAYOUT.slots
                             for i, e in enumerate({"binary": [s.name], "continuous": [f"({s.name} - {s.lower!r}::DOUBLE) / {s.scale!r}::DOUBLE"]}.get(
                                 s.kind, [f"CASE WHEN CAST({s.name} AS VARCHAR) = '{v}' THEN 1 WHEN {s.name} IS NOT NULL THEN 0 END" for v in s.levels]))])


@register("mixed_slots", f"WITH m AS ({_MIXED}) {_SLOTS}", doubles=("value",), note="E17: a mixed table as slots")
def _e17(spark, sf):
    return LAYOUT.process(_mixed(spark, sf)).select("c_custkey", F.posexplode("slots").alias("slot", "value"))


@register("mixed_round_trip", _MIXED, doubles=("c_acctbal",), note="E17: slots turned back are the table")
def _e17_back(spark, sf):
    return LAYOUT.revert(LAYOUT.process(_mixed(spark, sf)))


@register("mixed_masks", f"""WITH m AS ({_MIXED})
SELECT c_custkey, {' + '.join(f'CASE WHEN {s.name} IS NOT NULL THEN {s.width} ELSE 0 END' for s in LAYOUT.slots)} AS observed_slots,
  concat({', '.join(f"CASE WHEN {s.name} IS NOT NULL THEN '1' ELSE '0' END" for s in LAYOUT.slots)}) AS squashed FROM m""", note="E18: masks widened and squashed")
def _e18(spark, sf):
    wide = _mixed(spark, sf).withColumn("seen", LAYOUT.observed()).withColumn("wide", LAYOUT.expand_mask("seen"))
    bits = F.array_join(F.transform(LAYOUT.squash_mask("wide"), lambda x: x.cast("int").cast("string")), "")
    return wide.select("c_custkey", F.size(F.filter("wide", lambda x: x)).alias("observed_slots"), bits.alias("squashed"))


# ---- Q0, Q7, Q8, Q10 ------------------------------------------------------------------------------

STEPS = 3
STRATEGIES = ("random", "global", "row")


def _replayed(spark, sf):
    ev = read(spark, sf, "events")
    cells = ev.groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id")).agg(F.avg("value").alias("value"))
    initial = element_split(cells, SEED, 0.5, "row_id", "col_id", "o").where("o").drop("o")

    def column_means(observed, rest):
        means = observed.groupBy("strategy", "col_id").agg(F.avg("value").alias("imputed"))
        return rest.join(means, ["strategy", "col_id"])

    return cells, Q.replay_strategies(cells, initial, STEPS, SEED, column_means, STRATEGIES)


def _replay_sql(last: str) -> str:
    key = "CAST(row_id AS VARCHAR) || ':' || CAST(col_id AS VARCHAR)"
    names = ", ".join(f"'{s}'" for s in STRATEGIES)
    ctes = [f"cells AS MATERIALIZED ({_CELLS})", f"every AS (SELECT unnest([{names}]) AS strategy, * FROM cells)",
            f"o0 AS MATERIALIZED (SELECT unnest([{names}]) AS strategy, row_id, col_id, value, 0 AS step FROM ({_OBS}))"]
    for s in range(STEPS + 1):
        if s:
            tie = sql_hash_key(SEED, f"acq:{s - 1}", key)
            ctes.append(f"""p{s} AS MATERIALIZED (SELECT strategy, row_id, col_id, value, {s} AS step FROM (
              SELECT e.*, row_number() OVER (PARTITION BY e.strategy, e.row_id ORDER BY CASE e.strategy WHEN 'global' THEN g.gain WHEN 'row' THEN abs(m.m - r.s) END DESC NULLS LAST,
                CASE WHEN e.strategy = 'random' THEN {tie.replace('row_id', 'e.row_id').replace('col_id', 'e.col_id')} END, e.col_id) AS n
              FROM (SELECT * FROM every e ANTI JOIN o{s - 1} o USING (strategy, row_id, col_id)) e
              LEFT JOIN (SELECT strategy, col_id, var_pop(value) AS gain FROM o{s - 1} GROUP BY ALL) g ON g.strategy = e.strategy AND g.col_id = e.col_id
              LEFT JOIN (SELECT strategy, col_id, avg(value) AS m FROM o{s - 1} GROUP BY ALL) m ON m.strategy = e.strategy AND m.col_id = e.col_id
              LEFT JOIN (SELECT strategy, row_id, avg(value) AS s FROM o{s - 1} GROUP BY ALL) r ON r.strategy = e.strategy AND r.row_id = e.row_id) WHERE n = 1)""")
            ctes.append(f"o{s} AS MATERIALIZED (SELECT * FROM o{s - 1} UNION ALL SELECT * FROM p{s})")
        ctes.append(f"""i{s} AS MATERIALIZED (SELECT e.strategy, {s} AS step, e.col_id, (m.m - e.value) * (m.m - e.value) AS e2 FROM (SELECT * FROM every ANTI JOIN o{s} USING (strategy, row_id, col_id)) e
          JOIN (SELECT strategy, col_id, avg(value) AS m FROM o{s} GROUP BY ALL) m ON m.strategy = e.strategy AND m.col_id = e.col_id)""")
    every = " UNION ALL ".join(f"SELECT * FROM i{s}" for s in range(STEPS + 1))
    ctes.append(f"""per AS (SELECT g.strategy, g.step, g.col_id, g.n, coalesce(x.e2, 0) AS e2 FROM (SELECT strategy, step, col_id, n FROM (SELECT unnest([{names}]) AS strategy),
      (SELECT unnest(range({STEPS + 1})) AS step), (SELECT col_id, count(value) AS n FROM cells GROUP BY 1)) g
      LEFT JOIN (SELECT strategy, step, col_id, sum(e2) AS e2 FROM ({every}) GROUP BY ALL) x ON x.strategy = g.strategy AND x.step = g.step AND x.col_id = g.col_id)""")
    ctes.append("""metric AS MATERIALIZED (SELECT strategy, CAST(step AS INT) AS step, CAST(col_id AS VARCHAR) AS "column", sqrt(e2 / n) AS rmse, CAST(n AS BIGINT) AS n FROM per
      UNION ALL SELECT strategy, CAST(step AS INT) AS step, 'all' AS "column", sqrt(sum(e2) / sum(n)) AS rmse, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY ALL)""")
    return f"WITH {', '.join(ctes)} {last}"


@register("acquisition_metrics", _replay_sql("SELECT * FROM metric"), doubles=("rmse",), note="Q7, Q10: error per strategy, step and column, and 'all'")
def _q7(spark, sf):
    cells, (_, _, imputed) = _replayed(spark, sf)
    return Q.step_metrics(cells, imputed)


@register("acquisition_auic", _replay_sql("SELECT strategy, sum(rmse) AS auic FROM metric WHERE \"column\" = 'all' GROUP BY strategy"), doubles=("auic",), note="Q8 on the replay")
def _q8(spark, sf):
    cells, (_, _, imputed) = _replayed(spark, sf)
    return Q.auic(Q.step_metrics(cells, imputed).where("column = 'all'"), "rmse")


@register("acquisition_choices", _replay_sql(" UNION ALL ".join(f"SELECT strategy, row_id, col_id, CAST(step AS INT) AS step FROM p{s}" for s in range(1, STEPS + 1))),
          note="Q0, Q10: the feature that every strategy takes for each row and step")
def _q10_choices(spark, sf):
    return _replayed(spark, sf)[1][0].select("strategy", "row_id", "col_id", "step")
