"""Queries for cell-wise injection, resampling, encoders, repair sets and the
statistic-imputer variants -- each with a DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_key, sql_hash_unit
from ..operators.encode import ColumnScaler, OrdinalCodes, sql_ordinal_encode
from ..operators.impute.repairs import fit_repairs, repair_table, sql_repair_table
from ..operators.impute.simple import SimpleImputer, sql_num_stat, sql_rank_value
from ..operators.inject import inject, sql_inject
from ..operators.inject_cells import bootstrap, poisson_bars, random_cells, sql_random_cells, systematic_rates
from ..operators.split import TRAIN, sql_train_test_split, train_test_split
from ..sources.tables import DATASETS, base_sql, load, read
from .catalog import register
from .scenarios import scenario_steps

SEED = 100
ORD = DATASETS["orders"]
FEATS = list(ORD["numeric"]) + list(ORD["categorical"])
BASE = base_sql("orders")

# ---- J10/J11 -----------------------------------------------------------------------------

RANDOM_RATES = {c: 0.2 for c in FEATS}
# Stand-in feature importances for the systematic mechanism.
IMPORTANCE = {"o_totalprice": 0.5, "c_acctbal": 0.1, "o_orderpriority": 0.3, "c_nation": -0.1}
SYSTEMATIC_RATES = systematic_rates(IMPORTANCE, 0.2)


@register("inject_random_cells", f"SELECT row_id, {', '.join(FEATS)} FROM ({sql_random_cells(BASE, RANDOM_RATES, SEED)})",
          doubles=ORD["numeric"])
def _j10(spark, sf):
    return random_cells(load(spark, sf, "orders").df, RANDOM_RATES, SEED, guard=False).select("row_id", *FEATS)


@register("inject_systematic_cells",
          f"SELECT row_id, {', '.join(FEATS)} FROM ({sql_random_cells(BASE, SYSTEMATIC_RATES, SEED)})",
          doubles=ORD["numeric"])
def _j11(spark, sf):
    return random_cells(load(spark, sf, "orders").df, SYSTEMATIC_RATES, SEED, guard=False).select("row_id", *FEATS)


@register("inject_random_cells_guarded",
          f"SELECT row_id, {', '.join(FEATS)} FROM ({sql_random_cells(BASE, {c: 0.7 for c in FEATS}, SEED, guard=True)})",
          doubles=ORD["numeric"])
def _j12(spark, sf):
    return random_cells(load(spark, sf, "orders").df, {c: 0.7 for c in FEATS}, SEED, guard=True).select("row_id", *FEATS)


# ---- J16 bootstrap ---------------------------------------------------------------------

def _poisson_case(u: str) -> str:
    bars = poisson_bars()
    return "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(bars)) + f" ELSE {len(bars)} END"


@register("bootstrap_copies",
          f"SELECT row_id, CAST(copies AS INTEGER) AS copies FROM (SELECT row_id, "
          f"{_poisson_case(sql_hash_unit(sql_hash_key(SEED, 'boot:0', 'row_id')))} AS copies FROM ({BASE})) WHERE copies > 0")
def _j16(spark, sf):
    b = bootstrap(load(spark, sf, "orders").df, SEED)
    return b.groupBy("row_id").agg(F.count("*").cast("int").alias("copies"))


# ---- E2/E15 encoders -----------------------------------------------------------------------

_TRAIN = f"SELECT * FROM ({sql_train_test_split(BASE, SEED, 0.2)}) WHERE part = '{TRAIN}'"
_SPLIT = sql_train_test_split(BASE, SEED, 0.2)


def _ordinal_sql():
    s = f"SELECT row_id, part, {', '.join(ORD['categorical'])} FROM ({_SPLIT})"
    for c in ORD["categorical"]:
        s = sql_ordinal_encode(s, c, _TRAIN)
    return s


@register("encode_ordinal_codes", _ordinal_sql(), doubles=tuple(ORD["categorical"]))
def _e2(spark, sf):
    spec = load(spark, sf, "orders")
    split = train_test_split(spec.df, SEED, 0.2)
    codes = OrdinalCodes.fit(split.where(F.col("part") == TRAIN), list(spec.categorical))
    return codes.encode(split.select("row_id", "part", *spec.categorical))


def _zscore_sql():
    sel = ", ".join(
        f"({c} - (SELECT avg({c}) FROM ({_TRAIN}))) / coalesce(nullif((SELECT stddev_pop({c}) FROM ({_TRAIN})), 0), 1) AS {c}"
        for c in ORD["numeric"])
    return f"SELECT row_id, part, {sel} FROM ({_SPLIT})"


@register("encode_zscore", _zscore_sql(), doubles=tuple(ORD["numeric"]))
def _e15(spark, sf):
    spec = load(spark, sf, "orders")
    split = train_test_split(spec.df, SEED, 0.2)
    scaler = ColumnScaler.fit(split.where(F.col("part") == TRAIN), list(spec.numeric), "zscore")
    return scaler.transform(split.select("row_id", "part", *spec.numeric))


# ---- I10-I13 ------------------------------------------------------------------------------

_MCAR = sql_inject(f"SELECT *, 'all' AS part FROM ({BASE})", scenario_steps("orders", "MCAR3"), SEED)


def _injected(spark, sf):
    spec = load(spark, sf, "orders")
    return spec, inject(spec.df.withColumn("part", F.lit("all")), {"all": scenario_steps("orders", "MCAR3")}, SEED)


@register("repair_candidates",
          sql_repair_table(f"SELECT * FROM ({_MCAR})", f"SELECT * FROM ({_MCAR})", ORD["numeric"], ORD["categorical"]),
          doubles=tuple(ORD["numeric"]))
def _i13(spark, sf):
    spec, df = _injected(spark, sf)
    return repair_table(df, fit_repairs(df, spec.numeric, spec.categorical), spec.features)


def _pct_sql():
    src = f"SELECT * FROM ({_MCAR})"
    repl = [f"coalesce(o_totalprice, {sql_num_stat('o_totalprice', 'percentile', src, 25)}) AS o_totalprice",
            f"coalesce(c_acctbal, {sql_num_stat('c_acctbal', 'grid', src, 75)}) AS c_acctbal"]
    repl += [f"coalesce({c}, {sql_rank_value(c, src, 2)}) AS {c}" for c in ORD["categorical"]]
    return f"SELECT row_id, {', '.join(repl)} FROM ({src})"


@register("impute_percentile_grid_rank", _pct_sql(), doubles=tuple(ORD["numeric"]))
def _i10(spark, sf):
    spec, df = _injected(spark, sf)
    p = SimpleImputer("percentile", "rank", p=25, cat_rank=2, median_method="exact").fit(df, ["o_totalprice"], spec.categorical)
    g = SimpleImputer("grid", "constant", p=75).fit(df, ["c_acctbal"], [])
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in {**p.stats, **g.stats}.items()}).select(
        "row_id", *spec.features)


# ---- T4/T7 splits, P12 integrity, E9/E14/E20 ------------------------------------------------

from ..operators.split import kfold, three_way_split  # noqa: E402
from ..functions.hashing import sql_hash_index  # noqa: E402


def _three_way_sql():
    tkey = sql_hash_key(SEED, "split", "row_id")
    vkey = sql_hash_key(SEED + 1, "val", "row_id")
    return f"""
WITH b AS (SELECT row_id, row_number() OVER (ORDER BY {tkey}) AS rt, count(*) OVER () AS n FROM ({BASE})),
t AS (SELECT *, rt <= CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS is_test FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY {vkey}) AS rv, count(*) OVER () AS m FROM t WHERE NOT is_test)
SELECT row_id, 'X_test' AS part FROM t WHERE is_test
UNION ALL
SELECT row_id, CASE WHEN rv <= CAST(ceil(m * least(CAST(0.1 AS DOUBLE) / (1.0 - CAST(0.2 AS DOUBLE)), 1.0)) AS BIGINT)
  THEN 'X_val' ELSE 'X_train_val' END AS part FROM r"""


@register("three_way_split", _three_way_sql())
def _t4(spark, sf):
    return three_way_split(load(spark, sf, "orders").df, SEED, 0.2, 0.1).select("row_id", "part")


@register("kfold_assignment",
          f"SELECT row_id, CAST({sql_hash_index(sql_hash_key(SEED, 'fold', 'row_id'), 3)} AS INTEGER) AS fold FROM ({BASE})")
def _t7(spark, sf):
    return kfold(load(spark, sf, "orders").df, SEED, 3).select("row_id", "fold")


@register("key_integrity", """
WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal >= 0)
SELECT CAST(k AS BIGINT) AS key, 'left_only' AS side FROM l ANTI JOIN r USING (k)
UNION ALL SELECT CAST(k AS BIGINT) AS key, 'right_only' AS side FROM r ANTI JOIN l USING (k)""")
def _p12(spark, sf):
    """Customers with an urgent order against customers without debt: keys miss on both sides."""
    from ..operators.nullops import integrity_violations
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("long").alias("key")).distinct()
    c = read(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("long").alias("key")).distinct()
    return integrity_violations(o, c, "key")


_MINMAX = ", ".join(
    f"({c} - (SELECT min({c}) FROM ({_TRAIN}))) / ((SELECT max({c}) FROM ({_TRAIN})) - (SELECT min({c}) FROM ({_TRAIN})) "
    f"+ CAST(1e-6 AS DOUBLE)) AS {c}" for c in ORD["numeric"])


@register("encode_minmax", f"SELECT row_id, part, {_MINMAX} FROM ({_SPLIT})", doubles=tuple(ORD["numeric"]))
def _e14(spark, sf):
    spec = load(spark, sf, "orders")
    split = train_test_split(spec.df, SEED, 0.2)
    sc = ColumnScaler.fit(split.where(F.col("part") == TRAIN), list(spec.numeric), "minmax", eps=1e-6)
    return sc.transform(split.select("row_id", "part", *spec.numeric))


# The order-priority levels (a declared domain, no distinct job)
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_hot_sql():
    cols = ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS " + chr(34) + f"o_orderpriority_{v}" + chr(34)
                     for v in PRIORITY_LEVELS)
    return f"SELECT row_id, {cols} FROM ({BASE})"


@register("one_hot_priority", _one_hot_sql())
def _e9(spark, sf):
    from ..operators.encode import one_hot_columns
    return one_hot_columns(load(spark, sf, "orders").df.select("row_id", "o_orderpriority"), "o_orderpriority",
                           PRIORITY_LEVELS).drop("o_orderpriority")


_VARS = ["o_totalprice", "c_acctbal", "label", "o_orderpriority", "c_nation"]


def _vars_sql():
    arms = []
    for c in _VARS:
        if c in ("o_orderpriority", "c_nation"):
            arms.append(f"SELECT '{c}' AS name, 'categorical' AS type, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, "
                        f"count(DISTINCT {c}) AS n_distinct, count(*) = count({c}) AS always_observed, FALSE AS target FROM ({BASE})")
        else:
            arms.append(
                f"SELECT '{c}' AS name, CASE WHEN bool_and({c} = floor({c})) AND min({c}) >= 0 AND max({c}) <= 1 THEN 'binary' "
                f"WHEN bool_and({c} = floor({c})) THEN 'categorical' ELSE 'continuous' END AS type, "
                f"CAST(min({c}) AS DOUBLE) AS lower, CAST(max({c}) AS DOUBLE) AS upper, count(DISTINCT {c}) AS n_distinct, "
                f"count(*) = count({c}) AS always_observed, {'TRUE' if c == 'label' else 'FALSE'} AS target FROM ({BASE})")
    return " UNION ALL ".join(arms)


@register("infer_variables", _vars_sql(), doubles=("lower", "upper"))
def _e20(spark, sf):
    from ..operators.encode import infer_variables
    return infer_variables(load(spark, sf, "orders").df, _VARS, target="label")


from ..operators.split import capped_slices  # noqa: E402


def _slices_sql(val_size):
    key = sql_hash_key(SEED, "slices", "row_id")
    test = f"CAST(floor(CAST(0.3 AS DOUBLE) * (n - {val_size})) AS BIGINT)"
    return f"""
WITH r AS (SELECT row_id, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS n FROM ({BASE}))
SELECT row_id, CASE WHEN rn <= {test} THEN 'X_test' WHEN rn <= {test} + {val_size} THEN 'X_val' ELSE 'X_train_val' END AS part FROM r"""


# Fixed value: validation size of the slices (the operator's parameter; its row cap is off).
SLICE_VAL = 1000


@register("capped_slices", _slices_sql(SLICE_VAL))
def _t5(spark, sf):
    return capped_slices(load(spark, sf, "orders").df, SEED, SLICE_VAL).select("row_id", "part")
