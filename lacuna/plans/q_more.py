"""Operators that no other query runs, each on the given tables with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_unit, sql_hash_key, sql_hash_unit
from ..operators import nullops as N
from ..operators import report as R
from ..operators.encode import ColumnScaler, OneHotScale, OrdinalCodes, expand_mask, shift_counts, thermometer, thermometer_inverse
from ..operators.impute.simple import SimpleImputer, impute_by_type, impute_targets_only, sql_num_stat, sql_rank_value
from ..operators.inject import inject, sql_inject
from ..operators.score.long_metrics import per_variable_metrics
from ..operators.split import TRAIN, sql_train_test_split, train_test_split
from ..sources.files import paired_clean_dirty
from ..sources.tables import DATASETS, base_sql, load
from .catalog import register
from .experiment import drop_sensitive, impute, prepare_parts, sql_impute, sql_prepare_parts
from .scenarios import scenario_steps

SEED = 100
ORD = DATASETS["orders"]
NUM, CAT = list(ORD["numeric"]), list(ORD["categorical"])
FEATS = NUM + CAT
BASE = base_sql("orders")
SPLIT = sql_train_test_split(BASE, SEED, 0.2)
TRAIN_SQL = f"SELECT * FROM ({SPLIT}) WHERE part = '{TRAIN}'"
HOLES = sql_inject(f"SELECT *, 'all' AS part FROM ({BASE})", scenario_steps("orders", "MCAR3"), SEED)


def _orders(spark, sf):
    return load(spark, sf, "orders")


def _holes(spark, sf):
    spec = _orders(spark, sf)
    return spec, inject(spec.df.withColumn("part", F.lit("all")), {"all": scenario_steps("orders", "MCAR3")}, SEED)


# ---- S2, S3, S20 ---------------------------------------------------------------------------

@register("subsampled_table", f"SELECT row_id, {', '.join(FEATS)} FROM ({base_sql('orders', 500)})", doubles=tuple(NUM))
def _s3(spark, sf):
    return load(spark, sf, "orders", subsample=500).df.select("row_id", *FEATS)


@register("filtered_table", f"SELECT row_id, {', '.join(FEATS)} FROM ({BASE}) WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000",
          doubles=tuple(NUM))
def _s2(spark, sf):
    return load(spark, sf, "orders", where="c_mktsegment = 'BUILDING' AND o_totalprice > 100000").df.select("row_id", *FEATS)


@register("paired_clean_dirty", f"SELECT h.row_id, " + ", ".join(f"h.{c} IS NULL AS missing_{c}" for c in FEATS) + f" FROM ({HOLES}) h")
def _s20(spark, sf):
    spec, dirty = _holes(spark, sf)
    return paired_clean_dirty(spec.df, dirty, FEATS).select("row_id", *[f"missing_{c}" for c in FEATS])


# ---- P1, P7, P11, P13, P16, P17, P20, P21 -----------------------------------------------------

@register("drop_sensitive_columns", f"SELECT * EXCLUDE (c_mktsegment, n_regionkey) FROM ({SPLIT})", doubles=tuple(NUM))
def _p1(spark, sf):
    spec = _orders(spark, sf)
    return drop_sensitive(spec, train_test_split(spec.df, SEED, 0.2))[0]


@register("null_mask_patterns", "SELECT " + ", ".join(f"CAST({c} IS NOT NULL AS INTEGER) AS {c}" for c in FEATS)
          + f", count(*) AS n FROM ({HOLES}) GROUP BY ALL")
def _p7(spark, sf):
    _, df = _holes(spark, sf)
    return N.null_mask(df, FEATS).groupBy(*FEATS).agg(F.count(F.lit(1)).alias("n"))


@register("restrict_to_complete", f"SELECT row_id, label FROM ({HOLES}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATS))
def _p11(spark, sf):
    spec, df = _holes(spark, sf)
    return N.restrict_to(spec.df, N.complete_rows(df, FEATS)).select("row_id", "label")


@register("combine_first", f"SELECT row_id, {', '.join(FEATS)} FROM ({BASE})", doubles=tuple(NUM))
def _p13(spark, sf):
    spec, df = _holes(spark, sf)
    return N.combine_first(df, spec.df, FEATS).select("row_id", *FEATS)


@register("fill_missing", "SELECT row_id, " + ", ".join([f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in NUM] + [f"coalesce({c}, '') AS {c}" for c in CAT])
          + f" FROM ({HOLES})", doubles=tuple(NUM))
def _p16(spark, sf):
    _, df = _holes(spark, sf)
    return N.fill_missing(df, numeric=NUM, categorical=CAT).select("row_id", *FEATS)


_PICK = sql_hash_unit(sql_hash_key(SEED, "overwrite", "row_id"))


@register("overwrite_cells", f"SELECT row_id, CASE WHEN {_PICK} < 0.1 THEN -1.0::DOUBLE ELSE o_totalprice END AS o_totalprice, "
          f"CASE WHEN {_PICK} < 0.1 THEN 1 ELSE CAST(o_totalprice IS NOT NULL AS INTEGER) END AS mask_o_totalprice FROM ({HOLES})",
          doubles=("o_totalprice",))
def _p17(spark, sf):
    _, df = _holes(spark, sf)
    masked = df.withColumn("mask_o_totalprice", F.col("o_totalprice").isNotNull().cast("int"))
    updates = (df.where(hash_unit(hash_key(SEED, "overwrite", "row_id")) < 0.1)
               .select("row_id", F.lit("o_totalprice").alias("col"), F.lit("-1.0").alias("value")))
    return N.overwrite_cells(masked, updates, ["o_totalprice"], mask_prefix="mask_").select("row_id", "o_totalprice", "mask_o_totalprice")


@register("range_violations", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, count({c}) AS observed, 0 AS infinities, 0 AS non_integral, "
    f"min({c}) < {lo} OR max({c}) > {hi} AS out_of_range, 'warning' AS severity FROM ({BASE})"
    for c, lo, hi in (("o_totalprice", "0.0", "1000000.0"), ("c_acctbal", "0.0", "10000.0"))), doubles=("min", "max"))
def _p20(spark, sf):
    return N.range_violations(_orders(spark, sf).df, {"o_totalprice": (0.0, 1e6), "c_acctbal": (0.0, 1e4)})


@register("mask_check", f"SELECT TRUE AS only_0_and_1, count(*) AS n_rows, TRUE AS right_width FROM ({BASE})")
def _p21(spark, sf):
    _, df = _holes(spark, sf)
    return N.mask_check(N.null_mask(df, FEATS), FEATS)


# ---- I6, I7, I9, I31 -------------------------------------------------------------------------

_PARTS = sql_prepare_parts("orders", FEATS, "exp1_mcar3", SEED, ORD["test_fraction"])


def _imputed(spark, sf, name):
    spec = _orders(spark, sf)
    return impute(spec, prepare_parts(spec, "exp1_mcar3", SEED), name)[0].select("part", "row_id", *FEATS)


def _imputed_sql(name):
    return (f"WITH parts AS MATERIALIZED ({_PARTS}) SELECT part, row_id, {', '.join(FEATS)} FROM "
            f"({sql_impute('SELECT * FROM parts', name, NUM, CAT, ORD['lower_bounds'])})")


@register("impute_zero_dummy", _imputed_sql("zero-dummy"), doubles=tuple(NUM))
def _i6(spark, sf):
    return _imputed(spark, sf, "zero-dummy")


@register("impute_declared_minimum", _imputed_sql("min-mode"), doubles=tuple(NUM))
def _i7(spark, sf):
    return _imputed(spark, sf, "min-mode")


@register("impute_by_type_table", "SELECT row_id, " + ", ".join(
    [f"coalesce({c}, {sql_num_stat(c, 'mean', HOLES)}) AS {c}" for c in NUM] + [f"coalesce({c}, {sql_rank_value(c, HOLES)}) AS {c}" for c in CAT])
    + f" FROM ({HOLES})", doubles=tuple(NUM))
def _i9(spark, sf):
    from ..operators.encode import infer_variables
    spec, df = _holes(spark, sf)
    return impute_by_type(df, infer_variables(df, FEATS)).select("row_id", *FEATS)


@register("impute_targets_only", f"SELECT row_id, {sql_num_stat('o_totalprice', 'median', HOLES)} AS o_totalprice, c_acctbal FROM ({HOLES})",
          doubles=tuple(NUM))
def _i31(spark, sf):
    _, df = _holes(spark, sf)
    return impute_targets_only(df, ["o_totalprice"], SimpleImputer("median"), NUM, CAT).select("row_id", *NUM)


# ---- E4, E10, E16, E18, E21, E22 ---------------------------------------------------------------

@register("ordinal_round_trip", f"SELECT row_id, {', '.join(CAT)} FROM ({BASE})")
def _e4(spark, sf):
    df = _orders(spark, sf).df.select("row_id", *CAT)
    codes = OrdinalCodes.fit(df, CAT)
    return codes.decode(codes.encode(df))


@register("onehot_drop_first", f"""
WITH tr AS ({TRAIN_SQL}), w AS (SELECT CAST(count(DISTINCT o_orderpriority) - 1 + count(DISTINCT c_nation) - 1 AS INTEGER) AS width,
  min(o_orderpriority) AS p0, min(c_nation) AS n0 FROM tr)
SELECT row_id, part, width, (CASE WHEN o_orderpriority <> p0 AND o_orderpriority IN (SELECT o_orderpriority FROM tr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN c_nation <> n0 AND c_nation IN (SELECT c_nation FROM tr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS total
FROM ({SPLIT}), w""", doubles=("total",))
def _e10(spark, sf):
    split = train_test_split(_orders(spark, sf).df, SEED, 0.2)
    feats = OneHotScale((), tuple(CAT), drop_first=True).fit(split.where(F.col("part") == TRAIN))
    x = split.select("row_id", "part", F.array(*feats.columns()).alias("x"))
    return x.select("row_id", "part", F.size("x").alias("width"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("scale_by_declared_bounds", f"SELECT row_id, (o_totalprice - 0.0::DOUBLE) / 500000.0::DOUBLE AS o_totalprice, "
          f"(c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS c_acctbal FROM ({BASE})", doubles=tuple(NUM))
def _e16(spark, sf):
    df = _orders(spark, sf).df.select("row_id", *NUM)
    return ColumnScaler.fit(df, NUM, "bounds", bounds={"o_totalprice": (0.0, 500000.0), "c_acctbal": (-1000.0, 10000.0)}).transform(df)


@register("expanded_mask", f"SELECT row_id, 5 AS width, CASE WHEN o_orderpriority IS NULL THEN 0 ELSE 5 END AS total FROM ({HOLES})")
def _e18(spark, sf):
    _, df = _holes(spark, sf)
    x = expand_mask(df, "o_orderpriority", 5, "m")
    return x.select("row_id", F.size("m").alias("width"), F.aggregate("m", F.lit(0), lambda a, v: a + v).alias("total"))


@register("thermometer_code", f"SELECT row_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS ones, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS code FROM ({BASE})")
def _e21(spark, sf):
    df = _orders(spark, sf).df.select("row_id", (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("k"))
    x = thermometer(df, "k", 5, "t")
    return thermometer_inverse(x, "t", "code").select("row_id", F.aggregate("t", F.lit(0), lambda a, v: a + v).alias("ones"), "code")


@register("shifted_counts", f"SELECT row_id, label + 1 AS label FROM ({BASE})")
def _e22(spark, sf):
    return shift_counts(_orders(spark, sf).df.select("row_id", "label"), ["label"])


# ---- A35, M13 -----------------------------------------------------------------------------------

@register("strong_correlations", f"""
WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem),
r AS (SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS feature_a, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS feature_b,
  unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_extendedprice, l_discount)]) AS r FROM b)
SELECT * FROM r WHERE abs(r) >= 0.002""", doubles=("r",))
def _a35(spark, sf):
    return R.pearson_matrix(load(spark, sf, "lineitem").df, ["l_quantity", "l_extendedprice", "l_discount"], threshold=0.002)


_GUESS = sql_hash_unit(sql_hash_key(SEED, "guess", "row_id"))
_MIXED = f"""
WITH c AS (
  SELECT 'o_totalprice' AS col, 'continuous' AS kind, o_totalprice AS truth, o_totalprice * (0.9::DOUBLE + 0.2::DOUBLE * {_GUESS}) AS pred FROM ({BASE})
  UNION ALL SELECT 'label', 'binary', CAST(label AS DOUBLE), {_GUESS} FROM ({BASE})
  UNION ALL SELECT 'priority', 'categorical', CAST(left(o_orderpriority, 1) AS DOUBLE), 3.0::DOUBLE FROM ({BASE})
  UNION ALL SELECT 'nation', 'ordinal', CAST(c_nation AS DOUBLE), 12.0::DOUBLE FROM ({BASE})),
g AS (SELECT *, CASE WHEN kind = 'binary' THEN CASE WHEN pred >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE pred END AS p FROM c),
e AS (SELECT *, CASE WHEN kind = 'categorical' THEN CASE WHEN p <> truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE p - truth END AS gap,
  CASE WHEN kind <> 'continuous' THEN CASE WHEN p <> truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS wrong FROM g),
n AS (SELECT *, CASE kind WHEN 'continuous' THEN gap / 500000.0::DOUBLE WHEN 'ordinal' THEN gap / 24.0::DOUBLE ELSE gap END AS scaled FROM e)
SELECT coalesce(col, 'all') AS col, sqrt(avg(gap * gap)) AS rmse, sqrt(avg(scaled * scaled)) AS normalised_rmse, avg(wrong) AS fraction_incorrect,
  1 - avg(wrong) AS accuracy, count(*) AS n FROM n GROUP BY GROUPING SETS ((), (col))"""


@register("mixed_type_metrics", _MIXED, doubles=("rmse", "normalised_rmse", "fraction_incorrect", "accuracy"),
          note="M13-M15: wrong categories and binaries count in the RMSE")
def _m13(spark, sf):
    guess = hash_unit(hash_key(SEED, "guess", "row_id"))
    cell = lambda c, t, p: F.struct(F.lit(c).alias("col"), t.cast("double").alias("truth"), p.cast("double").alias("pred"))
    cells = _orders(spark, sf).df.select("row_id", F.lit(True).alias("is_target"), F.explode(F.array(
        cell("o_totalprice", F.col("o_totalprice"), F.col("o_totalprice") * (0.9 + 0.2 * guess)), cell("label", F.col("label"), guess),
        cell("priority", F.left("o_orderpriority", F.lit(1)), F.lit(3)), cell("nation", F.col("c_nation"), F.lit(12)))).alias("x")).select("row_id", "is_target", "x.*")
    variables = spark.createDataFrame([("o_totalprice", "continuous", 0.0, 500000.0), ("label", "binary", 0.0, 1.0),
                                       ("priority", "categorical", 1.0, 5.0), ("nation", "ordinal", 0.0, 24.0)],
                                      "name string, type string, lower double, upper double")
    return per_variable_metrics(cells, variables)
