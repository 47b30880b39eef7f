"""Imputation scoring (M2-M10): one unpivot + one group-by plan for every
(part, column, subgroup), instead of a loop per column and subgroup.

Input: the long table after injection and imputation, holding per feature ``c``
the imputed value ``c``, the truth ``__real_c`` and the flag ``__miss_c`` (cell
was nulled by injection).  Metric rows exist only where some cell was nulled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import membership, sql_membership

REAL, MISS = "__real_", "__miss_"
KEYS = ["part", "column", "subgroup"]
ABSENT = 1e-9  # share given to a category missing on one side


def with_truth(df: DataFrame, features) -> DataFrame:
    """Keep the clean value beside each feature before injection."""
    return df.withColumns({REAL + c: F.col(c) for c in features})


def with_missing_flags(df: DataFrame, features) -> DataFrame:
    return df.withColumns({MISS + c: F.col(c).isNull() & F.col(REAL + c).isNotNull() for c in features})


def cells(df: DataFrame, columns, sensitive: dict, value_type: str) -> DataFrame:
    """(part, column, subgroup, t, p, miss) for one value type; truth never NULL."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(REAL + c).cast(value_type).alias("t"),
                             F.col(c).cast(value_type).alias("p"), F.col(MISS + c).alias("miss"))
                    for c in columns])
    return (df.select("part", membership(sensitive).alias("groups"), F.explode(arr).alias("x"))
            .where(F.col("x.t").isNotNull())
            .select("part", F.explode("groups").alias("subgroup"), "x.column", "x.t", "x.p", "x.miss"))


def counted_cells(df: DataFrame, columns, sensitive: dict) -> DataFrame:
    """The categorical cells with the number ``n`` of each: rows are counted by their set of
    subgroups first, so a row is dealt to its subgroups as a count, not once per subgroup."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(REAL + c).cast("string").alias("t"),
                             F.col(c).cast("string").alias("p"), F.col(MISS + c).alias("miss"))
                    for c in columns])
    each = df.select("part", membership(sensitive).alias("groups"), F.explode(arr).alias("x")).where(F.col("x.t").isNotNull())
    counts = each.groupBy("part", "groups", "x.column", "x.t", "x.p", "x.miss").agg(F.count("*").alias("n"))
    return counts.select("part", F.explode("groups").alias("subgroup"), "column", "t", "p", "miss", "n")


def categorical_kl(c: DataFrame) -> DataFrame:
    """M4 for scopes 'pred' (nulled cells) and 'total' (all cells of the group), from
    :func:`counted_cells`.

    Per-group totals come from group-bys (one row per group, bounded by the
    spec) joined back, never from a window over the values: a column with many
    distinct values would otherwise land in one task."""
    g = KEYS + ["scope"]
    scoped = c.select(*KEYS, "t", "p", "n", F.explode(F.when(F.col("miss"), F.array(F.lit("pred"), F.lit("total")))
                                                       .otherwise(F.array(F.lit("total")))).alias("scope"))
    sides = scoped.select(*g, F.explode(F.array(
        F.struct(F.col("t").alias("v"), F.col("n").alias("it"), F.lit(0).cast("bigint").alias("ip")),
        F.struct(F.col("p").alias("v"), F.lit(0).cast("bigint").alias("it"), F.col("n").alias("ip")))).alias("s"))
    counts = sides.where(F.col("s.v").isNotNull()).groupBy(*g, F.col("s.v").alias("v")).agg(
        F.sum("s.it").alias("ct"), F.sum("s.ip").alias("cp"))
    tot = counts.groupBy(*g).agg(F.sum("ct").alias("nt"), F.sum("cp").alias("np"))
    shares = counts.join(F.broadcast(tot), g).select(
        *g, F.when(F.col("ct") > 0, F.col("ct") / F.col("nt")).otherwise(F.lit(ABSENT)).alias("pt"),
        F.when(F.col("cp") > 0, F.col("cp") / F.col("np")).otherwise(F.lit(ABSENT)).alias("pq"))
    # KL of the renormalised vectors: (1/SP) sum pt ln(pt/pq) + ln(SQ/SP)
    kl = shares.groupBy(*g).agg(
        F.sum("pt").alias("SP"), F.sum("pq").alias("SQ"),
        F.sum(F.col("pt") * F.log(F.col("pt") / F.col("pq"))).alias("SPL")).select(
        *g, (F.col("SPL") / F.col("SP") + F.log(F.col("SQ") / F.col("SP"))).alias("kl"))
    return (kl.groupBy(*KEYS).pivot("scope", ["pred", "total"]).agg(F.first("kl"))
            .withColumnRenamed("pred", "kl_divergence_pred").withColumnRenamed("total", "kl_divergence_total"))


def score(df: DataFrame, numeric, categorical, sensitive: dict, numeric_kl: bool = True,
          kl_grid: int = 1000) -> DataFrame:
    """Metric rows: part, column_type, column_with_nulls, subgroup, sample_size,
    kl_divergence_pred, kl_divergence_total, rmse, precision, recall, f1_score."""
    out = []
    if numeric:
        nulled = F.coalesce(*[F.when(F.col(MISS + c), F.lit(True)) for c in numeric], F.lit(False))
        m = (cells(df.where(nulled), numeric, sensitive, "double").where("miss").groupBy(*KEYS).agg(
            F.count("*").alias("sample_size"),
            (F.sqrt(F.avg((F.col("t") - F.col("p")) ** 2))
             / F.coalesce(F.nullif(F.stddev_pop("t"), F.lit(0.0)), F.lit(1.0))).alias("rmse")))
        if numeric_kl:
            from .kl import numeric_kl as nkl
            m = m.join(nkl(cells(df, numeric, sensitive, "double"), grid=kl_grid), KEYS, "left")
        else:
            m = m.withColumns({"kl_divergence_pred": F.lit(None).cast("double"),
                               "kl_divergence_total": F.lit(None).cast("double")})
        out.append(m.select(*KEYS, F.lit("numerical").alias("column_type"), "sample_size",
                            "kl_divergence_pred", "kl_divergence_total", "rmse",
                            *[F.lit(None).cast("double").alias(x) for x in ("precision", "recall", "f1_score")]))
    if categorical:
        cc = counted_cells(df, categorical, sensitive)
        acc = cc.where("miss").groupBy(*KEYS).agg(
            F.sum("n").alias("sample_size"),
            (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))
        m = acc.join(categorical_kl(cc), KEYS, "left")
        out.append(m.select(*KEYS, F.lit("categorical").alias("column_type"), "sample_size",
                            "kl_divergence_pred", "kl_divergence_total", F.lit(None).cast("double").alias("rmse"),
                            F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                            F.col("acc").alias("f1_score")))
    res = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return res.withColumnRenamed("part", "dataset_part").withColumnRenamed("column", "column_with_nulls")


# ---- SQL twin ------------------------------------------------------------------

def sql_cells(src: str, columns, sensitive: dict, value_type: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT part, {sql_membership(sensitive)} AS groups, '{c}' AS col, CAST({REAL}{c} AS {value_type}) AS t, "
        f"CAST({c} AS {value_type}) AS p, {MISS}{c} AS miss FROM ({src})" for c in columns)
    return (f"SELECT part, unnest(groups) AS subgroup, col, t, p, miss FROM ({arms}) WHERE t IS NOT NULL")


def sql_categorical_kl(cells_sql: str) -> str:
    return f"""
SELECT part, col, subgroup,
  max(CASE WHEN scope = 'pred' THEN kl END) AS kl_divergence_pred,
  max(CASE WHEN scope = 'total' THEN kl END) AS kl_divergence_total
FROM (
  SELECT part, col, subgroup, scope, sum((pt / spt) * ln((pt / spt) / (pq / spq))) AS kl FROM (
    SELECT *, sum(pt) OVER w AS spt, sum(pq) OVER w AS spq FROM (
      SELECT part, col, subgroup, scope,
        CASE WHEN ct > 0 THEN ct / sum(ct) OVER w ELSE {ABSENT} END AS pt,
        CASE WHEN cp > 0 THEN cp / sum(cp) OVER w ELSE {ABSENT} END AS pq
      FROM (
        SELECT part, col, subgroup, scope, v, sum(it) AS ct, sum(ip) AS cp FROM (
          SELECT part, col, subgroup, s.scope, t AS v, 1 AS it, 0 AS ip FROM ({cells_sql}) c,
            (SELECT 'pred' AS scope UNION ALL SELECT 'total') s WHERE s.scope = 'total' OR c.miss
          UNION ALL
          SELECT part, col, subgroup, s.scope, p AS v, 0 AS it, 1 AS ip FROM ({cells_sql}) c,
            (SELECT 'pred' AS scope UNION ALL SELECT 'total') s WHERE s.scope = 'total' OR c.miss
        ) WHERE v IS NOT NULL GROUP BY ALL
      ) WINDOW w AS (PARTITION BY part, col, subgroup, scope)
    ) WINDOW w AS (PARTITION BY part, col, subgroup, scope)
  ) GROUP BY ALL
) GROUP BY ALL"""


def sql_score(src: str, numeric, categorical, sensitive: dict, numeric_kl_sql=None) -> str:
    arms = []
    if numeric:
        nc = sql_cells(src, numeric, sensitive, "DOUBLE")
        kl = numeric_kl_sql(nc) if numeric_kl_sql else \
            "SELECT NULL::VARCHAR AS part, NULL::VARCHAR AS col, NULL::VARCHAR AS subgroup, NULL::DOUBLE AS kl_divergence_pred, NULL::DOUBLE AS kl_divergence_total WHERE FALSE"
        arms.append(f"""
SELECT m.part AS dataset_part, m.col AS column_with_nulls, m.subgroup, 'numerical' AS column_type, m.sample_size,
  k.kl_divergence_pred, k.kl_divergence_total, m.rmse,
  NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1_score
FROM (SELECT part, col, subgroup, count(*) AS sample_size,
        sqrt(avg((t - p) * (t - p))) / coalesce(nullif(stddev_pop(t), 0), 1) AS rmse
      FROM ({nc}) WHERE miss GROUP BY ALL) m
LEFT JOIN ({kl}) k USING (part, col, subgroup)""")
    if categorical:
        cc = sql_cells(src, categorical, sensitive, "VARCHAR")
        arms.append(f"""
SELECT m.part AS dataset_part, m.col AS column_with_nulls, m.subgroup, 'categorical' AS column_type, m.sample_size,
  k.kl_divergence_pred, k.kl_divergence_total, NULL::DOUBLE AS rmse, m.acc AS precision, m.acc AS recall, m.acc AS f1_score
FROM (SELECT part, col, subgroup, count(*) AS sample_size, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS acc
      FROM ({cc}) WHERE miss GROUP BY ALL) m
LEFT JOIN ({sql_categorical_kl(cc)}) k USING (part, col, subgroup)""")
    return " UNION ALL ".join(arms)
