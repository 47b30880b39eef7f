"""Rank correlation matrices (A25, A33) of tables of any size.

Average ranks come from value counts: distinct values are cut into ranges by (group, value),
a range's number is its partition's, and a value's rank is the count of all earlier ranges
plus a running sum inside its own.  So no window ranks a whole group, and a value that a
third of all rows share is one row where ranks are made.  The ranks then meet the rows, one
join per column, and the matrix is one aggregate of covariances.

Rows with a null in one of the columns are left out; NaN ranks above all numbers; a constant
column has no correlation (null); an empty table gives no rows, or one of nulls without groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_barrier
from .report import pearson


def average_ranks(df: DataFrame, columns, by=()) -> DataFrame:
    """(by..., column, value, rank): the average rank (from 1) of every distinct value of each
    column, per group; equal values share the mean of their places."""
    by = list(by)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    n = df.select(*by, F.explode(cells).alias("x")).groupBy(*by, "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    keys = [*by, "column"]
    cut, _ = write_barrier(n.repartitionByRange(*[F.col(c) for c in keys], F.col("value")).withColumn("part", F.spark_partition_id()), "ranks")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "part").agg(F.sum("n").alias("m")).select(
        *[F.col(c).alias(f"__{c}") for c in keys], F.col("part").alias("__part"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    on = F.col("part") == F.col("__part")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return cut.join(offsets, on).select(*keys, "value", (first + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def rank_correlations(df: DataFrame, columns, by=(), targets=None) -> DataFrame:
    """(by..., feature_a, feature_b, spearman, n): every pair of columns (of a column and a
    target, where ``targets`` are given), per group."""
    columns, by = list(columns), list(by)
    whole = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    ranks, _ = write_barrier(average_ranks(whole, columns, by), "rank-tables")
    for c in columns:
        one = ranks.where(F.col("column") == c).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("value").alias("__value"), F.col("rank").alias(f"__rank_{c}"))
        on = F.col(c) == F.col("__value")
        for k in by:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        whole = whole.join(one, on).drop("__value", *[f"__{k}" for k in by])
    if targets is None:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    else:
        pairs = [(c, t) for t in targets for c in columns if c != t]
    wide = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[pearson(f"__rank_{a}", f"__rank_{b}").alias(f"__r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"__r{i}").alias("spearman")) for i, (a, b) in enumerate(pairs)]
    return wide.select(*by, "n", F.inline(F.array(*cells)))


def sql_rank_correlations(src: str, columns, by=(), targets=None) -> str:
    """The DuckDB form."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    also = ", ".join(by) + ", " if by else ""
    whole = f"SELECT {also}{', '.join(columns)} FROM ({src}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns)
    ranked = ", ".join(f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {also}{c}) - 1) / 2.0 AS r_{c}" for c in columns)
    if targets is None:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    else:
        pairs = [(c, t) for t in targets for c in columns if c != t]
    arms = [f"SELECT {also}count(*) AS n, '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN var_pop(r_{a}) * var_pop(r_{b}) = 0 THEN NULL "
            f"ELSE covar_pop(r_{a}, r_{b}) / sqrt(var_pop(r_{a}) * var_pop(r_{b})) END AS spearman FROM r{' GROUP BY ' + ', '.join(by) if by else ''}" for a, b in pairs]
    return f"WITH r AS MATERIALIZED (SELECT {also}{ranked} FROM ({whole})) " + " UNION ALL ".join(arms)
