"""Factorisation and similarity operators.

I27: matrix factorisation imputer over (row, item, value) triplets = Spark ML
ALS (distributed alternating least squares); predictions for the unobserved
cells of the observed rows x items.
I29: feature similarity = cosine over rows of the long table (one group-by
over per-row column pairs; the pair count per row is the row's own width).
I28: similarity bump x <- 1 - (1 - x)(1 - delta)^m, m = observed similar features.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graphprep import dense_index

def als_impute(cells: DataFrame, row="row_id", item="col_id", value="value", rank: int = 8, reg: float = 0.1,
               max_iter: int = 10, seed: int = 42, candidates: DataFrame | None = None) -> DataFrame:
    """Fit ALS on observed cells; predict ``candidates`` (default: every row x item pair not
    observed: the completed matrix).  A cell of a row or item that the fit never saw gets
    the train mean and is marked ``cold``; no cell is dropped.  Ids may be of any type: ALS
    sees dense integers."""
    cold_value = cells.agg(F.avg(value)).first()[0]
    rows, items = dense_index(cells, row, "__row"), dense_index(cells, item, "__item")
    als = ALS(userCol="__row", itemCol="__item", ratingCol=value, rank=rank, regParam=reg, maxIter=max_iter, seed=seed,
              coldStartStrategy="nan", nonnegative=False)
    model = als.fit(cells.join(rows, row).join(items, item).select(
        F.col("__row").cast("int"), F.col("__item").cast("int"), F.col(value).cast("double").alias(value)))
    if candidates is None:
        # rows x items by definition of the completed matrix
        candidates = rows.select(row).crossJoin(items.select(item)).join(cells.select(row, item), [row, item], "left_anti")
    known = (candidates.join(rows, row, "left").join(items, item, "left")
             .withColumns({"__row": F.coalesce(F.col("__row"), F.lit(-1)).cast("int"), "__item": F.coalesce(F.col("__item"), F.lit(-1)).cast("int")}))
    out = model.transform(known).drop("__row", "__item")
    cold = F.isnan("prediction")
    return (out.withColumn("cold", cold)
            .withColumn(value, F.when(cold, F.lit(cold_value)).otherwise(F.col("prediction").cast("double"))).drop("prediction"))


def cosine_similarity(cells: DataFrame, row="row_id", col="col_id", value="value") -> DataFrame:
    """(col_a, col_b, cosine) over the rows where both are observed."""
    a = cells.select(F.col(row), F.col(col).alias("col_a"), F.col(value).alias("va"))
    b = cells.select(F.col(row), F.col(col).alias("col_b"), F.col(value).alias("vb"))
    pairs = a.join(b, row).where(F.col("col_a") < F.col("col_b"))
    return pairs.groupBy("col_a", "col_b").agg(
        F.try_divide(F.sum(F.col("va") * F.col("vb")),
                     F.sqrt(F.sum(F.col("va") ** 2)) * F.sqrt(F.sum(F.col("vb") ** 2))).alias("cosine"))


def similar_pairs(sim: DataFrame) -> DataFrame:
    """Pairs above the mean similarity (the threshold), both directions."""
    thr = sim.agg(F.avg("cosine")).first()[0]
    s = sim.where(F.col("cosine") > F.lit(thr))
    return s.select("col_a", "col_b").unionByName(s.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b")))


def similarity_bump(pred: DataFrame, observed: DataFrame, pairs: DataFrame, delta: float, row="row_id",
                    col="col_id", value="value") -> DataFrame:
    """X <- 1 - (1 - x)(1 - delta)^m with m = observed features similar to col."""
    m = (observed.select(row, F.col(col).alias("col_b")).join(pairs, "col_b")
         .groupBy(row, F.col("col_a").alias(col)).agg(F.count("*").alias("m")))
    j = pred.join(m, [row, col], "left").fillna({"m": 0})
    return j.withColumn(value, 1 - (1 - F.col(value)) * F.pow(F.lit(1 - delta), F.col("m"))).drop("m")
