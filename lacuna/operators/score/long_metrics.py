"""Long-form imputation metrics driven by a ``variables`` table.

Cells: (row_id, col, truth, pred, is_target) -- doubles for every type
(categories as codes).  variables: (name, type in continuous/binary/categorical/
ordinal, lower, upper, dim, target).  One group-by (with rollup for 'all').
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(cells: DataFrame, variables: DataFrame) -> DataFrame:
    v = variables.select(F.col("name").alias("col"), "type", "lower", "upper",
                         *([F.col("dim")] if "dim" in variables.columns else [F.lit(1).alias("dim")]),
                         *([F.col("target")] if "target" in variables.columns else [F.lit(False).alias("target")]))
    return cells.join(F.broadcast(v), "col")  # one row per variable: bounded by the schema width


def per_variable_metrics(cells: DataFrame, variables: DataFrame, targets_only: bool = False) -> DataFrame:
    """Per variable and 'all' over the target cells (is_target): RMSE,
    raw and in units of the declared range; fraction incorrect and accuracy of the discrete
    types.  Binaries are thresholded at 0.5, a wrong category is an error of 1, ordinals
    err by their distance, and a text cell counts as no error.  Auxiliary variables (an
    ``aux`` column that is true) are left out of 'all' and of the rows."""
    j = _joined(cells, variables).where("is_target")
    if "aux" in variables.columns:
        j = j.join(F.broadcast(variables.where("aux").select(F.col("name").alias("col"))), "col", "left_anti")
    if targets_only:
        j = j.where("target")
    kind = F.col("type")
    discrete = kind.isin("binary", "categorical", "ordinal")
    pred = F.when(kind == "binary", (F.col("pred") >= 0.5).cast("double")).otherwise(F.col("pred"))
    gap = (F.when(kind == "text", F.lit(0.0))
           .when(kind == "categorical", (pred != F.col("truth")).cast("double"))
           .otherwise(pred - F.col("truth")))
    in_range = F.when(kind.isin("continuous", "ordinal"), F.try_divide(gap, F.col("upper") - F.col("lower"))).otherwise(gap)
    wrong = F.when(discrete, (F.rint(pred) != F.col("truth")).cast("double"))
    agg = j.groupingSets([[], ["col"]], "col").agg(
        F.grouping("col").alias("__all"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sqrt(F.avg(in_range * in_range)).alias("normalised_rmse"),
        F.avg(wrong).alias("fraction_incorrect"), (1 - F.avg(wrong)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("col", F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col("col"))).drop("__all")


def binary_confusion(cells: DataFrame, variables: DataFrame) -> DataFrame:
    """Class-normalised 2x2 confusion over binary target cells."""
    j = _joined(cells, variables).where("is_target AND type = 'binary'")
    p = (F.col("pred") >= 0.5).cast("int")
    t = F.col("truth").cast("int")
    r = j.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]).first()
    n0, n1 = r["c00"] + r["c01"], r["c10"] + r["c11"]
    rows = [(a, b, (r[f"c{a}{b}"] / (n0 if a == 0 else n1)) if (n0 if a == 0 else n1) else None)
            for a in (0, 1) for b in (0, 1)]
    return cells.sparkSession.createDataFrame(rows, "truth int, pred int, share double")


def binary_auc(cells: DataFrame, variables: DataFrame):
    """AUROC and AUPR over binary target cells (None when there are none)."""
    j = _joined(cells, variables).where("is_target AND type = 'binary'").select(
        F.col("truth").alias("label"), F.col("pred").alias("rawPrediction"))
    if j.isEmpty():
        return None, None
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    return ev.evaluate(j, {ev.metricName: "areaUnderROC"}), ev.evaluate(j, {ev.metricName: "areaUnderPR"})


def error_by_type(cells: DataFrame, variables: DataFrame) -> DataFrame:
    """Categorical mismatch rate; ordinal mean |delta| / dim; else RMSE over
    the observed range -- for observed and missing cells separately."""
    j = _joined(cells, variables)
    e = (F.when(F.col("type") == "categorical", (F.rint("pred") != F.col("truth")).cast("double"))
         .when(F.col("type") == "ordinal", F.abs(F.rint("pred") - F.col("truth")) / F.col("dim"))
         .otherwise(((F.col("pred") - F.col("truth")) / (F.col("upper") - F.col("lower"))) ** 2))
    g = j.withColumn("e", e).groupBy("col", "type", F.col("is_target").alias("was_missing")).agg(F.avg("e").alias("m"))
    return g.withColumn("error", F.when(F.col("type").isin("categorical", "ordinal"), F.col("m")).otherwise(F.sqrt("m"))).drop("m")


def item_difficulty(cells: DataFrame) -> DataFrame:
    """avg(1 - imputed) per item."""
    return cells.groupBy("col").agg(F.avg(1 - F.col("pred")).alias("difficulty"))
