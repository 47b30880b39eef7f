"""Metric-table analytics (A1-A39, L11): DataFrame -> DataFrame report steps.

Each replaces a driver-side loop of the reference with one relational plan
(joins, pivots, windows, grouping sets).  Functions take the metric table and
column names; nothing here collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DISPARITY_KEYS = ["dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed",
                  "dataset_part", "column_with_nulls"]


def uniqueness_violations(df: DataFrame, keys) -> DataFrame:
    """A1/A2: keys that occur more than once (empty = unique)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def union_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """A4."""
    return a.unionByName(b, allowMissingColumns=True)


def disparity(m: DataFrame, metric: str, group: str, keys=DISPARITY_KEYS) -> DataFrame:
    """A5: dis rows LEFT JOIN priv rows on the keys; difference = dis - priv."""
    dis = m.where(F.col("subgroup") == f"{group}_dis").select(*keys, F.col(metric).alias(f"{metric}_dis"))
    priv = m.where(F.col("subgroup") == f"{group}_priv").select(*keys, F.col(metric).alias(f"{metric}_priv"))
    return (dis.join(priv, keys, "left")
            .withColumn(f"{metric}_difference", F.col(f"{metric}_dis") - F.col(f"{metric}_priv")))


def with_scenario_fields(df: DataFrame, part_col: str = "dataset_part") -> DataFrame:
    """Test parts only; 'X_test_MAR3' -> scenario MAR3, strategy MAR, rate 0.3."""
    sc = F.substring_index(F.col(part_col), "_", -1)
    return (df.where(F.col(part_col).contains("X_test"))
            .withColumns({"test_scenario": sc,
                          "test_strategy": F.expr(f"left(substring_index({part_col}, '_', -1), "
                                                  f"length(substring_index({part_col}, '_', -1)) - 1)"),
                          "test_error_rate": F.right(sc, F.lit(1)).cast("int") * F.lit(0.1)}))


def mean_std(df: DataFrame, value: str, by) -> DataFrame:
    """Mean and sample std per group (the line and the band)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               F.count(value).alias("n"))


def box_stats(df: DataFrame, value: str, by) -> DataFrame:
    """Quartiles (linear interpolation), IQR, whiskers = extreme values
    inside [q1 - 1.5 IQR, q3 + 1.5 IQR], outlier count."""
    q = df.groupBy(*by).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("q"), F.min(value).alias("min"),
                            F.max(value).alias("max"))
    q = q.select(*by, "min", "max", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(*by, value).join(q, by)
    inside = (F.col(value) >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col(value) <= F.col("q3") + 1.5 * F.col("iqr"))
    return j.groupBy(*by, "min", "max", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def summary_with_grouping_sets(df: DataFrame, metrics, seed_col: str = "experiment_seed", by=()) -> DataFrame:
    """Mean, population std and count of every metric over all runs and per seed."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_count")]
    out = df.groupingSets([list(by), [*by, seed_col]], *by, seed_col).agg(F.grouping(seed_col).alias("all_seeds"), *aggs)
    # the all-runs row is labelled 'all' instead of a NULL seed
    return out.withColumns({"all_seeds": F.col("all_seeds") == 1,
                            seed_col: F.when(F.col("all_seeds") == 1, F.lit("all")).otherwise(F.col(seed_col).cast("string"))})


def best_with_ties(df: DataFrame, score: str, by, desc: bool = True) -> DataFrame:
    """Rows holding the best score per group, ties kept."""
    o = F.desc(score) if desc else F.asc(score)
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*by).orderBy(o))).where("__r = 1").drop("__r")


def pivot_subgroups(df: DataFrame, value: str, keys, groups) -> DataFrame:
    """One column per subgroup (explicit values: no extra distinct job)."""
    return df.groupBy(*keys).pivot("subgroup", list(groups)).agg(F.first(value))


def reversed_metric(value: str) -> F.Column:
    """1 - |x|, so that a higher value is better for disparities too."""
    return 1 - F.abs(F.col(value))


def average_rank(col: str, by=()) -> F.Column:
    """Average rank with ties (for Spearman): (min rank + max rank) / 2."""
    w = Window.partitionBy(*by).orderBy(col)
    tie = Window.partitionBy(*by, col)
    return F.rank().over(w) + (F.count("*").over(tie) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Spearman rho = Pearson correlation of average ranks, per group."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    return r.groupBy(*by).agg(pearson("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def pearson(x: str, y: str) -> F.Column:
    """Pearson r as an aggregate; NULL (not an error) when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def pearson_matrix(df: DataFrame, columns, target: str | None = None, threshold: float | None = None) -> DataFrame:
    """Long correlation matrix (upper triangle), optional target-only and
    abs(r) >= threshold filter.  One aggregate job over all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if target:
        pairs = [(c, target) for c in columns if c != target]
    row = df.agg(*[pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                                   F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("x")
                      ).select("x.*")
    if threshold is not None:
        long = long.where(F.abs("r") >= threshold)
    return long


def group_base_rates(df: DataFrame, groups_col: str = "groups", label: str = "label") -> DataFrame:
    """Share of rows and positive rate per subgroup (one row per subgroup)."""
    g = df.select(F.explode(groups_col).alias("subgroup"), label).groupBy("subgroup").agg(
        F.count("*").alias("n"), F.avg(label).alias("base_rate"))
    n_all = F.max(F.when(F.col("subgroup") == "overall", F.col("n"))).over(Window.partitionBy())
    return g.withColumn("share", F.col("n") / n_all)


def majority_base_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of always predicting the majority class."""
    return df.agg(F.greatest(F.avg(label), 1 - F.avg(label)).alias("majority_rate"))


def column_profile(df: DataFrame, columns) -> DataFrame:
    """Null and distinct counts per column, row count (one job)."""
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"nn__{c}") for c in columns],
                 *[F.count_distinct(c).alias(f"nd__{c}") for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"nn__{c}").alias("n_nulls"),
                                                   F.col(f"nd__{c}").alias("n_distinct"), F.col("__n").alias("n_rows"))
                                          for c in columns])).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns) -> DataFrame:
    """Value counts of categorical columns in long form."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(arr).alias("x")).groupBy("x.column_name", "x.value").count()


def runtime_table(df: DataFrame, pivot_values=None) -> DataFrame:
    """Runtime mean/std per (dataset, imputer, scenario); then mean of means and
    mean of stds per (dataset, imputer); datasets pivoted to columns."""
    per = df.groupBy("dataset_name", "null_imputer_name", "evaluation_scenario").agg(
        F.avg("runtime_in_mins").alias("m"), F.stddev_samp("runtime_in_mins").alias("s"))
    agg = per.groupBy("dataset_name", "null_imputer_name").agg(F.avg("m").alias("mean_runtime"),
                                                              F.avg("s").alias("std_runtime"))
    out = agg.groupBy("null_imputer_name").pivot("dataset_name", pivot_values).agg(
        F.first("mean_runtime").alias("mean"), F.first("std_runtime").alias("std"))
    return out.orderBy("null_imputer_name")


def kind_averaged(df: DataFrame, metric: str, by=("dataset_name", "null_imputer_name", "evaluation_scenario",
                                                   "experiment_seed", "dataset_part")) -> DataFrame:
    """Average a metric over the columns of its kind per seed, dropping NULL / inf."""
    ok = F.col(metric).isNotNull() & (F.abs(F.col(metric)) != float("inf"))
    return df.where(ok).groupBy(*by, "column_type").agg(F.avg(metric).alias(f"{metric}_mean"))


def display_order(df: DataFrame, col: str, order) -> DataFrame:
    """Explicit display order as a sort key (small literal map)."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(f"{col}_order", F.coalesce(m[F.col(col)], F.lit(len(order))))


def baseline_stats(model_metrics: DataFrame, keys=("dataset_name", "model_name", "metric", "subgroup")) -> DataFrame:
    """Median and mean of the baseline (clean-data) metric per model."""
    return model_metrics.groupBy(*keys).agg(F.median("metric_value").alias("baseline_median"),
                                            F.avg("metric_value").alias("baseline_mean"))


def with_baseline(model_metrics: DataFrame, baseline: DataFrame, keys=("dataset_name", "model_name", "metric",
                                                                      "subgroup")) -> DataFrame:
    """Attach the baseline median per model."""
    return model_metrics.join(baseline, list(keys), "left")


def best_model_filter(model_metrics: DataFrame, best: DataFrame, keep=("boost_clean",)) -> DataFrame:
    """Keep each dataset's best model (or a joint cleaning method)."""
    b = best.select("dataset_name", F.col("best_model").alias("model_name"))
    chosen = model_metrics.join(b, ["dataset_name", "model_name"], "left_semi")
    return chosen.unionByName(model_metrics.where(F.col("model_name").isin(list(keep))))


def scatter_data(imp: DataFrame, perf: DataFrame, keys=("dataset_name", "evaluation_scenario", "null_imputer_name",
                                                        "dataset_part"), quality="rmse", metric="F1") -> DataFrame:
    """Mean imputation quality LEFT JOIN mean model performance on the run keys,
    with the min and max of each per evaluation scenario joined back (window)."""
    q = imp.groupBy(*keys).agg(F.avg(quality).alias("quality"))
    p = perf.where(F.col("metric") == metric).groupBy(*keys).agg(F.avg("metric_value").alias("performance"))
    j = q.join(p, list(keys), "left")
    w = Window.partitionBy("evaluation_scenario")
    return j.withColumns({"quality_min": F.min("quality").over(w), "quality_max": F.max("quality").over(w),
                          "performance_min": F.min("performance").over(w),
                          "performance_max": F.max("performance").over(w)})


def outlier_filter(df: DataFrame, thresholds: dict, top_imputers=None) -> DataFrame:
    """Drop rows whose metric exceeds its threshold; optional imputer whitelist."""
    out = df
    for m, t in thresholds.items():
        out = out.where(F.col(m).isNull() | (F.col(m) <= F.lit(t)))
    if top_imputers is not None:
        out = out.where(F.col("null_imputer_name").isin(list(top_imputers)))
    return out


def comparison_name(df: DataFrame) -> DataFrame:
    """model__imputer_seed label."""
    return df.withColumn("comparison", F.concat(F.col("model_name"), F.lit("__"), F.col("null_imputer_name"),
                                                F.lit("_"), F.col("experiment_seed").cast("string")))


def setting_dimension(df: DataFrame, train_col="train_strategy", test_col="test_strategy") -> DataFrame:
    """setting = train-test mechanism pair."""
    return df.withColumn("setting", F.concat_ws("-", F.col(train_col), F.col(test_col)))


# Scenarios that never stand for a train mechanism.
NOT_A_TRAIN_SCENARIO = ("exp2_3_mcar3", "exp2_3_mar3", "exp2_3_mnar3")


def train_mechanism_to_scenario(train_mechanisms: DataFrame, scenarios: DataFrame,
                                excluded=NOT_A_TRAIN_SCENARIO) -> DataFrame:
    """The first evaluation scenario, in the order of ``position``, whose name contains
    the mechanism; three are excluded; null where there is none."""
    s = scenarios.where(~F.col("evaluation_scenario").isin(list(excluded)))
    j = train_mechanisms.join(s, F.lower(F.col("evaluation_scenario")).contains(F.lower(F.col("train_mechanism"))), "left")
    return j.groupBy("train_mechanism").agg(F.min_by("evaluation_scenario", "position").alias("evaluation_scenario"))


def with_train_fields(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The train side of each run's scenario joined in: train_scenario,
    train_strategy ('MAR3' -> MAR), train_error_rate (0.3).  ``scenarios`` has one row per
    evaluation scenario."""
    t = F.col("train_scenario")
    side = scenarios.select("evaluation_scenario", "train_scenario",
                            F.regexp_extract(t, "^([A-Za-z]+)", 1).alias("train_strategy"),
                            (F.regexp_extract(t, "([0-9])$", 1).cast("int") * F.lit(0.1)).alias("train_error_rate"))
    return df.join(F.broadcast(side), "evaluation_scenario")


def by_train_rate(df: DataFrame, value: str, by, test_level: int = 3) -> DataFrame:
    """Mean and std by the train error rate, the test level fixed; ``df`` from
    :func:`with_scenario_fields` and :func:`with_train_fields`."""
    level = df.where(F.right("test_scenario", F.lit(1)).cast("int") == test_level)
    return mean_std(level, value, [*by, "train_error_rate"])


def no_shift(df: DataFrame) -> DataFrame:
    """Runs whose test mechanism is their train mechanism."""
    return df.where(F.upper("train_strategy") == F.upper("test_strategy"))


def finished_runs(metrics: DataFrame, name_col: str = "null_imputer_name", name: str | None = None) -> DataFrame:
    """The distinct finished experiments (of one model or imputer), sorted."""
    keys = ["dataset_name", "evaluation_scenario", "experiment_seed"]
    done = metrics.where("tag = 'OK'")
    if name is not None:
        done = done.where(F.col(name_col) == name)
    return done.select(*keys, name_col).distinct().orderBy(*keys, name_col)


def complete_row_counts(parts: DataFrame, features, by=("dataset_name", "evaluation_scenario")) -> DataFrame:
    """Rows and columns of every training set and how many of its rows are complete;
    average ``n_complete`` over scenarios for the report."""
    full = F.lit(True)
    for c in features:
        full = full & F.col(c).isNotNull()
    return parts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(list(features))).alias("n_columns"),
                                  F.count_if(full).alias("n_complete"))
