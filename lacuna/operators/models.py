"""Models on repaired tables (L1-L16): Spark ML classifiers with a tuning grid, held-out
macro-F1 over hash-assigned folds, per-subgroup fairness metrics, bootstrap stability,
feature importances, and boosting over repairs (L17-L19).

Training rows are dealt into partitions by the hash of their id, as many as their number
asks for, and sorted inside, so seeded learners give the same models whatever the input
partitioning.

Tuning grows trees from counts by cell (:mod:`cell_trees`): a decision tree serves all depths of
its grid, a boosted run all numbers of rounds, a forest all depths and numbers of trees.  Logistic
and neural models, and trees of tables with too many cells, are fitted on rows by Spark ML.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cell_trees as T
from .encode import OneHotScale
from .split import kfold

ROWS_PER_PARTITION = 100_000
LEAST_PARTITIONS = 8


def stable_input(df: DataFrame, row_id: str = "row_id", rows: int | None = None) -> DataFrame:
    """Partitions that depend on the rows alone: their number and the hash of their ids."""
    n = df.count() if rows is None else rows
    return df.repartition(max(LEAST_PARTITIONS, math.ceil(n / ROWS_PER_PARTITION)), row_id).sortWithinPartitions(row_id)


# ---- L1 registry --------------------------------------------------------------------

MODELS = ("dt_clf", "lr_clf", "gbt_clf", "rf_clf", "mlp_clf")


def model_registry(seed: int = 42, n_features: int = 1, n_rows: int = 1, grid: str = "full") -> dict:
    """name -> (estimator, param maps).  ``grid``: "full", the whole grid as far as Spark
    has its parameters (tree depth ends at 30; an inverse regularisation strength C is
    regParam = 1 / (C rows)), or "small" for a bounded run.  GBT in Spark is binary-only."""
    cols = dict(featuresCol="features", labelCol="label")
    dt = DecisionTreeClassifier(seed=seed, **cols)
    lr = LogisticRegression(maxIter=1000 if grid == "full" else 100, **cols)
    gbt = GBTClassifier(seed=seed, **cols)
    rf = RandomForestClassifier(seed=seed, **cols)
    mlp = MultilayerPerceptronClassifier(seed=seed, maxIter=1000 if grid == "full" else 100,
                                         layers=[n_features, *([100, 100] if grid == "full" else [16]), 2], **cols)
    # The tuning grids.
    strengths = [0.001, 0.01, 0.1, 1]
    if grid == "full":
        axes = {
            "dt_clf": (dt, {dt.maxDepth: [5, 10, 20, 30], dt.minInstancesPerNode: [5, 10, 20, 50, 100], dt.impurity: ["gini", "entropy"]}),
            "lr_clf": (lr, {lr.elasticNetParam: [1.0, 0.0], lr.regParam: [1 / (c * n_rows) for c in strengths]}),
            "gbt_clf": (gbt, {gbt.maxIter: [50, 100, 200, 500], gbt.maxDepth: list(range(3, 10)),
                              gbt.minInstancesPerNode: [100 + 900 * i // 7 for i in range(8)]}),
            "rf_clf": (rf, {rf.numTrees: [50, 100, 200, 500, 700, 1000], rf.maxDepth: [10, 20, 30],
                            rf.minInstancesPerNode: [1, 2, 4], rf.bootstrap: [True, False]}),
            "mlp_clf": (mlp, {mlp.solver: ["l-bfgs", "gd"]}),
        }
    else:
        axes = {
            "dt_clf": (dt, {dt.maxDepth: [5, 10]}),
            "lr_clf": (lr, {lr.regParam: [1 / (c * n_rows) for c in (0.01, 1)]}),
            "gbt_clf": (gbt, {gbt.maxIter: [10], gbt.maxDepth: [3]}),
            "rf_clf": (rf, {rf.numTrees: [20], rf.maxDepth: [5, 10]}),
            "mlp_clf": (mlp, {mlp.solver: ["l-bfgs"]}),
        }
    out = {}
    for name, (est, values) in axes.items():
        builder = ParamGridBuilder()
        for param, options in values.items():
            builder = builder.addGrid(param, options)
        out[name] = (est, builder.build())
    return out


# ---- L2 macro-F1 evaluator ------------------------------------------------------------

def macro_f1_and_accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> tuple[float, float]:
    """Mean of the per-class F1 scores (Spark's own is weighted by support) and the
    accuracy, from one count of (label, prediction)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return _marks({(r["y"], r["p"]): r["count"] for r in pred.select(y.alias("y"), p.alias("p")).groupBy("y", "p").count().collect()})


def _marks(n: dict) -> tuple[float, float]:
    """Macro-F1 and accuracy from (label, prediction) -> rows."""
    classes = {c for pair in n for c in pair}
    f1 = []
    for c in classes:
        hit = n.get((c, c), 0)
        wrong = sum(k for (a, b), k in n.items() if (a == c) != (b == c))
        f1.append(2 * hit / (2 * hit + wrong))
    total = sum(n.values())
    return (sum(f1) / len(f1), sum(k for (a, b), k in n.items() if a == b) / total) if total else (0.0, 0.0)


def classification_report(pred: DataFrame, by=(), label="label", prediction="prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 (positive class 1) per group."""
    y, p = F.col(label), F.col(prediction).cast("int")
    tp, fp = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1))
    fn = F.count_if((y == 1) & (p == 0))
    return pred.groupBy(*by).agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


# ---- L2-L5 tuning ---------------------------------------------------------------------

TREE_MODELS = ("dt_clf", "gbt_clf", "rf_clf")


def _grouped(name: str, sets: dict) -> dict:
    """Parameter sets (number -> values) that one run over the cells serves: what the run is
    given -> (number of the set, the depth, and the rounds or trees at which it is read)."""
    out: dict = {}
    for i, v in sets.items():
        least = v["minInstancesPerNode"]
        key, size = {"dt_clf": lambda: ((least, v["impurity"]), 1),
                     "gbt_clf": lambda: ((least, v["maxDepth"]), v["maxIter"]),
                     "rf_clf": lambda: ((least, v["bootstrap"]), v["numTrees"])}[name]()
        out.setdefault(key, []).append((i, v["maxDepth"], size))
    return out


def _cell_run(spark, sent, name: str, key: tuple, wanted: list, seed: int):
    """(number of the set, whether each cell is predicted 1) of the sets of one run; a forest's
    trees are dealt to tasks, other runs are one task each."""
    depths, sizes = sorted({d for _, d, _ in wanted}), sorted({n for _, _, n in wanted})
    least = key[0]
    if name == "dt_clf":
        shares = T.in_tasks(spark, [0], lambda _: T.tree_shares(sent.value, depths, least, key[1]))[0]
        return [(i, shares[d] > 0.5) for i, d, _ in wanted]
    if name == "gbt_clf":
        def boosted(_):
            return {r: m > 0 for r, m in enumerate(T.boosted_margins(sent.value, key[1], least, sizes[-1]), 1) if r in sizes}
        ones = T.in_tasks(spark, [0], boosted)[0]
        return [(i, ones[n]) for i, _, n in wanted]
    edges = sorted({0, *sizes, *range(0, sizes[-1], T.TREES_A_TASK)})
    parts = T.in_tasks(spark, list(zip(edges, edges[1:])), lambda ab: T.forest_votes(sent.value, depths, least, key[1], seed, *ab))
    votes, out = {d: 0.0 for d in depths}, []
    for n, part in zip(edges[1:], parts):
        votes = {d: votes[d] + part[d] for d in depths}
        out += [(i, votes[d] > n / 2) for i, d, size in wanted if size == n]
    return out


def _values(est, params) -> dict:
    return {p.name: v for p, v in est.extractParamMap(params).items()}


def tune(train: DataFrame, numeric, categorical, names=MODELS, folds: int = 3, seed: int = 42, grid: str = "full",
         parallelism: int = 4, row_id: str = "row_id"):
    """L2/L3: every parameter set of every model is fitted on all folds but one and scored
    on that one, features included (fitted inside the fold); the set with the best mean
    held-out macro-F1 (the first on ties) is fitted again on all rows.  Rows of (model,
    held-out f1, held-out accuracy, minutes, params), the fitted models and features."""
    import time
    spark = train.sparkSession
    folded = kfold(train, seed, folds, row_id)
    keep = [row_id, "features", "label"]
    marks, minutes = {}, dict.fromkeys(names, 0.0)
    trees = [m for m in names if m in TREE_MODELS]
    for fold in range(folds):
        known, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        feats = OneHotScale(numeric, categorical).fit(known)
        n = known.count()
        # on disk, as learners keep blocks of their own in memory
        a = stable_input(feats.transform(known).select(*keep), row_id, n).persist(StorageLevel.DISK_ONLY)
        b = feats.transform(held).select(*keep).persist(StorageLevel.DISK_ONLY)
        registry = model_registry(seed, len(feats.names), n, grid)
        cut = T.Grid.of(a, n, feats, seed) if trees else None
        cells = cut.count(folded, feats, F.col("fold") != fold) if cut else None
        sent = spark.sparkContext.broadcast(cells) if cells else None

        def run(job):
            name, key, wanted = job
            t0 = time.time()
            if key is None:
                est, params = registry[name]
                got = [(wanted, macro_f1_and_accuracy(est.fit(a, params[wanted]).transform(b)))]
            else:
                got = [(i, _marks(cells.confusion(ones))) for i, ones in _cell_run(spark, sent, name, key, wanted, seed)]
            return name, got, (time.time() - t0) / 60.0

        jobs = [(m, None, i) for m in names if not (cells and m in trees) for i in range(len(registry[m][1]))]
        for m in trees if cells else ():
            est, params = registry[m]
            jobs += [(m, key, wanted) for key, wanted in _grouped(m, {i: _values(est, p) for i, p in enumerate(params)}).items()]
        with ThreadPool(max(parallelism, spark.sparkContext.defaultParallelism)) as pool:
            for name, got, took in pool.imap_unordered(run, jobs):
                for i, mark in got:
                    marks.setdefault((name, i), []).append(mark)
                minutes[name] += took
        a.unpersist()
        b.unpersist()
        if sent:
            sent.unpersist()
    feats = OneHotScale(numeric, categorical).fit(train)
    n = train.count()
    data = stable_input(feats.transform(train).select(*keep), row_id, n).persist(StorageLevel.DISK_ONLY)
    registry, rows, fitted = model_registry(seed, len(feats.names), n, grid), [], {}
    cut = T.Grid.of(data, n, feats, seed) if trees else None
    cells = cut.count(train, feats) if cut else None
    sent = spark.sparkContext.broadcast(cells.whole()) if cells else None
    for name in names:
        est, params = registry[name]
        mean = lambda i, k: sum(m[k] for m in marks[name, i]) / folds
        best = max(range(len(params)), key=lambda i: (mean(i, 0), -i))
        t0 = time.time()
        if cells and name in trees:
            (key, wanted), = _grouped(name, {best: _values(est, params[best])}).items()
            (_, ones), = _cell_run(spark, sent, name, key, wanted, seed)
            fitted[name] = T.CellModel(cut, ones, wanted[0][2])
        else:
            fitted[name] = est.fit(data, params[best])
        shown = sorted((p.name, str(v)) for p, v in params[best].items())
        rows.append((name, float(mean(best, 0)), float(mean(best, 1)), minutes[name] + (time.time() - t0) / 60.0, str(shown)))
    data.unpersist()
    if sent:
        sent.unpersist()
    tuned = spark.createDataFrame(
        rows, "model_name string, f1_score double, accuracy_score double, runtime_in_mins double, model_best_params string")
    return tuned, fitted, feats


def best_model(results: DataFrame, by=(), score: str = "f1_score") -> DataFrame:
    """Model with the highest score (per group)."""
    return results.groupBy(*by).agg(F.max_by("model_name", score).alias("best_model"), F.max(score).alias(score))


# ---- L9 fairness metrics ---------------------------------------------------------------

def subgroup_metrics(pred: DataFrame, by=("subgroup",), label="label", prediction="prediction") -> DataFrame:
    """TPR, TNR, FPR, FNR, accuracy, F1, selection rate per group, long form."""
    y, p = F.col(label), F.col(prediction).cast("int")
    tp, tn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 0))
    fp, fn = F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    wide = pred.groupBy(*by).agg(
        F.try_divide(tp, tp + fn).alias("TPR"), F.try_divide(tn, tn + fp).alias("TNR"),
        F.try_divide(fp, fp + tn).alias("FPR"), F.try_divide(fn, fn + tp).alias("FNR"),
        F.avg((y == p).cast("double")).alias("Accuracy"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("F1"),
        F.avg(p.cast("double")).alias("Selection_Rate"), F.count("*").alias("Sample_Size"))
    metrics = ["TPR", "TNR", "FPR", "FNR", "Accuracy", "F1", "Selection_Rate"]
    return wide.select(*by, "Sample_Size", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("metric_value")) for m in metrics])).alias("x")
    ).select(*by, "Sample_Size", "x.metric", "x.metric_value")


# Overall metric -> its disparity metrics and how each compares the
# disadvantaged group with the privileged one.
DISPARITY_METRICS = {
    "TPR": {"Equalized_Odds_TPR": "difference"},
    "TNR": {"Equalized_Odds_TNR": "difference"},
    "FPR": {"Equalized_Odds_FPR": "difference"},
    "FNR": {"Equalized_Odds_FNR": "difference"},
    "Accuracy": {"Accuracy_Difference": "difference"},
    "Selection_Rate": {"Statistical_Parity_Difference": "difference", "Disparate_Impact": "ratio",
                       "Selection_Rate_Difference": "difference"},
    "Label_Stability": {"Label_Stability_Ratio": "ratio", "Label_Stability_Difference": "difference"},
    "Jitter": {"Jitter_Difference": "difference"},
    "IQR": {"IQR_Difference": "difference"},
    "Std": {"Std_Difference": "difference", "Std_Ratio": "ratio"},
    "Overall_Uncertainty": {"Overall_Uncertainty_Difference": "difference", "Overall_Uncertainty_Ratio": "ratio"},
    "Aleatoric_Uncertainty": {"Aleatoric_Uncertainty_Difference": "difference", "Aleatoric_Uncertainty_Ratio": "ratio"},
    "Epistemic_Uncertainty": {"Epistemic_Uncertainty_Difference": "difference", "Epistemic_Uncertainty_Ratio": "ratio"},
}


def disparity_metrics(long: DataFrame, attrs, keys=()) -> DataFrame:
    """One row per (keys, attribute, disparity metric): the two groups' values of
    the overall metric and their difference or ratio; metrics without a disparity metric
    give no row."""
    groups = [f"{a}_{s}" for a in attrs for s in ("dis", "priv")]
    wide = long.where(F.col("subgroup").isin(groups)).groupBy(*keys, "metric").pivot("subgroup", groups).agg(
        F.first("metric_value"))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_dis").alias("dis"), F.col(f"{a}_priv").alias("priv"))
                                for a in attrs]))
    named = F.create_map(*[x for m, names in DISPARITY_METRICS.items() for x in (F.lit(m), F.array(*[
        F.struct(F.lit(n).alias("disparity_metric"), F.lit(how).alias("how")) for n, how in names.items()]))])
    out = wide.select(*keys, "metric", sides.alias("x")).select(*keys, "metric", "x.*")
    out = out.select("*", F.explode(named[F.col("metric")]).alias("d")).select("*", "d.*").drop("d")
    value = F.when(F.col("how") == "ratio", F.try_divide(F.col("dis"), F.col("priv"))).otherwise(F.col("dis") - F.col("priv"))
    return out.withColumn("value", value).drop("how")


# ---- L10 stability from bootstrap replicas ------------------------------------------------

def bootstrap_predictions(train: DataFrame, test: DataFrame, feats_model, estimator, replicas: int = 50,
                          fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Train ``replicas`` models on hash-drawn fractions of train; predictions
    (row_id, replica, prediction, p) on test."""
    from ..functions.hashing import hash_key, hash_unit
    # dealt to partitions and sorted once, on disk: a replica is a filter of them
    tr = stable_input(feats_model.transform(train).select("row_id", "features", "label"), rows=train.count()).persist(StorageLevel.DISK_ONLY)
    # all replicas score a row in one projection
    out = feats_model.transform(test).select("row_id", "features")
    for b in range(replicas):
        sample = tr.where(hash_unit(hash_key(seed, f"replica:{b}", "row_id")) < F.lit(fraction))
        m = estimator.fit(sample)
        out = (m.setProbabilityCol("__v").setPredictionCol(f"__y{b}").setRawPredictionCol("").transform(out)
               .withColumn(f"__p{b}", vector_to_array("__v")[1]).drop("__v"))
    tr.unpersist()
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("replica"), F.col(f"__y{b}").cast("int").alias("prediction"),
                                        F.col(f"__p{b}").alias("p")) for b in range(replicas)]))
    return out.select("row_id", each.alias("x")).select("row_id", "x.*")


def stability_metrics(preds: DataFrame, groups: DataFrame, replicas: int) -> DataFrame:
    """Per row label stability |n1-n0|/B, jitter (share of disagreeing replica
    pairs), std and IQR of p, overall / aleatoric / epistemic uncertainty (entropy of
    the mean p, mean entropy, difference); then averaged per subgroup."""
    def ent(x):
        x = F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))
        return -(x * F.log(x) + (1 - x) * F.log(1 - x))
    per_row = preds.groupBy("row_id").agg(
        F.count_if(F.col("prediction") == 1).alias("n1"), F.count("*").alias("b"),
        F.stddev_pop("p").alias("std"), F.percentile("p", [0.25, 0.75]).alias("q"),
        F.avg("p").alias("mean_p"), F.avg(ent(F.col("p"))).alias("aleatoric"))
    per_row = per_row.select(
        "row_id", (F.abs(2 * F.col("n1") - F.col("b")) / F.col("b")).alias("label_stability"),
        F.try_divide(F.col("n1") * (F.col("b") - F.col("n1")), F.col("b") * (F.col("b") - 1) / 2).alias("jitter"),
        "std", (F.col("q")[1] - F.col("q")[0]).alias("iqr"),
        ent(F.col("mean_p")).alias("overall_uncertainty"), "aleatoric")
    per_row = per_row.withColumn("epistemic", F.col("overall_uncertainty") - F.col("aleatoric"))
    j = per_row.join(groups.select("row_id", F.explode("groups").alias("subgroup")), "row_id")
    return j.groupBy("subgroup").agg(*[F.avg(c).alias(c) for c in
                                       ("label_stability", "jitter", "std", "iqr", "overall_uncertainty",
                                        "aleatoric", "epistemic")])


# ---- L13 feature importance ------------------------------------------------------------

def long_stability(wide: DataFrame, by=("subgroup",)) -> DataFrame:
    """L10 metrics in the long form that :func:`disparity_metrics` reads."""
    names = {"label_stability": "Label_Stability", "jitter": "Jitter", "std": "Std", "iqr": "IQR",
             "overall_uncertainty": "Overall_Uncertainty", "aleatoric": "Aleatoric_Uncertainty", "epistemic": "Epistemic_Uncertainty"}
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("metric_value"))
                                                for c, n in names.items()])).alias("x")).select(*by, "x.*")


def feature_importance(rf_model, names, threshold: float = 0.0, spark=None) -> DataFrame:
    imp = rf_model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, imp) if v >= threshold]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


# ---- L17-L19 boosting over repairs ----------------------------------------------------------

def boost_over_repairs(preds: DataFrame, rounds: int, label: str = "y_pm1", row: str = "row_id") -> list:
    """preds = (row, repair, yhat in {-1,+1}, y) on validation rows.  Each round
    picks the repair with the highest weighted accuracy (first on ties), alpha =
    ln((1-e)/(e+1e-8)), weights *= exp(-alpha y yhat).  Weights are a closed form
    of the chosen sequence, so a round is one aggregate job.  Returns [(repair, alpha)]."""
    repairs = sorted(r[0] for r in preds.select("repair").distinct().collect())
    wide = preds.groupBy(row, label).pivot("repair", repairs).agg(F.first("yhat")).cache()
    n = wide.count()
    chosen = []
    for _ in range(rounds):
        expo = F.lit(0.0)
        for rep, a in chosen:
            expo = expo + F.lit(a) * F.col(label) * F.col(rep)
        w = F.exp(-expo) / F.lit(n)
        accs = wide.agg(*[F.sum(F.when(F.col(rep) == F.col(label), w).otherwise(F.lit(0.0))).alias(rep)
                          for rep in repairs]).first()
        best = max(range(len(repairs)), key=lambda i: (accs[repairs[i]], -i))
        e = 1 - accs[repairs[best]]
        chosen.append((repairs[best], math.log((1 - e) / (e + 1e-8))))
    wide.unpersist()
    return chosen


def boosted_predict(preds: DataFrame, chosen: list, row: str = "row_id") -> DataFrame:
    """sign(sum alpha * yhat) -> 0/1 (score 0 -> 0)."""
    alphas = preds.sparkSession.createDataFrame([(i, r, float(a)) for i, (r, a) in enumerate(chosen)],
                                                "round int, repair string, alpha double")
    s = preds.join(F.broadcast(alphas), "repair").groupBy(row).agg(F.sum(F.col("alpha") * F.col("yhat")).alias("score"))
    return s.withColumn("prediction", (F.signum("score") > 0).cast("int"))
