"""The whole run (L8): imputation and model rows of imputers, models and one scenario.

A run injects once and keeps the parts.  Every imputer repairs them and is scored; sensitive
columns are then dropped (P1), every model is fitted on the repaired train part and its
predictions on all test parts are scored per subgroup.  An imputer named in ``JOINT`` cleans
and trains together: one classifier per repair of the damaged rows, boosted over validation
rows (L17), the number of rounds chosen by validation accuracy (L18).  Imputer parameters are
tuned or looked up in a versioned table keyed by imputer, dataset and train mechanism (I34).

A model is any object with ``name`` and ``fit(train, numeric, categorical)``, which returns a
function from rows to rows with ``prediction`` (0 or 1).  Rows without a prediction count as 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_key, hash_unit
from ..operators import models as M
from ..operators.encode import OneHotScale, labels_pm1
from ..operators.impute.repairs import fit_repairs, repair_table
from ..operators.score.cells import REAL, score
from ..operators.score.groups import membership
from ..operators.split import TRAIN
from ..session import drop_path, write_barrier
from ..sources.store import MetricStore, guid, with_metric_keys
from ..sources.tables import TableSpec
from .experiment import drop_sensitive, prepare_parts, timed_impute
from .scenarios import injection_scenarios

JOINT = ("boost_clean",)
ROUNDS = (1, 5, 10)
VALIDATION = 0.2


# ---- I34 ------------------------------------------------------------------------------------------

class ParameterTable:
    """Imputer parameters as rows: imputer, dataset, mechanism, version, params (JSON)."""

    def __init__(self, store: MetricStore):
        self.store = store

    def rows(self) -> DataFrame | None:
        path = self.store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.store.path("imputer_params"))
        fs = path.getFileSystem(self.store.spark.sparkContext._jsc.hadoopConfiguration())
        return self.store.read("imputer_params") if fs.exists(path) else None

    def latest(self) -> DataFrame | None:
        """The newest version of every key."""
        rows = self.rows()
        if rows is None:
            return None
        w = Window.partitionBy("imputer", "dataset", "mechanism").orderBy(F.desc("version"))  # the versions of one key
        return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

    def lookup(self, imputer: str, dataset: str, mechanism: str) -> dict | None:
        rows = self.latest()
        found = rows and rows.where((F.col("imputer") == imputer) & (F.col("dataset") == dataset) & (F.col("mechanism") == mechanism)).select("params").first()
        return json.loads(found["params"]) if found else None

    def remember(self, imputer: str, dataset: str, mechanism: str, params: dict) -> int:
        """Add a version (from 1) and return its number."""
        rows = self.rows()
        mine = (F.col("imputer") == imputer) & (F.col("dataset") == dataset) & (F.col("mechanism") == mechanism)
        version = 1 + ((rows.where(mine).agg(F.max("version")).first()[0] or 0) if rows is not None else 0)
        row = [(imputer, dataset, mechanism, version, json.dumps(params, sort_keys=True))]
        self.store.append("imputer_params", self.store.spark.createDataFrame(row, "imputer string, dataset string, mechanism string, version int, params string"))
        return version

    def resolve(self, imputer: str, dataset: str, scenario: str, tune) -> dict:
        """Stored parameters for the scenario's train mechanism; with ``tune`` (a function) or
        where there are none, what it finds, remembered."""
        mechanism = injection_scenarios(scenario)[0]
        known = self.lookup(imputer, dataset, mechanism)
        if known is not None:
            return known
        params = tune() if tune else {}
        self.remember(imputer, dataset, mechanism, params)
        return params


# ---- models -----------------------------------------------------------------------------------------

@dataclass
class RateModel:
    """1 where the rows' group has at least the positive rate of all train rows; groups that
    the train rows do not have are 0.  Rates are compared as products of counts."""
    name: str
    by: tuple

    def fit(self, train: DataFrame, numeric, categorical):
        table = train.groupBy(*[F.col(c).alias(f"__{c}") for c in self.by]).agg(F.sum("label").alias("__p"), F.count(F.lit(1)).alias("__n"))
        whole = train.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
        sure = table.withColumn("__y", (F.col("__p") * F.lit(whole["n"]) >= F.lit(whole["p"]) * F.col("__n")).cast("int")).drop("__p", "__n")

        def predict(df: DataFrame) -> DataFrame:
            on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.by])
            return df.join(sure, on, "left").withColumn("prediction", F.coalesce("__y", F.lit(0))).drop("__y", *[f"__{c}" for c in self.by])

        return predict


@dataclass
class SparkModel:
    """A Spark ML classifier on scaled numerics and one-hot categories."""
    name: str
    make: object

    def fit(self, train: DataFrame, numeric, categorical):
        feats = OneHotScale(tuple(numeric), tuple(categorical)).fit(train)
        model = self.make().setFeaturesCol("features").setLabelCol("label").fit(M.stable_input(feats.transform(train).select("row_id", "features", "label")))
        return lambda df: model.transform(feats.transform(df)).drop("features", "rawPrediction", "probability")


# ---- L29, L17, L18 ------------------------------------------------------------------------------------

def _clean(parts: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows as they were before injection."""
    return parts.withColumns({c: F.col(REAL + c) for c in spec.features})


def _sides(spec: TableSpec, parts: DataFrame, seed: int):
    """(damaged train rows, clean validation rows): a hashed fifth of the train part validates."""
    train = parts.where(F.col("part") == TRAIN)
    held = hash_unit(hash_key(seed, "repair-val", "row_id")) < F.lit(VALIDATION)
    return train.where(~held), _clean(train.where(held), spec)


def repaired_sets(spec: TableSpec, damaged: DataFrame) -> dict[str, DataFrame]:
    """name -> train table: every repair of the incomplete rows beside the complete ones, the
    true values ('truth'), and the mean and mode of what is there ('mean repair')."""
    cols = ["row_id", "label", *spec.features]
    complete = damaged.dropna(subset=list(spec.features)).select(*cols)
    fitted = fit_repairs(damaged, spec.numeric, spec.categorical)
    repairs = repair_table(damaged, fitted, spec.features).join(damaged.select("row_id", "label"), "row_id")
    sets = {name: repairs.where(F.col("repair") == name).select(*cols).unionByName(complete) for name in sorted(fitted)}
    default = {"mean repair": sets["mean-most_frequent"]} if "mean-most_frequent" in sets else {}
    return {**sets, "truth": _clean(damaged, spec).select(*cols), **default}


def accuracy_per_repair(spec: TableSpec, parts: DataFrame, model, test_part: str, seed: int) -> DataFrame:
    """Repair, val_accuracy, test_accuracy of the model trained on each repair, on the truth
    and on the mean repair; both sides are clean."""
    damaged, val = _sides(spec, parts, seed)
    test = _clean(parts.where(F.col("part") == test_part), spec)
    both = val.select(F.lit("val").alias("side"), "row_id", "label", *spec.features).unionByName(
        test.select(F.lit("test").alias("side"), "row_id", "label", *spec.features))
    out = []
    for name, table in repaired_sets(spec, damaged).items():
        said = model.fit(table, spec.numeric, spec.categorical)(both)
        out.append(said.select(F.lit(name).alias("repair"), "side", (F.col("prediction") == F.col("label")).cast("double").alias("hit")))
    hits = reduce(DataFrame.unionByName, out)
    on = lambda s: F.avg(F.when(F.col("side") == s, F.col("hit")))
    return hits.groupBy("repair").agg(on("val").alias("val_accuracy"), on("test").alias("test_accuracy"))


def joint_predictions(spec: TableSpec, parts: DataFrame, model, seed: int, rounds=ROUNDS):
    """(test rows with prediction, chosen rounds).  Weights are found on the validation
    rows; of ``rounds`` the number with the best validation accuracy is kept, the first on ties."""
    damaged, val = _sides(spec, parts, seed)
    sets = {n: t for n, t in repaired_sets(spec, damaged).items() if n not in ("truth", "mean repair")}
    fitted = {n: model.fit(t, spec.numeric, spec.categorical) for n, t in sets.items()}

    def votes(df):
        each = [fitted[n](df).select("part", "row_id", F.lit(n).alias("repair"), F.when(F.col("prediction") == 1, 1).otherwise(-1).alias("yhat"), "label")
                for n in sorted(fitted)]
        return labels_pm1(reduce(DataFrame.unionByName, each))

    on_val, path = write_barrier(votes(val), "votes")
    truth = on_val.select("row_id", "label").distinct()
    best = None
    for t in rounds:
        chosen = M.boost_over_repairs(on_val, t)
        acc = M.boosted_predict(on_val, chosen).join(truth, "row_id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
        if best is None or acc > best[0]:
            best = (acc, t, chosen)
    drop_path(parts.sparkSession, path)
    # every classifier votes on test rows whose missing cells hold the mean and mode of the train rows
    tests = repaired_tests(spec, parts, damaged)
    keyed = votes(tests).withColumn("__row", F.struct("part", "row_id"))
    said = M.boosted_predict(keyed, best[2], row="__row").select("__row.part", "__row.row_id", "prediction")
    return tests.select("part", "row_id", "label").join(said, ["part", "row_id"]), best[1]


def repaired_tests(spec: TableSpec, parts: DataFrame, damaged: DataFrame) -> DataFrame:
    """Test rows, missing cells filled with the mean and mode of the train rows."""
    fills = fit_repairs(damaged, spec.numeric, spec.categorical)["mean-most_frequent"]
    return parts.where(F.col("part") != TRAIN).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


# ---- L8 -----------------------------------------------------------------------------------------------

KEYS = ("dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed", "model_name", "dataset_part", "subgroup", "metric")


def _model_rows(spec: TableSpec, said: DataFrame, imputer: str, scenario: str, seed: int, model: str, groups: DataFrame) -> DataFrame:
    long = M.subgroup_metrics(said.select("part", "row_id", "label", "prediction").join(groups, ["part", "row_id"])
                              .select("*", F.explode("groups").alias("subgroup")), by=("part", "subgroup"))
    return long.select(F.lit(spec.name).alias("dataset_name"), F.lit(imputer).alias("null_imputer_name"), F.lit(scenario).alias("evaluation_scenario"),
                       F.lit(seed).alias("experiment_seed"), F.lit(model).alias("model_name"), F.col("part").alias("dataset_part"),
                       "subgroup", F.col("Sample_Size").alias("sample_size"), "metric", "metric_value")


def run_experiment(spec: TableSpec, imputers, models, scenario: str, seed: int, store: MetricStore) -> tuple[DataFrame, DataFrame]:
    """(imputation rows, model rows) of one scenario and seed, also appended to ``store``."""
    parts = prepare_parts(spec, scenario, seed)
    groups = parts.select("part", "row_id", membership(spec.sensitive).alias("groups"))

    def keep(said, imputer, model):
        rows = _model_rows(spec, said, imputer, scenario, seed, model.name, groups)
        store.append("model_metrics", rows.withColumn("exp_pipeline_guid", guid(*KEYS[:4])))

    for imputer in imputers:
        if imputer in JOINT:
            for model in models:
                keep(joint_predictions(spec, parts, model, seed)[0], imputer, model)
            continue
        imputed, path, minutes = timed_impute(spec, parts, imputer)
        scored = score(imputed, spec.numeric, spec.categorical, spec.sensitive, numeric_kl=False)
        scored = scored.select(F.lit(spec.name).alias("dataset_name"), F.lit(imputer).alias("null_imputer_name"), F.lit(scenario).alias("evaluation_scenario"),
                               F.lit(seed).alias("experiment_seed"), *scored.columns)
        store.append("imputation_metrics", with_metric_keys(scored, minutes, store.session_uuid))
        known, numeric, categorical = drop_sensitive(spec, imputed)
        train = known.where(F.col("part") == TRAIN)
        for model in models:
            keep(model.fit(train, numeric, categorical)(known.where(F.col("part") != TRAIN)), imputer, model)
        drop_path(spec.df.sparkSession, path)
    mine = lambda t: store.read(t, dataset_name=spec.name, evaluation_scenario=scenario, experiment_seed=seed)
    return mine("imputation_metrics"), mine("model_metrics")
