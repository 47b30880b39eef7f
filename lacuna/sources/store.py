"""Metric store and imputed-set storage.

Three partitioned Parquet tables replace the document collections:
``imputation_metrics``, ``model_metrics``, ``tuned_params``.  Writes append
with constant columns, lower-case names and ``tag='OK'``; reads push their
equality predicates to the partition columns.  The root defaults to a folder
under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PARTITIONS = {
    "imputation_metrics": ["dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed"],
    "model_metrics": ["dataset_name", "null_imputer_name", "evaluation_scenario"],
    "tuned_params": ["dataset_name"],
    "imputed_sets": ["dataset", "imputer", "scenario", "seed", "part"],
}


def guid(*cols) -> F.Column:
    """md5 of the pipe-joined key values (same as hashing the joined string)."""
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def sql_guid(*cols) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def capitalise(name: str) -> str:
    """dataset_name -> Dataset_Name."""
    return "_".join(p[:1].upper() + p[1:] for p in name.split("_"))


class MetricStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lacuna-store-{uuid.uuid4().hex[:12]}"
        self.session_uuid = str(uuid.uuid1())

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, df: DataFrame, **constants) -> bool:
        """Add constants, lower-case names, tag='OK'; skip an empty frame."""
        df = df.persist()  # looked at and written: one run of its plan
        try:
            return not df.isEmpty() and self._write(table, df, constants)
        finally:
            df.unpersist()

    def _write(self, table: str, df: DataFrame, constants: dict) -> bool:
        out = df.withColumns({k: F.lit(v) for k, v in constants.items()})
        out = out.toDF(*[c.lower() for c in out.columns]).withColumn("tag", F.lit("OK"))
        parts = [c for c in PARTITIONS.get(table, []) if c in out.columns]
        out.write.mode("append").partitionBy(*parts).parquet(self.path(table))
        return True

    def writer(self, table: str, **constants):
        """A callback ``DataFrame -> None``; also fits ``foreachBatch(df, epoch)``."""
        def write(df: DataFrame, epoch_id=None):
            self.append(table, df, **constants)
        return write

    def read(self, table: str, capitalise_names: bool = False, **equals) -> DataFrame:
        """Equality predicates pushed to the scan (partition pruning)."""
        df = self.spark.read.parquet(self.path(table))
        for k, v in equals.items():
            df = df.where(F.col(k) == F.lit(v))
        if capitalise_names:
            df = df.toDF(*[capitalise(c) for c in df.columns])
        return df

    # ---- S5-S7: imputed train/test sets ------------------------------------------
    def save_imputed(self, df: DataFrame, dataset: str, imputer: str, scenario: str, seed: int):
        out = df.withColumns({"dataset": F.lit(dataset), "imputer": F.lit(imputer),
                              "scenario": F.lit(scenario), "seed": F.lit(seed)})
        out.write.mode("append").partitionBy(*PARTITIONS["imputed_sets"]).parquet(self.path("imputed_sets"))

    def load_imputed(self, dataset: str, imputer: str, scenario: str, seed: int, categorical=()) -> DataFrame:
        df = self.read("imputed_sets", dataset=dataset, imputer=imputer, scenario=scenario, seed=seed)
        return df.withColumns({c: F.col(c).cast("string") for c in categorical})

    def repaired_train_sets(self, dataset: str, scenario: str, seed: int) -> DataFrame:
        """Every stored train part for (scenario, seed) except deletion."""
        return (self.read("imputed_sets", dataset=dataset, scenario=scenario, seed=seed, part="X_train_val")
                .where(F.col("imputer") != "deletion"))


def with_metric_keys(m: DataFrame, runtime_in_mins: float | F.Column | None = None, session_uuid: str | None = None) -> DataFrame:
    """Guids, runtime, timestamp, session for metric rows."""
    return m.withColumns({
        "imputation_guid": guid("dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed",
                                "dataset_part", "column_with_nulls", "subgroup"),
        "exp_pipeline_guid": guid("dataset_name", "null_imputer_name", "evaluation_scenario", "experiment_seed"),
        "runtime_in_mins": F.lit(runtime_in_mins).cast("double"),
        "record_create_date_time": F.lit(datetime.now(timezone.utc)),
        "session_uuid": F.lit(session_uuid),
    })
