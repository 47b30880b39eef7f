"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # Parquet splits: ~128 MB per task keeps per-task memory flat at any scale.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", app: str = "lacuna", **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session
    without one gets a scratch folder of its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
        path = tempfile.mkdtemp(prefix="lacuna-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, key=None):
    """Hash-spread a frame over the default parallelism when its scans are too small to fill
    that many tasks (one parquet split, say).  The sizes come from the plan's leaves, no job
    runs for it, and larger inputs pass through unshuffled."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= target * split:
        return df
    return df.repartition(target, key) if key is not None else df.repartition(target)


def write_barrier(df, tag: str = "stage"):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder
    and reading it back: later plans start from a plain scan (column pruning and
    predicate pushdown apply), and the data survive executor loss."""
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/lacuna-{tag}-{uuid.uuid4().hex[:16]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def drop_path(spark, path: str):
    """Remove an intermediate folder this library wrote (no-op if absent)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)
