"""Streaming use of fitted imputers.

A fitted statistic / cluster imputer is a stateless projection, so it applies
unchanged to a streaming DataFrame; per-micro-batch scoring and metric rows go
through ``foreachBatch`` with the metric-store writer (S10).  The reference has
no streams; this is the same batch operator on an unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_source(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def impute_stream(stream: DataFrame, model) -> DataFrame:
    """Apply a fitted ``ImputerModel`` / ``ClusterModel`` to each arriving row."""
    return model.transform(stream)


def null_counts_per_batch(writer, columns):
    """foreachBatch body: null count of each column per micro-batch, appended
    through a metric-store writer (``MetricStore.writer``)."""
    def body(batch: DataFrame, epoch_id: int):
        row = batch.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        long = row.select(F.lit(epoch_id).alias("epoch_id"), "n", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_nulls")) for c in columns])).alias("x")
        ).select("epoch_id", "n", "x.*")
        writer(long, epoch_id)
    return body


def run_available(query_df: DataFrame, checkpoint: str, foreach_batch=None, path: str | None = None):
    """Process everything available now and stop (``availableNow`` trigger), into the
    ``foreach_batch`` function or, as Parquet, under ``path``."""
    if (foreach_batch is None) == (path is None):
        raise ValueError("name one sink: foreach_batch or path")
    w = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(foreach_batch) if foreach_batch is not None else
         w.format("parquet").option("path", path).outputMode("append")).start()
    q.awaitTermination()
    return q
