"""Helpers shared by the training-data operators (DataFrame functions only)."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..session import drop_path, write_barrier

#: Bytes of one Arrow batch handed to Python.
BATCH_BYTES = 16 << 20
#: Seconds of a write after which the shuffle files behind it are given up at once.
LONG_S = 1
#: Bytes of a shuffle partition up to which a join builds a hash table of it.
HASH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Settings of the session that the operators rely on.  Texts differ in length by orders
    of magnitude, so Arrow batches are bounded by bytes, not by rows alone; and a join whose
    partitions all turn out small at run time hashes them instead of sorting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASH_BYTES))


class Scratch:
    """Intermediate tables of one operator call, written as Parquet under the folder
    in ``spark.checkpoint.dir`` and read back: the next step starts from durable files,
    whichever executors are lost.  ``drop`` removes tables the result doesn't read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}
        bound_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        began = time.time()
        out, self.paths[name] = write_barrier(df, f"{self.tag}-{name}")
        if time.time() - began > LONG_S:
            # Spark removes shuffle files once their plan is garbage, so ask for that now:
            # the shuffles behind a long write are large, and the written table replaces them
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.paths:
                drop_path(self.spark, self.paths.pop(n))


def draw(seed, salt: str, *ids: Column | str) -> Column:
    """Uniform double in [0, 1) with 52 bits from md5(seed | salt | ids): the same for
    every partitioning, retry and engine.  A null id reads as ''."""
    cols = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in ids]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *cols))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def sql_draw(seed, salt: str, *ids: str) -> str:
    """The DuckDB form of :func:`draw`."""
    cols = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ids)
    return (f"((('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', {cols})), 1, 13))::BIGINT)::DOUBLE"
            f" / {float(1 << 52)!r})")


def sortable(df: DataFrame, but: tuple = ()) -> list[str]:
    """The columns that rows can be ordered by (no maps or other nested values)."""
    return [f.name for f in df.schema.fields if f.name not in but and isinstance(f.dataType, AtomicType)]


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def gapless(df: DataFrame, group: list[str], sub: Column, order: list, out: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, no group in one task.

    ``sub`` cuts a group into parts that follow ``order`` (a monotone function of the
    order, such as leading bits of the key), so a row's number is the count of all rows
    in earlier parts plus its rank inside its own.  Windows only ever hold one part;
    the counts are one row per (group, part)."""
    part = f"__{out}_part"
    df = df.withColumn(part, sub)
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(part).alias("__part"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col(part).eqNullSafe(F.col("__part"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    return (df.join(offsets, on)
            .withColumn(out, (F.col("__before") + inside).cast("bigint"))
            .drop(part, "__part", "__before", *[f"__g{i}" for i in range(len(group))]))
