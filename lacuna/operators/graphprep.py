"""Graph preparation (G1-G7) and dense re-indexing.

Edges are DataFrames (src, dst, kind); no graph library is needed.  Dense ids come from a
range-partitioned sort: each partition numbers its own keys and starts at the count of the
keys before it, so no single task ranks all keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_barrier

_ROW_BITS = 33  # of monotonically_increasing_id: the row number inside the partition


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct non-null values of ``col`` -> 0..n-1 in sorted order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranged = d.repartitionByRange(n, col).sortWithinPartitions(col).withColumn("__m", F.monotonically_increasing_id())
    # written once: the counts and the numbers must come from the same partitioning
    kept, _ = write_barrier(ranged, "index")
    part = F.shiftrightunsigned("__m", _ROW_BITS)
    sizes = {r["p"]: r["count"] for r in kept.groupBy(part.alias("p")).count().collect()}  # one row per partition
    if not sizes:
        return kept.select(col, F.col("__m").alias(out))
    before, start = 0, {}
    for p in sorted(sizes):
        start[p], before = before, before + sizes[p]
    offset = F.create_map(*[x for p, k in start.items() for x in (F.lit(p).cast("bigint"), F.lit(k).cast("bigint"))])
    return kept.select(col, (offset[part] + F.col("__m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias(out))


def reindex(df: DataFrame, col: str, mapping: DataFrame, out: str | None = None) -> DataFrame:
    """G1: replace ids by used ids; rows without a mapping are dropped (inner join)."""
    return df.join(mapping, col).withColumnRenamed("idx", out or f"{col}_idx")


def bipartite_edges(cells: DataFrame, row: str, item: str) -> DataFrame:
    """Row -> item edges with items offset by the number of rows, plus the
    reversed copy; ids are dense indexes."""
    rows = dense_index(cells, row, "ridx")
    items = dense_index(cells, item, "iidx")
    n_rows = rows.count()
    e = (cells.select(row, item).distinct().join(rows, row).join(items, item)
         .select(F.col("ridx").alias("src"), (F.col("iidx") + F.lit(n_rows)).alias("dst")))
    fwd = e.withColumn("kind", F.lit("row_item"))
    rev = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("item_row").alias("kind"))
    return fwd.unionByName(rev)


def topic_edges(items: DataFrame, item: str, topics: str, leaf_only: bool = False) -> DataFrame:
    """Item -> topic edges from an ordered topic list (all levels or the leaf)."""
    x = items.select(item, F.posexplode(topics).alias("level", "topic"))
    if leaf_only:
        x = x.withColumn("__m", F.max("level").over(Window.partitionBy(item))).where("level = __m").drop("__m")
    return x.select(F.col(item).alias("src"), F.col("topic").alias("dst"), F.lit("item_topic").alias("kind"), "level")


def topic_links(items: DataFrame, topics: str) -> DataFrame:
    """Distinct parent -> child links of consecutive topics in each list."""
    pairs = items.select(F.arrays_zip(F.slice(topics, 1, F.size(topics) - 1),
                                      F.slice(topics, 2, F.size(topics))).alias("z"))
    return pairs.select(F.explode("z").alias("p")).select(
        F.col("p")["0"].alias("parent"), F.col("p")["1"].alias("child")).distinct()


def multi_hot(items: DataFrame, item: str, topics: str, vocabulary) -> DataFrame:
    """Item x topic multi-hot array over a declared vocabulary."""
    return items.select(item, F.array(*[F.array_contains(topics, F.lit(v)).cast("int") for v in vocabulary])
                        .alias("multi_hot"))


def edge_metadata(edges: DataFrame, ts: str, attr: str, levels) -> DataFrame:
    """Timestamp min-max normalised to [0, 1] and one-hot of an integer
    attribute whose values must be 0..L-1 (contiguity checked)."""
    r = edges.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"),
                  F.min(attr).alias("amin"), F.max(attr).alias("amax"),
                  F.count_distinct(attr).alias("nd")).first()
    if r["amin"] != 0 or r["amax"] != r["nd"] - 1:
        raise ValueError(f"{attr} values are not contiguous from 0")
    lo, hi = r["lo"], r["hi"]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))  # noqa: E731  (NTZ or LTZ input)
    span = (micros(F.lit(hi)) - micros(F.lit(lo))).cast("double")
    t = (micros(F.col(ts)) - micros(F.lit(lo))).cast("double")
    return edges.withColumns({"ts_norm": F.try_divide(t, span),
                              "attr_onehot": F.array(*[(F.col(attr) == i).cast("int") for i in range(levels)])})
