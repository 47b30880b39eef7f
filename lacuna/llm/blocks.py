"""A stated set of queries against all rows, in blocks of bounded size.

Rows and queries are dealt into blocks by the hash of their ids; a task holds one block of
rows and one block of queries of the same cell, and returns its best few per query.  The
blocks of a cell meet through a key made of both block numbers, so each side is copied once
per block of the other side and no pair of rows is ever emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BLOCK = 8192
QUERY_BLOCK = 2048


def finite(vector: str) -> Column:
    """True where the vector is there and no component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(~bad, F.lit(True))


def one_per_id(df: DataFrame, vec_id: str, vector: Column, carry: tuple = ()) -> DataFrame:
    """(vec_id, v): ids stand for one vector each; of rows that repeat an id, the smallest
    vector counts.  Rows without an id take no part."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), vector.alias("v")).where("vec_id is not null")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def meet(rows: DataFrame, queries: DataFrame, cell: str, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK):
    """Grouped sides for ``cogroup``: (rows, queries), keyed by cell and both block numbers.
    Both need ``cell`` and ``vec_id``; a query may be in several cells."""
    queries = queries.toDF(*queries.columns)  # both sides may come from one table

    def sized(df, n, name):
        counts = df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
        return counts.select(F.col(cell).alias(f"__{name}_cell"), name)

    nr, nq = sized(rows, row_block, "nr"), sized(queries, query_block, "nq")
    counts = nr.join(nq, F.col("__nr_cell") == F.col("__nq_cell")).select(F.col("__nr_cell").alias("__cell"), "nr", "nq")

    def dealt(df, own, other):
        x = df.join(counts.toDF("__cell", "nr", "nq"), F.col(cell) == F.col("__cell")).drop("__cell")
        x = x.withColumn("__own", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        x = x.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = ("__own", "__other") if own == "nr" else ("__other", "__own")
        return x.withColumn("rb", F.col(first)).withColumn("qb", F.col(second)).drop("nr", "nq", "__own", "__other")

    return (dealt(rows, "nr", "nq").groupBy(cell, "rb", "qb"), dealt(queries, "nq", "nr").groupBy(cell, "rb", "qb"))


def best(found: DataFrame, k: int, smallest: bool) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best per query, ties to smaller ids.
    ``found`` has at most k rows per query and block."""
    order = [F.col("score").asc() if smallest else F.col("score").desc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
