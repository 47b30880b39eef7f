"""Packing into optimal length buckets.

Texts are cut into pieces of at most ``max_len`` tokens, so that nothing is lost and the
histogram of piece lengths has at most ``max_len`` entries whatever the corpus.  Over that
histogram of all pieces a dynamic program chooses the ``buckets`` upper bounds with the
least padding (each piece is padded to its bucket's bound).  Inside a bucket, pieces take
gapless numbers in a hash order, and every ``budget // bound`` of them form one batch, so a
batch holds at most ``budget`` tokens, padding included; only a bucket's last batch may
have fewer pieces.

Tokens are runs of characters other than the space, unless a column of token counts is
named.  Null and blank texts have no tokens and give no pieces; rows with equal ids are
packed as rows of their own; fewer distinct lengths than buckets give one bucket per
length; an empty table gives an empty result.  Other columns are not read, and names
beginning with two underscores are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gapless, table

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 32_768
SEED = 31


def word_count(text: str) -> Column:
    """Runs of characters other than space, tab and line ends, counted without splitting."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\r", "   "))
    # a run begins where a space is followed by another character
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("bigint")


def bucket_bounds(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds (each one of the lengths, the last the longest) with the least total
    padding, by dynamic programming over the sorted histogram; ties to smaller bounds."""
    order = np.argsort(lengths)
    l, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(l)
    if n == 0:
        return []
    # padded size of pieces i..j-1 in one bucket is l[j-1] * (pieces); their true size is the same for every choice
    before = np.concatenate([[0], np.cumsum(c)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        nxt, cut = best.copy(), np.full(n + 1, -1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + l[j - 1] * (before[j] - before[:j])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], cut[j] = cost[i], i
        best = nxt
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            bounds.append(int(l[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokens: str | None = None,
           max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece from 0, start (first token), length: spans that cover every token once."""
    n = F.col(tokens).cast("bigint") if tokens else word_count(text)
    counted = docs.select(F.col(doc_id).alias("doc_id"), n.alias("__n")).where("__n > 0")
    last = F.floor((F.col("__n") - 1) / F.lit(max_len)).cast("bigint")
    return (counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .select("doc_id", "piece", (F.col("piece") * max_len).alias("start"),
                    F.least(F.lit(max_len).cast("bigint"), F.col("__n") - F.col("piece") * max_len).alias("length")))


def pack(cut: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """``cut`` (from :func:`pieces`) with bucket, padded, batch, position in the batch."""
    # at most max_len rows reach the driver: the histogram of lengths up to max_len
    hist = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    bounds = bucket_bounds([r["length"] for r in hist], [r["n"] for r in hist], buckets)
    bound = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds] or [F.lit(0)]).cast("array<bigint>"),
                                  lambda b: b >= F.col("length")), 1)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    placed = cut.withColumn("padded", bound).withColumn("__key", key)
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("bigint")
    numbered = gapless(placed, ["padded"], F.substring("__key", 1, 3), ["__key", "doc_id", "piece", "length"], "__slot")
    return (numbered.withColumn("bucket", F.array_position(F.array(*[F.lit(b) for b in bounds] or [F.lit(0)]).cast("array<bigint>"), F.col("padded")).cast("int") - 1)
            .select("doc_id", "piece", "start", "length", "bucket", "padded",
                    F.floor(F.col("__slot") / rows).cast("bigint").alias("batch"), (F.col("__slot") % rows).alias("position")))


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(Scratch(spark, "pack").write(pieces(table(spark, sf_dir, "documents")), "pieces"))


QUERIES = {"op6_length_buckets": op6_length_buckets}
ORACLE = {}
