"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its share of the target size divided by its own
size.  A document draws one uniform number from the hash of (seed, doc_id) and inverts the
Poisson distribution with its source's rate at that number; it is then repeated that many
times, each copy numbered, and all copies are put in one global hash order.

Sizes are UTF-8 bytes of whole texts, counted over all documents.  A null source is a
source of its own; a null text has size 0; rows with equal ids draw alike; a source of
size 0 has rate 0 and gives no rows, and so does a source of weight 0; an empty table gives
an empty result.  Columns other than id, source and text pass through unchanged; names
beginning with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, draw, sql_draw, table, text_bytes

SEED = 23
#: Default target weights: a source weighs its size to this power (1 keeps the shares).
TEMPERATURE = 0.5
#: Target size as a multiple of the input's.
EPOCHS = 1.0
#: Tables of rates up to this many sources are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS,
                 temperature: float = TEMPERATURE, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: ``__source``, size, weight (normalised), rate.

    ``weights`` (source, weight) overrides the temperature weights; sources that it does
    not name get weight 0."""
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(text_bytes(text)).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        sizes = (sizes.join(w, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
                 .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    total = sizes.agg(F.sum("size").alias("__all"), F.sum("weight").alias("__w"))
    # one row of totals: bounded
    return (sizes.join(F.broadcast(total))
            .select("__source", "size", F.expr("try_divide(weight, __w)").alias("weight"),
                    F.coalesce(F.expr(f"try_divide(try_divide(weight, __w) * __all * {float(epochs)!r}D, size)"), F.lit(0.0)).alias("rate")))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ... as an array, far enough
    into the tail (mean + 12 standard deviations + 40) that no 52-bit draw lies beyond."""
    far = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    # running (log of k!, sum of the probabilities so far), in log space: large rates don't underflow
    start = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("out"))

    def step(acc, k):
        f = acc["f"] + F.when(k > 0, F.ln(k.cast("double"))).otherwise(F.lit(0.0))
        p = F.exp(k * F.ln(rate) - rate - f)
        return F.struct(f.alias("f"), (acc["c"] + p).alias("c"), F.concat(acc["out"], F.array(acc["c"] + p)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), far), start, step, lambda a: a["out"])).otherwise(
        F.array(F.lit(1.0)))


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, doc_id: str = "doc_id", source: str = "source",
        scratch: Scratch | None = None) -> DataFrame:
    """Every document as often as it draws: the input's columns, ``copy`` from 0 and
    ``mix_key``, in the global order of ``mix_key``."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    steps = scratch.write(rates.select("__source", poisson_steps(F.col("rate")).alias("__steps")), "rates")
    if steps.count() <= BROADCAST_SOURCES:  # counted: a bounded table
        steps = F.broadcast(steps)
    drawn = (docs.join(steps, F.col(source).eqNullSafe(F.col("__source")))
             .withColumn("__u", draw(seed, "poisson", doc_id))
             .withColumn("__n", F.size(F.filter("__steps", lambda c: c <= F.col("__u"))))
             .where("__n > 0"))
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                                                           F.col("copy").cast("string"))))
    return keyed.drop("__source", "__steps", "__u", "__n").orderBy("mix_key")


def op10_poisson_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs, source_rates(docs))
    return out.select("doc_id", "source", "text", "copy", "mix_key")


_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS DOUBLE) AS size
               FROM documents GROUP BY source),
tot AS (SELECT sum(size) AS a, sum(pow(size, {TEMPERATURE})) AS w FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) / w * a * {EPOCHS!r} / size ELSE 0 END AS rate
          FROM sizes, tot),
steps AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS f
          FROM rates, (SELECT unnest(range(2000))::DOUBLE AS k) WHERE rate > 0 AND k <= rate + 12 * sqrt(rate) + 40),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
up AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.text, len(list_filter(cs, lambda c: c <= {sql_draw(SEED, 'poisson', 'd.doc_id')})) AS n
          FROM documents d JOIN up ON d.source IS NOT DISTINCT FROM up.source)
SELECT doc_id, source, text, copy, md5(concat_ws('|', '{SEED}|order', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(copy AS VARCHAR))) AS mix_key
FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS copy FROM drawn WHERE n > 0)
"""

QUERIES = {"op10_poisson_mix": op10_poisson_mix}
ORACLE = {"op10_poisson_mix": _SQL}
