"""N-gram Jaccard self-join by MinHash banding.

Texts are normalised (lower case, letters and digits, single spaces); equal normalised
texts form one class and only classes are compared.  Every class gets MinHash bands, whose
number and rows are chosen so that a pair at the threshold shares a band with at least the
target probability.  Classes are shuffled on their band hashes; those that share a band are
compared on their full sets of word n-grams, every such pair exactly once.

No pair becomes a row.  Classes are dealt into blocks of at most ``BLOCK_ROWS`` classes and
``BLOCK_GRAMS`` n-grams around their most common band, and a task holds one block, or two
that share a band; it returns, per class, the number of verified partners and the smallest
partner reachable inside the task.  Those links, one per class and task, are joined into
groups by :mod:`components`.

Texts without a letter or digit have no n-grams: they are linked to equal texts only (null
counts as the empty text).  Texts of one to four words have one n-gram, all their words.
Rows that repeat an id keep a row each, and a class's id is the smallest document id in it
(null where it has no other).  An empty table gives an empty result.  Other columns are
not read, and names beginning with two underscores are reserved.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components
from .shingles import mix64, ngrams, normalised, words

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 128
SEED = 9
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1_000_000
#: n-grams of a task that are laid out as columns at once: a matrix of 2048 x 2048 floats.
COLUMNS = 2048


def band_plan(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective plan, so the most rows, that reaches the recall at
    the threshold with at most ``hashes`` hash values."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N, seed: int = SEED) -> DataFrame:
    """doc_id, key (of the normalised text), bands; no bands for texts without n-grams."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sign(batches):
        import pyarrow as pa
        for batch in batches:
            total = batch.num_rows
            out = np.zeros((total, bands), np.uint64)
            some = np.zeros(total, bool)
            for i, j, hashes, bounds in words(batch.column("norm")):
                grams, gb = ngrams(hashes, bounds, n)
                full = np.flatnonzero(np.diff(gb))
                if not len(full):
                    continue
                some[i + full] = True
                at = gb[full]
                for band in range(bands):
                    acc = np.full(len(full), salt[band], np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        acc = mix64(acc ^ np.minimum.reduceat(grams * mul[k] + add[k], at))
                    out[i + full, band] = acc
            lengths = np.where(some, bands, 0)
            values = pa.array(out[some].reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], ["doc_id", "key", "bands"])

    return with_norm(docs).mapInArrow(sign, "doc_id long, key string, bands array<long>")


def with_norm(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised("text").alias("norm")).withColumn("key", F.md5("norm"))


def gram_sets(normed: DataFrame, n: int = N) -> DataFrame:
    """key, grams: the sorted distinct n-gram hashes, 8 bytes each."""

    def collect(batches):
        import pyarrow as pa
        for batch in batches:
            keys, sets = batch.column("key").to_pylist(), []
            for _, _, hashes, bounds in words(batch.column("norm")):
                grams, gb = ngrams(hashes, bounds, n)
                sets += [np.unique(grams[a:b]).tobytes() for a, b in zip(gb[:-1], gb[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets, pa.binary())], ["key", "grams"])

    return normed.select("key", "norm").mapInArrow(collect, "key string, grams binary")


# ---- inside a task: one block, or two ---------------------------------------------------

def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[i]] and sets[right[i]]."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    # many pairs in one block: counts by matrix products, a slice of the n-grams at a time
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    used, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    shared = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        rows = place[owner[a:b]]
        here = rows >= 0
        m = np.zeros((len(used), COLUMNS), np.float32)
        m[rows[here], column[a:b][here] - lo] = 1
        present = np.flatnonzero(m.any(axis=1))
        part = m[present]
        shared[np.ix_(present, present)] += part @ part.T
    half = len(left)
    return np.rint(shared[inverse[:half], inverse[half:]]).astype(np.int64)


def candidates(bands: np.ndarray, block: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) that share a band; with ``both`` only pairs across the blocks."""
    n, left, right = len(bands), [], []
    if n <= 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.zeros((n, n), bool) if n > 24 else None
    for k in range(bands.shape[1]):
        order = np.argsort(bands[:, k], kind="stable")
        v = bands[order, k]
        cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                same = np.sort(order[a:b])
                if hit is not None:
                    hit[np.ix_(same, same)] = True
                else:
                    x, y = np.triu_indices(len(same), 1)
                    left.append(same[x])
                    right.append(same[y])
    if hit is not None:
        left, right = np.nonzero(np.triu(hit, 1))
    elif left:
        pairs = np.unique(np.concatenate(left) * n + np.concatenate(right))
        left, right = pairs // n, pairs % n
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if both:
        across = block[left] != block[right]
        left, right = left[across], right[across]
    return left, right


def verify_block(keys, blocks, bands, sets, both: bool, threshold: float) -> list[tuple]:
    """(key, root, links) of every class with a verified partner in this task."""
    left, right = candidates(bands, blocks, both)
    if not len(left):
        return []
    size = np.array([len(s) for s in sets])
    fits = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
    left, right = left[fits], right[fits]
    if not len(left):
        return []
    shared = shared_counts(sets, left, right)
    near = shared >= threshold * (size[left] + size[right] - shared) - 1e-9
    left, right = left[near], right[near]
    links = np.bincount(np.concatenate([left, right]), minlength=len(keys))
    root = np.arange(len(keys))
    while True:  # smallest linked index, pairs processed as arrays
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if (root == before).all():
            break
    return [(keys[i], keys[root[i]], int(links[i])) for i in np.flatnonzero(links)]


def _verify(threshold: float):
    def run(batches):
        import pandas as pd

        def flush(rows):
            pair = rows[0][0]
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])
            both = pair.split(" ")[0] != pair.split(" ")[1]
            if len(rows) < 2:
                return []
            return verify_block([r[1] for r in rows], np.array([r[2] for r in rows], object),
                                np.array([r[3] for r in rows], np.int64), [np.frombuffer(r[4], np.uint64) for r in rows],
                                both, threshold)

        held, out = [], []
        for batch in batches:
            cols = [batch.column(c) for c in ("pair", "key", "block", "bands", "grams")]
            for row in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2].to_pylist(), cols[3].to_pylist(), cols[4].to_pylist()):
                if held and held[0][0] != row[0]:
                    out += flush(held)
                    held = []
                held.append(row)
            if out:
                yield _links(out)
                out = []
        if held:
            out += flush(held)
        if out:
            yield _links(out)

    def _links(rows):
        import pyarrow as pa
        k, r, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(n, pa.int64())], ["key", "root", "links"])

    return run


# ---- the join ---------------------------------------------------------------------------

def block_pairs(placed: DataFrame) -> DataFrame:
    """pair, key, block: every class once for each block that shares a band with it, its own
    too.  A band's blocks (one for up to ``BLOCK_ROWS`` classes) are a list, so the join by
    band keeps the rows of ``placed`` (band, key, block), and the lists of a class's bands
    become one before they are spread out."""
    others = placed.groupBy(F.col("band").alias("b")).agg(F.collect_set("block").alias("others"))
    met = (placed.join(others, F.col("band") == F.col("b")).groupBy("key", "block")
           .agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")))
    pair = F.concat_ws(" ", F.least("block", "other"), F.greatest("block", "other"))
    return met.select("key", "block", F.explode("others").alias("other")).select(pair.alias("pair"), "key", "block")


def jaccard_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
                   max_hashes: int = MAX_HASHES, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the normalised text), class_id (smallest id
    of the group of linked classes), copy_of (smallest id with an equal normalised text),
    copies, n_links (verified classes other than its own), first (its class holds class_id)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    bands, rows = band_plan(threshold, recall, max_hashes)
    signed = scratch.write(signatures(docs, bands, rows, n, seed), "signed")
    classes = scratch.write(signed.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("copies"),
                                                      F.first("bands").alias("bands")), "classes")
    exploded = classes.select("key", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = scratch.write(exploded.join(shared, "band"), "member")
    candidate = member.groupBy("key").agg(F.max(F.struct("n", "band")).alias("home"))

    # full n-gram sets of one document of every candidate class
    chosen = classes.join(candidate, "key").select("key", "bands", "home", "copy_of")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__id"), "text")
    ids = chosen.select(F.col("copy_of").alias("__id"), F.col("key").alias("__want"))
    found = texts.join(ids, texts["__id"].eqNullSafe(ids["__id"]))
    normed = (found.select("__want", normalised("text").alias("norm")).withColumn("key", F.md5("norm"))
              .where("key = __want").dropDuplicates(["key"]))
    sets = scratch.write(gram_sets(normed, n).join(chosen.select("key", "bands", "home"), "key"), "sets")

    # blocks: classes around one band, as many as the count and the n-grams of that band need
    weight = sets.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("grams") / 8).alias("g"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("g") / BLOCK_GRAMS), F.lit(1))
    block = F.concat_ws("/", F.col("home.band").cast("string"), F.pmod(F.xxhash64("key"), parts).cast("string"))
    blocks = scratch.write(sets.join(weight, "home").select("key", block.alias("block")), "blocks")
    placed = scratch.write(member.select("band", "key").join(blocks, "key"), "placed")
    dealt = (block_pairs(placed).join(sets.select("key", "bands", "grams"), "key")
             .repartition("pair").sortWithinPartitions("pair"))
    links = scratch.write(dealt.mapInArrow(_verify(threshold), "key string, root string, links long"), "links")

    labels = components(links, scratch, "key", "root")
    per_class = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    grouped = (classes.select("key", "copy_of", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left")
               .join(per_class, "key", "left"))
    order = F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "key")
    smallest = grouped.where("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    grouped = grouped.join(smallest, "label", "left")
    grouped = grouped.select(
        "key", "copy_of", "copies", F.when(F.col("first").isNull(), F.col("copy_of")).otherwise(F.col("first.copy_of")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(F.col("key") == F.col("first.key"), F.lit(True)).alias("first"))
    grouped = scratch.write(grouped, "grouped")
    out = signed.select("doc_id", "key").join(grouped, "key").select("doc_id", "key", "class_id", "copy_of", "copies", "n_links", "first")
    scratch.drop("member", "sets", "blocks", "placed", "links", "classes")
    return out


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each group of linked texts: a row with the group's smallest
    id; blank texts are one group."""
    groups = jaccard_groups(docs, **how)
    stays = (groups.where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id")))
             .select(F.col("doc_id").alias("__id"), F.col("key").alias("__want")).distinct())
    own = docs.withColumn("__key", F.md5(normalised("text")))
    met = own.join(stays, (F.col("__key") == F.col("__want")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), "left_semi")
    return met.dropDuplicates(["__key"]).drop("__key")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "copies", "n_links")


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
ORACLE = {}
