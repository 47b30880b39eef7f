r"""Ranked lexical search by presence masks.

Documents are ranked for every item of a query table by the sum, over the item's terms, of
``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``
and ``m = 100 - 50 + ((50 * n * N) div L)``: N documents with a term, L terms in all, n terms
of the document, df documents with the term, tf occurrences (64-bit integers, div rounds
down).  Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII,
A-Z in lower case.

1. One pass over the whole texts counts, per document, its terms and those that some item
   holds; N, L and df follow by aggregation.
2. A task takes runs of at most ``BLOCK`` documents and turns each term's documents into a
   bitmap.  Per item, the bitmaps of its terms become one mask per document (bit j: term j is
   there), and documents are grouped by their masks.  A mask's score is at most the sum of its
   terms' largest contributions in the block.  Masks are evaluated by descending bound until
   the bound falls below the item's k-th best score so far; equal bounds are still evaluated.
   The best k carry over to the task's next block.
3. The k best of each task meet, first by item and hash of the id, then by item.

A floor of every item's k-th best score, found on about ``SAMPLE`` documents in the same way,
lets most tasks return few rows; it decides the speed alone, as do the block sizes.  Items
are dealt into blocks whose terms take at most ``ITEM_BYTES`` (an item beyond that has a
block of its own), so what a task holds of them does not grow with the query table.

Null and empty texts have no terms: such items have no results, such documents none either
and do not count in N.  Rows with equal document ids are ranked as documents of their own;
rows with equal item ids are one item with the terms of all its rows, null being an id.  Equal
scores go by ascending id, null last.  Texts may be as long as a row may be; empty tables give
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 50
BLOCK = 16_384
SAMPLE = 16_384
ITEM_BYTES = 8 << 20
#: Documents scored between two looks at the bound.
STEP = 512

#: Every byte of UTF-8 text to itself, A-Z to a-z, and ASCII that is no letter or digit to a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in their order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, terms (distinct, sorted) and their bytes, one row per id."""

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    found = (items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
             .mapInArrow(run, "item_id bigint, terms array<binary>"))
    one = found.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    return one.withColumn("bytes", F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 64))


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> int:
    """The number of blocks (by hash of the id) in which no block's terms pass ``limit``,
    unless it holds one item alone."""
    total = items.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // limit))
    while True:
        held = items.groupBy(_block(n).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items"))
        if held.where((F.col("bytes") > limit) & (F.col("items") > 1)).isEmpty():
            return n
        n *= 2


def _block(n: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(n))


def postings(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms), numbers of the wanted terms the document holds, tfs (occurrences);
    documents without any term are left out."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            row, n, sizes, which, tf = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                words = terms_of(t.as_py())
                if not words:
                    continue
                held = Counter(map(number.get, words))
                held.pop(None, None)
                row.append(i)
                n.append(len(words))
                sizes.append(len(held))
                which += held.keys()
                tf += held.values()
            at = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(which, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _length_part(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 62:  # past 64 bits: Python's integers
        return np.array([100 - 50 + (50 * int(x) * n_docs) // length for x in n], np.int64)
    return 100 - 50 + (50 * n * n_docs) // length


def masks_of(n_docs: int, postings_of: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per document: bit j is set where the j-th list holds the document."""
    words = np.zeros((max(1, -(-len(postings_of) // 64)), n_docs), np.uint64)
    for j, docs in enumerate(postings_of):
        words[j // 64, docs] |= np.uint64(1 << (j % 64))
    return words.T


def search_block(wanted: np.ndarray, starts: np.ndarray, docs: np.ndarray, values: np.ndarray, n_docs: int, ids: np.ndarray,
                 best: tuple, k: int, floor: int):
    """``best`` (scores, ids, nulls) after this block, for one item with the terms ``wanted``, and
    the number of documents scored.  ``docs`` and ``values`` hold, from ``starts[t]`` to
    ``starts[t + 1]``, the documents with term t in ascending order and its contributions."""
    lists = [(docs[starts[t]:starts[t + 1]], values[starts[t]:starts[t + 1]]) for t in wanted]
    lists = [(d, v) for d, v in lists if len(d)]
    if not lists:
        return best, 0
    masks = masks_of(n_docs, [d for d, _ in lists])
    if masks.shape[1] == 1:
        distinct, group = np.unique(masks[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(masks, axis=0, return_inverse=True)
        group = group.reshape(-1)
    bound = np.zeros(len(distinct), np.int64)
    for j, (_, v) in enumerate(lists):
        bound += ((distinct[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * int(v.max())
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    members = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[members], np.arange(len(distinct) + 1))
    sizes = ends[order + 1] - ends[order]
    at, scored = 0, 0
    while at < len(order):
        kth = best[0][-1] if len(best[0]) == k else 0
        least = max(kth, floor, 1)
        stop = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1:]) + sizes[at], STEP, "right"))
        stop = min(stop, at + int(np.searchsorted(-bound[order[at:]], -least, "right")))
        if stop <= at:
            break  # no mask left can reach the k-th best score
        part = np.sort(np.concatenate([members[ends[g]:ends[g + 1]] for g in order[at:stop]]))
        score = np.zeros(len(part), np.int64)
        for d, v in lists:
            spot = np.minimum(np.searchsorted(d, part), len(d) - 1)
            score += np.where(d[spot] == part, v[spot], 0)
        good = score >= least
        scored += len(part)
        best = _best(best, score[good], ids[0][part[good]], ids[1][part[good]], k)
        at = stop
    return best, scored


def _best(best: tuple, score, ids, null, k: int) -> tuple:
    s, i, z = (np.concatenate(x) for x in zip(best, (score, ids, null)))
    keep = np.lexsort((i, z, -s))[:k]
    return s[keep], i[keep], z[keep]


def _search(found: DataFrame, items: list, weights: np.ndarray, n_docs: int, length: int, floors: dict, k: int, block: int) -> DataFrame:
    """item (its number), doc_id, score: the k best of every task."""

    def solve(held, best):
        import pyarrow as pa
        table_ = pa.Table.from_batches(held).combine_chunks()
        doc = table_["doc_id"].combine_chunks() if table_["doc_id"].num_chunks != 1 else table_["doc_id"].chunk(0)
        null = doc.is_null().to_numpy(zero_copy_only=False)
        ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
        n = table_["n"].to_numpy()
        lists, tfs = table_["terms"].combine_chunks(), table_["tfs"].combine_chunks()
        lists, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, tfs))
        row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
        value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * _length_part(n, n_docs, length)[row]))
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        row, value = row[order], value[order]
        for j, wanted in enumerate(items):
            best[j], _ = search_block(wanted, starts, row, value, len(n), (ids, null), best[j], k, floors.get(j, 0))

    def run(batches):
        import pyarrow as pa
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best, held, n = [none] * len(items), [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == block:
                    solve(held, best)
                    held, n = [], 0
        if n:
            solve(held, best)
        for j, (s, i, z) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), j, np.int32)), pa.array(i, mask=z), pa.array(s)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best per item, first inside parts by hash of the id, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    near = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "__part").orderBy(*order))).where(F.col("rank") <= k)
    return near.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block: int = BLOCK, sample: int = SAMPLE, item_bytes: int = ITEM_BYTES,
                   scratch: Scratch | None = None) -> DataFrame:
    """item_id, rank from 1, doc_id, score: the ``k`` best documents of every item."""
    scratch = scratch or Scratch(docs.sparkSession, "mask-search")
    wanted = scratch.write(item_terms(items, item_id, item_text), "items")
    out = None
    n_blocks = item_blocks(wanted, item_bytes)
    for b in range(n_blocks):
        held = wanted.where((_block(n_blocks) == b) & (F.size("terms") > 0)).select("item_id", "terms").collect()  # bounded by item_bytes
        terms = sorted({bytes(t) for r in held for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        lists = [np.array([number[bytes(t)] for t in r["terms"]]) for r in held]
        found = scratch.write(postings(docs, terms, doc_id, text), f"postings{b}")
        n_docs, length = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())  # one row per term of the block
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(terms))], np.int64)
        some = found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(1, n_docs // sample))) == 0) if n_docs > 4 * sample else None
        floors = {}
        if some is not None:
            kth = _top(_search(some, lists, weights, n_docs, length, {}, k, block), k).where(F.col("rank") == k)
            floors = {r["item"]: r["score"] for r in kth.select("item", "score").collect()}  # one number an item
        best = scratch.write(_search(found, lists, weights, n_docs, length, floors, k, block), f"best{b}")
        scratch.drop(f"postings{b}")
        names = F.array(*[F.lit(r["item_id"]).cast("bigint") for r in held]) if held else F.array().cast("array<bigint>")
        ranked = _top(best, k).select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op11_mask_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_SQL_TERMS} AS terms FROM documents),
o AS MATERIALIZED (SELECT d, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
p AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM t) GROUP BY d, term),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS len FROM o),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
s AS (SELECT i.item_id, o.d, any_value(o.doc_id) AS doc_id,
    CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * o.n * g.docs) // g.len))))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN o USING (d), g GROUP BY i.item_id, o.d),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op11_mask_search": op11_mask_search}
ORACLE = {"op11_mask_search": _SQL}
