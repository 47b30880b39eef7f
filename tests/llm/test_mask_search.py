import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from lacuna.llm import mask_search as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("terms", T.StringType()),
                     T.StructField("item_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("n", T.LongType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bytes", T.LongType())])


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        found = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS))


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in df.collect())


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéüß"), 3)) for _ in range(120)]
    docs = [(int(i), " ".join(rng.choice(words[:40] if i % 3 else words, rng.integers(1, 60)))) for i in range(n)]
    items = [(j, " ".join(rng.choice(words, rng.integers(1, 30)))) for j in range(8)] + [(8, " ".join(words))]  # more than 64 terms
    return docs, items


ODD = [(1, None), (2, ""), (3, "... --- !"), (4, "Word wörd WÖRD 42"), (4, "Word wörd WÖRD 42"), (None, "word"), (5, "word\x00word\nword\ttail"),
       (6, "word " * 30_000), (7, "İstanbul ſ K word"), (9, "rare"), (10, "rare"), (11, "naïve_word-word's")]
ODD_ITEMS = [(0, "word 42"), (0, "rare"), (None, "WORD word tail"), (2, None), (3, "?!"), (4, "never seen"), (5, "wörd WÖRD istanbul"), (6, "")]


@pytest.mark.parametrize("block,sample,item_bytes", [(16_384, 16_384, 8 << 20), (37, 20, 500)])
def test_equal_to_brute_force(spark, block, sample, item_bytes):
    docs, items = corpus(400)
    d, i = frames(spark, docs, items)
    got = rows_of(M.rank_documents(d.repartition(3), i, k=7, block=block, sample=sample, item_bytes=item_bytes))
    assert got == brute(docs, items, 7)


def test_odd_rows(spark):
    d, i = frames(spark, ODD, ODD_ITEMS)
    assert rows_of(M.rank_documents(d, i)) == brute(ODD, ODD_ITEMS)
    assert rows_of(M.rank_documents(d, i, k=2, block=2)) == brute(ODD, ODD_ITEMS, 2)


def test_empty_tables(spark):
    d, i = frames(spark, ODD, ODD_ITEMS)
    assert not rows_of(M.rank_documents(d.limit(0), i))
    assert not rows_of(M.rank_documents(d, i.limit(0)))


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x250))) + " Ünï 12AZ"
    assert [t.decode() for t in M.terms_of(text)] == terms(text)


def test_masks_save_scores():
    """A rare term decides: groups of common terms only are never scored."""
    rng = np.random.default_rng(0)
    n = 10_000
    lists = [np.sort(rng.choice(n, size, replace=False)) for size in (9_000, 8_000, 60)]
    values = [np.full(len(x), v, np.int64) for x, v in zip(lists, (10, 11, 5_000))]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    best, scored = M.search_block(np.arange(3), starts, np.concatenate(lists), np.concatenate(values), n, (np.arange(n), np.zeros(n, bool)), none, 50, 0)
    assert len(best[0]) == 50 and scored < 1_000 and best[0].min() >= 5_000


def test_lengths_past_64_bits():
    n = np.array([1, 1 << 50], np.int64)
    assert list(M._length_part(n, 1 << 20, 1 << 52)) == [50 + (50 * int(x) * (1 << 20)) // (1 << 52) for x in n]
