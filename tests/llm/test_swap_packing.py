import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from lacuna.llm import swap_packing as S

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType()),
                       T.StructField("length", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("bin", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows, encode, capacity=1024):
    """(doc_id, piece, start, length, crc) of every piece."""
    out = []
    for i, t in rows:
        ids = encode(t)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return Counter(out)


def check(df, rows, encode, capacity=1024):
    """Every piece once, sequences gapless and within the capacity; their number."""
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = df.collect()
    assert Counter(tuple(r)[:5] for r in got) == expected(rows, encode, capacity)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def documents():
    import duckdb
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def test_query_packs_every_piece_near_the_bound(spark, encode):
    rows = documents()
    n = check(S.op13_swap_packing(spark, SF), rows, encode)
    total = sum(r[3] * c for r, c in expected(rows, encode).items())
    assert n <= -(-total // 1024) * 1.01 + 1


def test_odd_rows(spark, encode):
    rows = [(1, None), (1, None), (None, ""), (2, ""), (3, "a <|endoftext|> b <|endoftext|>"), (4, "word " * 5_000), (5, "x" * 20_000), (6, "  \n\n \t é中文🙂"),
            (7, "don't DON'T 1234 a  b")] + [(8, "copy of one text")] * 300
    assert check(S.pack(S.pieces(frame(spark, rows))), rows, encode) >= 1
    assert S.pack(S.pieces(frame(spark, []))).count() == 0


@pytest.mark.parametrize("block", [64, 1000])
def test_small_blocks_meet_again(spark, encode, block):
    rows = documents()[:400]
    few = check(S.pack(S.pieces(frame(spark, rows).repartition(5)), block=block), rows, encode)
    total = sum(r[3] * c for r, c in expected(rows, encode).items())
    assert few <= -(-total // 1024) * 1.03 + 2


def test_document_lengths_around_the_capacity(spark, encode):
    # " a" is one id, so lengths are known
    rows = [(n, " a" * n) for n in (7, 8, 9, 15, 16, 17)]
    assert [len(encode(t)) for _, t in rows] == [8, 9, 10, 16, 17, 18]
    check(S.pack(S.pieces(frame(spark, rows), capacity=8), capacity=8), rows, encode, 8)
    assert [S.piece_spans(n, 8) for n in (1, 8, 9, 16, 17)] == [[(0, 1)], [(0, 8)], [(0, 1), (1, 8)], [(0, 8), (8, 8)], [(0, 1), (1, 8), (9, 8)]]


def test_ids_are_those_of_the_tokenizer(encode):
    """Characters of every class, among them some that ``regex`` and the tokenizer class differently."""
    rng = np.random.default_rng(2)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0x10940, 0x1F600, 0xE0100]
    texts = ["".join(map(chr, rng.choice(points, 40))) for _ in range(300)] + [f"a{chr(c)}1 {chr(c)} b" for c in points]
    own = S.TokenBytes("byte_bpe_50k.json")
    assert [list(np.frombuffer(b, "<u4")) + [2] for b in own(texts)] == [encode(t) for t in texts]
    assert own.odd.any()


def least_bins(lengths, capacity):
    """Fewest bins by exhaustive search."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_search_against_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        start = S.best_fit_decreasing(lengths, 20)
        bins = S.swap_search([list(b) for b in start], lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 20 for b in bins)
        assert squares(bins, lengths) >= squares(start, lengths)
        assert least_bins(lengths, 20) <= len(bins) <= least_bins(lengths, 20) + 1


@pytest.mark.parametrize("bins,lengths,fewer", [
    ([[0], [1], [2]], [5, 3, 2], 1),               # moves
    ([[0, 1], [2, 3], [4]], [6, 3, 4, 5, 2], 2),   # 3 for 4, then 5, 3 and 2 share a bin
    ([[0, 1], [2], [3, 4]], [5, 4, 5, 2, 3], 2),   # 4 for 5
    ([[0, 1], [2, 3, 4]], [7, 2, 4, 1, 2], 2),     # 2 for 1 + 2
])
def test_single_steps(bins, lengths, fewer):
    out = S.swap_search(bins, lengths, 10)
    assert len(out) == fewer and all(sum(lengths[i] for i in b) <= 10 for b in out)
    assert sorted(i for b in out for i in b) == list(range(len(lengths)))


def test_a_step_that_no_swap_improves_is_the_end():
    lengths = np.random.default_rng(5).integers(1, 1025, 3_000)
    once = S.swap_search(S.best_fit_decreasing(lengths.tolist(), 1024), lengths, 1024)
    again = S.swap_search([list(b) for b in once], lengths, 1024)
    assert squares(once, lengths) == squares(again, lengths)


def test_words_go_straight_to_the_merges(monkeypatch):
    """Ids of unseen words equal the tokenizer's own, without a whole encoding for each."""
    coder = S.TokenBytes(S.VOCABULARY)
    rng = random.Random(4)
    signs = [chr(p) for p in (*range(0x20, 0x250), 0x3B1, 0x416, 0x4E2D, 0x1F600, 0x0A)]
    texts = ["", "Straße naïve d'été, 42 x's\n\n  end ", *("".join(rng.choices(signs + [" "] * 200, k=300)) for _ in range(200))]
    want = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder(texts) == want
    calls = []
    monkeypatch.setattr(coder, "_encode", lambda t: calls.append(t))
    coder(["unseenword otherunseen 98765 änderung"])
    assert not calls and coder._is_byte_level()
