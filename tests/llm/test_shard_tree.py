import math
import zlib

import brute as B
import pytest
from pyspark.sql import functions as F

from lacuna.llm import shard_tree as S

SF = "/root/testdata/sf0.01"


def descend(key, tree, seed=S.SEED):
    """The tree walked one key at a time."""
    at = ""
    for step in (lambda r, k, s: f"r{r}", lambda r, k, s: f"/k{k}", lambda r, k, s: f"/s{s}"):
        kids = {}
        for r, k, s, w in tree:
            path = [f"r{r}", f"r{r}/k{k}", f"r{r}/k{k}/s{s}"]
            child = at + step(r, k, s)
            if child in path and w:
                kids[child] = kids.get(child, 0) + w
        at = min((-math.log(B.draw(seed, "tree", c, key) + 2 ** -53) / w, c) for c, w in kids.items())[1]
    return int(at.rsplit("/s", 1)[1])


def placed(spark, n, tree):
    df = spark.range(n).withColumn("shard", S.shard_of(F.col("id"), tree))
    return {r["id"]: r["shard"] for r in df.collect()}


def test_query(spark):
    rows = S.op5_shard_tree(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
    assert any(r["grown_shard"] == 24 for r in rows)
    for r in rows[:60]:
        assert r["shard"] == descend(r["doc_id"], S.topology(24))


def test_weights_are_met_and_movement_is_confined(spark):
    n = 20_000
    tree = [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 2.0), (1, 2, 3, 1.0), (1, 2, 4, 0.0), (1, 3, 5, 1.0)]
    before = placed(spark, n, tree)
    for _, _, s, w in tree:
        assert abs(sum(v == s for v in before.values()) / n - w / 8) < 0.012
    heavier = [(r, k, s, w * 2 if s == 0 else w) for r, k, s, w in tree]
    after = placed(spark, n, heavier)
    moved = {(before[i], after[i]) for i in range(n) if before[i] != after[i]}
    # rows enter rack 0 of region 0, or change inside it towards the heavier shard; nothing else moves
    assert moved and all(b in (0, 1, 2) for _, b in moved)
    assert not any(a in (3, 5) and b in (3, 5) for a, b in moved) and not any(a == 2 and b == 2 for a, b in moved)
    assert all(b == 0 for a, b in moved if a == 1)


@pytest.mark.parametrize("n", [8, 16, 24])
def test_a_shard_with_a_subtree_of_its_own_takes_rows_only_into_itself(spark, n):
    before, after = placed(spark, 4000, S.topology(n)), placed(spark, 4000, S.topology(n + 1))
    assert all(after[i] in (before[i], n) for i in before)
    assert 0.5 < sum(v == n for v in after.values()) / (4000 / (n + 1)) < 1.6


def test_edges(spark, docs_of):
    rows = [(None, "a"), (None, None), (1, ""), (1, ""), (2, "é" * 50_000)]
    df = S.slots(S.place(docs_of(rows), "doc_id", S.topology(3)), "doc_id")
    out = df.collect()
    assert len(out) == 5 and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert S.slots(S.place(docs_of([]), "doc_id", S.topology(3)), "doc_id").count() == 0
