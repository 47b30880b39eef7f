import brute as B
import duckdb
import numpy as np
import pytest

from lacuna.llm import ngram_join as J
SF_MID = "/root/testdata/sf0.01"


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "copy_of", "copies", "n_links").collect()), key=str)


def test_band_plan_reaches_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = J.band_plan(t, 0.999, 128)
        assert b * r <= 128 or r == 1
        assert 1 - (1 - t ** r) ** b >= 0.999


def test_whole_table_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_MID}/documents.parquet'").fetchall()
    out = got(J.op9_ngram_jaccard(spark, SF_MID))
    want = B.jaccard_rows(rows)
    assert [r[:4] for r in out] == [r[:4] for r in want]
    assert sum(r[4] for r in out) >= 0.998 * sum(r[4] for r in want)
    assert sum(r[4] for r in want) > 10


def test_edges(spark, docs_of):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    base = [f"t{i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, "!!! ---"), (4, "one two"), (5, "One, two."), (6, "one two three"), (None, " ".join(base)),
            (8, " ".join(base)), (8, " ".join(base)), (9, " ".join(base[:-1] + ["z"])), (10, long), (11, long + " tail"), (10, "another text"),
            (12, None)]
    assert got(J.jaccard_groups(docs_of(rows))) == B.jaccard_rows(rows)


def test_empty(spark, docs_of):
    assert got(J.jaccard_groups(docs_of([]))) == []


@pytest.mark.parametrize("rows", [J.BLOCK_ROWS, 16])
def test_large_near_group_in_blocks(spark, docs_of, monkeypatch, rows):
    monkeypatch.setattr(J, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for d in range(120):
        w = list(base)
        w[rng.integers(60)] = f"u{d}"
        docs.append((d, " ".join(w)))
    out, want = got(J.jaccard_groups(docs_of(docs))), B.jaccard_rows(docs)
    assert [r[:2] for r in out] == [r[:2] for r in want]
    assert sum(r[4] for r in out) >= 0.99 * sum(r[4] for r in want)
    assert all(a[4] <= b[4] for a, b in zip(out, want))


def test_join_by_band_keeps_the_rows_of_a_large_group(spark):
    """200 classes with 8 common bands in 10 blocks: the join of bands makes a row for each
    row that it reads, and the pairs are those of joining all of them."""
    rows = [(b, f"k{k}", f"{k % 10}/0") for b in range(8) for k in range(200)] + [(100, "k1", "1/0"), (100, "x", "9/1"), (101, "x", "9/1")]
    placed = spark.createDataFrame(rows, "band long, key string, block string")
    pairs = J.block_pairs(placed)
    want = {(" ".join(sorted((block, other))), key, block) for b, key, block in rows for a, _, other in rows if a == b}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
    todo, made = [pairs._jdf.queryExecution().executedPlan().executedPlan()], []
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    assert made == [len(rows)]


def test_deduplicate_keeps_one_row_a_group(spark, docs_of):
    base = " ".join(f"t{i}" for i in range(40))
    rows = [(5, base), (3, base + " z"), (3, base + " z"), (9, "other words here"), (None, ""), (2, None), (4, "Other words, here!")]
    out = J.deduplicate(docs_of(rows)).select("doc_id", "text").collect()
    assert sorted((r[0] for r in out)) == [2, 3, 4]
    assert J.deduplicate(docs_of([])).collect() == []
