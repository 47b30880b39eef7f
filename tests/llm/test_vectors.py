import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from lacuna.llm import blocks, partition_ann as A, pivots as P

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("cell", T.StringType()), T.StructField("score", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)


def vectors(path=SF):
    return duckdb.sql(f"SELECT vec_id, embedding FROM '{path}/embeddings.parquet'").fetchall()


def usable(rows, zero_out):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or (zero_out and not any(v)):
            continue
        v = tuple(float(np.float32(x)) for x in v)
        seen[i] = min(seen.get(i, v), v)
    return seen


def brute(rows, every, k, measure, zero_out, smallest):
    seen = usable(rows, zero_out)
    out = []
    for q, x in sorted(seen.items()):
        if q % every:
            continue
        found = sorted(((measure(np.array(x), np.array(y)) * (1 if smallest else -1), i) for i, y in seen.items() if i != q and len(x) == len(y)))
        out += [(q, r, i, s if smallest else -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def product(x, y):
    return int(np.floor(256 * x).astype(np.int64) @ np.floor(256 * y).astype(np.int64))


def distance(x, y):
    return float(np.sqrt(((x - y) ** 2).sum()))


ODD = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]),
       (105, [1.0, 0.0]), (106, [1.0, 0.0]), (107, [0.25, -3.0]), (None, [9.0, 9.0]), (50, [0.5, 0.25]), (200, [1.0, 2.0, 3.0]), (201, [3.0, 2.0, 1.0]), (108, [])]


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_pivot_search_is_exact(spark):
    assert rows_of(P.op8_pivot_topk(spark, SF)) == brute(vectors(), 50, 5, product, False, False)


@pytest.mark.parametrize("row_block,query_block", [(8192, 2048), (40, 3)])
def test_pivot_search_in_blocks_with_structure(spark, monkeypatch, row_block, query_block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16)) * 3
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + rng.standard_normal(16) * 0.2, 1)]) for i in range(400)]
    monkeypatch.setattr(blocks.meet, "__defaults__", (row_block, query_block))
    got = rows_of(P.topk_products(frame(spark, rows), every=20, sample=64))
    assert got == brute(rows, 20, 5, product, False, False)


def test_pivots_save_evaluations():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 12)) * 200
    x = np.floor(centres[np.arange(2000) % 8] + rng.standard_normal((2000, 12)) * 10)
    far = np.sqrt(((x[:, None] - P.farthest_first(x[:300], 16)[None]) ** 2).sum(-1))
    sq, ids = (x * x).sum(1), np.arange(2000)
    out, evaluated = P.search_block(ids[:20], x[:20], sq[:20], far[:20], ids, x, sq, far, np.full(20, -np.inf), 5)
    assert evaluated < 0.5 * 20 * 2000
    for q in range(20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:5]
        assert [(i, int(s[i])) for i in want] == [(b, c) for a, b, c in out if a == q]


def test_pivot_edges(spark):
    assert rows_of(P.topk_products(frame(spark, ODD))) == brute(ODD, 50, 5, product, False, False)
    assert rows_of(P.topk_products(frame(spark, []))) == []
    few = [(i, [float(i), 1.0]) for i in range(0, 150, 50)]  # fewer candidates than k: never the query itself
    assert rows_of(P.topk_products(frame(spark, few))) == brute(few, 50, 5, product, False, False)
    with pytest.raises(Exception, match="exact integer scores"):
        P.topk_products(frame(spark, [(0, [1e12]), (1, [1e12])])).collect()


def test_long_vectors_are_scored_in_integers(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2.0]) for i in range(120)] + [(200, [2.0 ** 22, 3.0]), (201, [2.0 ** 22 + 1, -5.0]), (250, [-(2.0 ** 20), 7.0])]
    assert rows_of(P.topk_products(frame(spark, rows), sample=40)) == brute(rows, 50, 5, product, False, False)


def recall(got, want):
    want = {(q, i) for q, _, i, _ in want}
    return len({(q, i) for q, _, i, _ in got} & want) / len(want)


def test_ann_recall_and_scores(spark):
    rows = vectors()
    got, want = rows_of(A.op3_learned_partitions(spark, SF)), brute(rows, 100, 10, distance, True, True)
    assert len(got) == len(want)
    assert recall(got, want) >= 0.9
    seen = usable(rows, True)
    for q, r, i, s in got:
        assert abs(s - distance(np.array(seen[q]), np.array(seen[i]))) < 1e-12


def test_ann_visits_few_parts_of_clustered_data(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((16, 24))
    x = centres[rng.integers(16, size=3000)] + rng.standard_normal((3000, 24)) * 0.1
    router = A.fit_router(x[:2000], parts=16)
    assert router.visits(x[2000:]).mean() < 0.5
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got, want = rows_of(A.ann(frame(spark, rows), every=100, sample=1500)), brute(rows, 100, 10, distance, True, True)
    assert recall(got, want) >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(0).standard_normal((512, 8))
    size = np.bincount(A.balanced_parts(A.neighbour_graph(x, 8), 16))
    assert len(size) == 16 and size.max() - size.min() <= 4


def test_ann_edges(spark):
    got, want = rows_of(A.ann(frame(spark, ODD), every=50)), brute(ODD, 50, 10, distance, True, True)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert rows_of(A.ann(frame(spark, []))) == []
