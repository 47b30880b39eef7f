import math
from collections import Counter, defaultdict

import brute as B
import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import mixing as M
from lacuna.llm import packing as P

SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_have_the_least_padding(hist, buckets):
    bounds = P.bucket_bounds(list(hist), list(hist.values()), buckets)
    assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == max(hist)
    cost = sum(n * min(b for b in bounds if b >= x) for x, n in hist.items())
    assert cost == B.least_padding(list(hist), list(hist.values()), buckets)


def test_no_bounds_of_nothing():
    assert P.bucket_bounds([], []) == []


def check_pack(rows, texts, max_len, buckets, budget):
    spans = defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["length"], r["piece"]))
    words = Counter()
    for d, t in texts:
        words[d] += len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ").count("")
    assert {d: n for d, n in words.items() if n} == {d: sum(x[1] for x in s) for d, s in spans.items()}
    for s in spans.values():
        assert all(x[0] == x[2] * max_len and 0 < x[1] <= max_len for x in s)
    hist = Counter(r["length"] for r in rows)
    bounds = P.bucket_bounds(list(hist), list(hist.values()), buckets)
    batches = defaultdict(list)
    for r in rows:
        assert r["padded"] == min(b for b in bounds if b >= r["length"]) == bounds[r["bucket"]]
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in batches.items():
        room = max(1, budget // bounds[bucket])
        assert sorted(m["position"] for m in members) == list(range(len(members)))
        assert len(members) <= room
        last = max(b for k, b in batches if k == bucket)
        assert len(members) == room or batch == last
    for k in {k for k, _ in batches}:
        assert sorted(b for x, b in batches if x == k) == list(range(sum(x == k for x, _ in batches)))


def test_pack_whole_table(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check_pack(P.op6_length_buckets(spark, SF).collect(), texts, P.MAX_LEN, P.BUCKETS, P.BUDGET)


def test_pack_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b  c"), (5, " ".join(["w"] * 1003)), (6, "x\ty\nz")]
    out = P.pack(P.pieces(docs_of(rows), max_len=10), buckets=3, budget=25).collect()
    check_pack(out, rows, 10, 3, 25)
    assert P.pack(P.pieces(docs_of([]))).count() == 0
    small = P.pack(P.pieces(docs_of(rows), max_len=10), buckets=3, budget=4).collect()
    check_pack(small, rows, 10, 3, 4)


def test_pack_takes_given_token_counts(spark, docs_of):
    df = docs_of([(1, "x"), (2, "y")]).withColumn("tokens", F.col("doc_id") * 7)
    assert sorted((r["doc_id"], r["length"]) for r in P.pieces(df, tokens="tokens", max_len=100).collect()) == [(1, 7), (2, 14)]


def test_mix_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    rates = B.mixing_rates(rows)
    want = Counter()
    for d, t, s in rows:
        want[d] += B.poisson_count(rates[s], B.draw(M.SEED, "poisson", d))
    out = M.op10_poisson_mix(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == +want
    assert [r["mix_key"] for r in out] == sorted(r["mix_key"] for r in out)
    copies = defaultdict(list)
    for r in out:
        copies[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())


def test_poisson_steps_at_all_rates(spark):
    for rate in (0.0, 1e-9, 0.3, 1.0, 17.5, 900.0, 5000.0):
        steps = spark.range(1).select(M.poisson_steps(F.lit(rate)).alias("c")).first()["c"]
        assert abs(steps[-1] - 1) < 1e-9 and all(b >= a for a, b in zip(steps, steps[1:]))
        for u in (0.0, 0.1, 0.5, 0.93, 1 - 2 ** -40):
            k = B.poisson_count(rate, u)
            assert sum(c <= u for c in steps) == k or (rate > 0 and abs(steps[min(k, len(steps) - 1)] - u) < 1e-9)


def test_mix_meets_target_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'b' end").alias("source"),
                                    F.lit("four words of text").alias("text"))
    weights = spark.createDataFrame([("hot", 1.0), ("b", 3.0), ("absent", 4.0)], "source string, weight double")
    out = Counter(r["source"] for r in M.mix(df, M.source_rates(df, weights, epochs=2.0)).select("source").collect())
    assert set(out) == {"hot", "b"}  # the null source is given no weight
    assert abs(out["hot"] - 15_000) < 5 * math.sqrt(15_000) and abs(out["b"] - 45_000) < 5 * math.sqrt(45_000)


def test_mix_edges(spark, docs_of):
    rows = [(i, "text of ten", "s") for i in range(40)] + [(None, "x" * 300_000, None), (99, None, "empty"), (7, "text of ten", "s")]
    df = docs_of(rows)
    out = M.mix(df, M.source_rates(df, epochs=3.0)).collect()
    n = Counter(r["doc_id"] for r in out)
    assert n[99] == 0 and n[7] % 2 == 0
    assert all(r["key"] == "k" and r["n"] == 2 for r in out)
    assert M.mix(docs_of([]), M.source_rates(docs_of([]))).count() == 0
    nothing = docs_of([(1, None, "a"), (2, "", "b")])
    assert M.mix(nothing, M.source_rates(nothing)).count() == 0
    assert np.isfinite([r["rate"] for r in M.source_rates(nothing).collect()]).all()
