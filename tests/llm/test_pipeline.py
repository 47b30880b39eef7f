"""The pipeline against plain versions of its stages, each on its own input."""

from collections import Counter

import brute as B
from pyspark.sql import types as T

import corpus_pipeline as C
from lacuna.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select(*C.COLUMNS).collect()]


def expected(name, spark, docs, rows):
    """Rows that a stage should return for the rows that it got."""
    if name == "quality classifier":
        keep = Counter(tuple(r[c] for c in C.COLUMNS) for r in quality.classify(docs).where("score >= 0.5").collect())
        return keep
    if name == "line dedup":
        marks, _ = B.line_marks([(r[0], r[1]) for r in rows], bits=None)
        out = []
        for d, t, lang, source, n in rows:
            flags = marks[d, t]
            if all(flags):
                out.append((d, t, lang, source, n))
            else:
                cut = B.dedup_text(t, flags)
                if B.norm(cut):
                    out.append((d, cut, lang, source, len(cut)))
        return Counter(out)
    if name == "n-gram Jaccard join":
        groups = B.jaccard_rows([(r[0], r[1]) for r in rows])
        stays = {c for _, c, *_ in groups}
        return Counter(r for r in set(rows) if r[0] in stays)
    rates = B.mixing_rates([(r[0], r[1], r[3]) for r in rows])
    out = Counter()
    for r in rows:
        out[r] += B.poisson_count(rates[r[3]], B.draw(mixing.SEED, "poisson", r[0]))
    return +out


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            words = Counter()
            for r in rows_of(docs):
                words[r[0]] += len((r[1] or "").split())
            got = Counter()
            for r in out.collect():
                got[r["doc_id"]] += r["length"]
                assert r["padded"] >= r["length"] and r["position"] < max(1, packing.BUDGET // r["padded"])
            assert got == +words
            return
        out.write.parquet(str(tmp_path / str(i)))
        got = spark.read.parquet(str(tmp_path / str(i)))
        assert got.columns == C.COLUMNS
        assert Counter(rows_of(got)) == expected(name, spark, docs, rows_of(docs)), name
        assert got.count() > 0
        docs = got


def test_run_is_the_stages(spark):
    out = C.run(spark, SF)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "bucket", "padded", "batch", "position"}
    assert out.count() > 0


def test_odd_and_empty_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                           T.StructField("keep", T.StringType())])
    good = "The river and the town lie in the valley, and it is known for the mill. It was built by the old road."
    odd = [(i, f"{good} It is number{i} of the row, and as such the {i * 7}th.\n{good}", "en", None if i % 3 else "s", 5, "x", "y") for i in range(30)]
    odd += [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y"), (2, good, "en", "s", 3, "x", "y"), (2, good, "en", "s", 3, "x", "y"),
            (40, good * 2000, "en", "t", None, "x", "y")]
    for name, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        n = C.run(spark, str(tmp_path / name)).count()
        assert (n > 0) == bool(rows)
