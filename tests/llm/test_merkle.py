import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from lacuna.llm import merkle as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.IntegerType()),
                       T.StructField("hash", T.StringType()), T.StructField("path", T.StringType()), T.StructField("kids", T.StringType())])


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(left, right) per level that has several nodes."""
    out = []
    for level in tree[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
        i //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row."""
    groups = defaultdict(list)
    for d, s, lang, n, t in rows:
        own = leaf((d, s, lang, n, t))
        touched = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t is not None
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if touched else t
        groups[lang].append((d is not None, d or 0, own, d, leaf((d, s, lang, n, low))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, own, d, other) in enumerate(sorted(groups[g])):
            steps = path(trees[g], i) + path(top, k)
            at = other
            for a, b in steps:
                at = h(a + at + b)
            out.append((d, own, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), at, at == top[-1][0]))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "p", "k") for r in rows], SCHEMA)


def rows_of(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


def docs(n, langs, text=lambda i: f"Text {i} Ä"):
    return [(i, "s", langs[i % len(langs)], i, text(i)) for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en", "de"]), (9, ["en"]), (65, ["en"]), (700, ["en", "en", "de"]), (530, ["x"]),
                                     (40, [None, "", "é", "z", "A", "a", "b", "c", "d", "e"])])
def test_equal_to_brute_force(spark, n, langs):
    rows = docs(n, langs)
    got = rows_of(M.manifest(frame(spark, rows).repartition(3)))
    assert got == brute(rows)
    touched = [zlib.crc32(str(i).encode()) % 3 == 0 for i in range(n)]
    assert sum(c for r, c in got.items() if not r[-1]) == sum(touched)


def test_more_tiers_than_one(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = docs(600, ["en", "de", "fr"])
    assert rows_of(M.manifest(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (None, None, "en", None, "-"),
            (2, "", "", 0, ""), (3, "-", "en", 3, "ABC" * 50_000), (3, "-", "en", 4, "abc"), (-5, "s", "en", 1, "Éa"), (12, "s", "en", 1, "lower only")]
    rows += [(7, "s", "en", 1, "Copy")] * 1_100  # equal rows over several blocks
    assert rows_of(M.manifest(frame(spark, rows).repartition(4))) == brute(rows)


def test_empty_table(spark):
    assert not rows_of(M.manifest(frame(spark, [])))


def test_one_changed_byte_is_seen(spark):
    rows = docs(100, ["en"])
    roots = {next(iter(rows_of(M.manifest(frame(spark, r)))))[3] for r in (rows, rows[:50] + [(50, "s", "en", 50, "Text 50 A")] + rows[51:])}
    assert len(roots) == 2


def test_children_are_reached_without_looking_up_siblings(spark):
    """Building and unfolding a block takes one exchange of its rows; no join in either."""
    nodes = spark.createDataFrame([("en", 3, 0, 1, "a"), ("en", 3, 1, 1, "b"), ("en", 3, 2, 1, "c")], "g string, size bigint, first bigint, count bigint, hash string")
    plan = M.rollup(nodes, "g", [], 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("ReusedExchange") == 1 and "Join" not in plan
