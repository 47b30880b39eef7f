from pyspark.sql import types as T

from lacuna.llm import quotes as Q

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("level", T.IntegerType()),
                       T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])


def mail(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, {"a": "b"}) for r in rows], SCHEMA)


def run(spark, rows):
    out = Q.link_quotes(mail(spark, rows)).collect()
    return {(r["conv_id"], r["turn"]): r for r in out}, out


def test_nested_levels_and_order(spark):
    rows = [(1, 0, "a", "The first point.\nThe second point."),
            (1, 3, "b", "I agree.\n\nOn Monday, a wrote:\n> The first point.\n> The second point."),
            (1, 5, "c", ">> the FIRST point\n> I agree!\nNot me."),
            (1, 7, "d", "Le lundi, a a écrit :\n> The second point.\nBack to this."),
            (1, 9, "e", "A new topic. On time she wrote: nothing"),
            (2, 0, "f", "> The first point.\nOther thread.")]
    got, _ = run(spark, rows)
    assert [got[1, t]["parent"] for t in (0, 3, 5, 7, 9)] == [None, 0, 3, 0, None]
    assert [got[1, t]["root"] for t in (0, 3, 5, 7, 9)] == [0, 0, 0, 0, 9]
    assert [got[1, t]["depth"] for t in (0, 3, 5, 7, 9)] == [0, 1, 2, 1, 0]
    assert [got[1, t]["position"] for t in (0, 3, 5, 7, 9)] == [0, 1, 2, 3, 0]
    assert [got[1, t]["text"] for t in (3, 5, 7, 9)] == ["I agree.", "Not me.", "Back to this.", "A new topic. On time she wrote: nothing"]
    assert got[1, 5]["linked"] == 2 and got[1, 5]["quoted"] == 2
    assert got[2, 0]["parent"] is None and got[2, 0]["linked"] == 0 and got[2, 0]["text"] == "Other thread."
    assert got[1, 0]["key"] == "k" and got[1, 0]["level"] == 3 and got[1, 0]["tags"] == {"a": "b"}


def test_edges(spark):
    long = "\n".join(f"line number {i}" for i in range(5000))
    rows = [(None, 0, "a", "x y"), (None, 1, "b", "> x y\nz"), (3, None, "a", "hello there"), (3, 1, "b", "> hello there"), (4, 0, "a", None),
            (4, 1, "b", ""), (5, 0, "a", long), (5, 1, "b", "\n".join("> " + x for x in long.split("\n"))), (5, 1, "b", "> !!!\nmore"), (5, 1, "b", "> !!!\nmore"),
            (6, 0, "a", "> quoting the future"), (6, 1, "a", "quoting the future")]
    got, out = run(spark, rows)
    assert len(out) == len(rows)
    assert got[None, 1]["parent"] is None and got[3, 1]["parent"] is None and got[4, 0]["text"] == "" and got[4, 1]["depth"] == 0
    five = sorted((r["turn"], r["position"], r["linked"], r["parent"]) for r in out if r["conv_id"] == 5)
    assert [x[1] for x in five] == [0, 1, 2, 3] and all(x[2] == 5000 and x[3] == 0 for x in five[1:])
    assert got[6, 0]["parent"] is None
    assert Q.link_quotes(mail(spark, [])).count() == 0


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "a", "say 0")] + [(1, t, "a", f"> say {t - 1}\nsay {t}") for t in range(1, 300)]
    got, _ = run(spark, rows)
    assert all(got[1, t]["depth"] == t and got[1, t]["root"] == 0 and got[1, t]["position"] == t for t in range(300))


def test_only_dataframe_operations(spark):
    plan = Q.op4_quote_links(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
