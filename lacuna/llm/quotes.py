"""Quotation linking: replies are found by what they quote, and quotes are taken out.

A message's lines are parsed into quote levels (the number of ``>`` before the text; 0 is
the author's own), and a line that announces a quote is told from own text.  Every quoted
passage, which is a line as mail programs quote by lines, is normalised and hashed and
joined to the message of its thread that first said it as own text.  A message replies to
the message that most of its level-1 passages come from, ties to the later one.  Following
replies upward gives each message a root and a depth; the messages below one root form a
conversation, numbered from 0 in an order in which every message follows the one it
replies to.

All steps are DataFrame operations.  A passage meets one row, its first author, however
often it was said or quoted; numbering cuts long conversations into parts.

Rows that repeat thread and turn are one message for linking and keep a row each.  Null
threads or turns link to nothing and nothing links to them.  A null text is an empty one.
Lines without a letter or digit are quoted or own, but never linked.  A quote of something
that no earlier message said stays unlinked and is taken out all the same.  An empty table
gives an empty result.  Other columns pass through; names beginning with two underscores
are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gapless, sortable, table
from .shingles import normalised

QUOTE = r"^[ \t]*>[ \t>]*"
# How mail programs of four languages announce a quote
ANNOUNCE = r"^(On|Le|Am|El) .*(wrote|a écrit|schrieb|escribió) ?:[ \t]*$"
#: Turns of one part when a conversation is numbered.
PART = 1024


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``__lines``: per line its level (-1: announces a quote) and text."""
    split = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTE, "").alias("content")))
    cut = messages.withColumn("__cut", split)
    told = F.transform("__cut", lambda x, i: F.struct(
        F.when((x["level"] == 0) & x["content"].rlike(ANNOUNCE) & (F.coalesce(F.get("__cut", i + 1)["level"], F.lit(0)) > 0), -1)
        .otherwise(x["level"]).alias("level"), x["content"].alias("content")))
    return cut.withColumn("__lines", told).drop("__cut")


def own_text(lines: str = "__lines"):
    """The author's own lines, white space at the end removed."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"])
    return F.regexp_replace(F.array_join(own, "\n"), r"\s+$", "")


def _passages(lines: DataFrame, thread: str, turn: str) -> DataFrame:
    """thread, turn, level, key of every line with a letter or digit."""
    x = lines.select(F.col(thread).alias("thread"), F.col(turn).cast("bigint").alias("turn"), F.explode("__lines").alias("l"))
    x = x.select("thread", "turn", F.col("l.level").alias("level"), normalised(F.col("l.content")).alias("norm"))
    return (x.where("norm != '' and level >= 0 and thread is not null and turn is not null")
            .select("thread", "turn", "level", F.md5("norm").alias("key")))


def reply_links(lines: DataFrame, thread: str, turn: str, scratch: Scratch) -> DataFrame:
    """thread, turn, linked (passages found), parent (null where nothing at level 1 is)."""
    passage = scratch.write(_passages(lines, thread, turn), "passages")
    said = (passage.where("level = 0").groupBy("thread", "key").agg(F.min("turn").alias("author"))
            .toDF("__thread", "__key", "author"))
    # equal passages of a message and level count by their number
    quoted = passage.where("level > 0").groupBy("thread", "turn", "level", "key").agg(F.count(F.lit(1)).alias("n"))
    met = (quoted.join(said, (F.col("thread") == F.col("__thread")) & (F.col("key") == F.col("__key")))
           .where("author < turn"))
    by_author = met.groupBy("thread", "turn", "author").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("direct"))
    return by_author.groupBy("thread", "turn").agg(
        F.sum("n").alias("linked"),
        F.max(F.when(F.col("direct") > 0, F.struct("direct", "author"))).alias("m")).select(
        "thread", "turn", "linked", F.col("m.author").alias("parent"))


def roots(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """thread, turn, root, depth of every message with a parent, by doubling the way up;
    messages that have reached their root leave the later rounds."""
    state = scratch.write(replies.where("parent is not null").select(
        "thread", "turn", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")), "up0")
    done = state.limit(0)
    for i in range(1, 64):
        up = done.unionByName(state).toDF("__thread", "__turn", "__root", "__depth")
        nxt = state.join(up, (F.col("thread") == F.col("__thread")) & (F.col("root") == F.col("__turn")), "left")
        nxt = scratch.write(nxt.select("thread", "turn", F.coalesce("__root", "root").alias("root"),
                                       (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
                                       F.col("__root").isNotNull().alias("moved")), f"up{i}")
        done = done.unionByName(nxt.where(~F.col("moved")).drop("moved"))
        state = nxt.where("moved").drop("moved")
        if state.isEmpty():
            break
    return done


def link_quotes(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text",
                scratch: Scratch | None = None) -> DataFrame:
    """``messages`` with the quotes taken out of ``text``, and quoted (lines), linked
    (passages found), parent, root, depth and position (in the conversation of its root)."""
    scratch = scratch or Scratch(messages.sparkSession, "quotes")
    new = ["quoted", "linked", "parent", "root", "depth", "position"]
    lines = parsed(messages.drop(*new), text)
    replies = scratch.write(reply_links(lines, thread, turn, scratch), "replies")
    up = roots(replies, scratch)
    known = replies.join(up, ["thread", "turn"], "left").toDF("__thread", "__turn", "linked", "parent", "root", "depth")
    at = F.col(turn).cast("bigint")
    out = (lines.withColumn("quoted", F.size(F.filter("__lines", lambda x: x["level"] > 0)).cast("bigint"))
           .withColumn(text, own_text()).drop("__lines")
           .join(known, (F.col(thread) == F.col("__thread")) & (at == F.col("__turn")), "left").drop("__thread", "__turn")
           .withColumn("linked", F.coalesce("linked", F.lit(0)).cast("bigint"))
           .withColumn("root", F.coalesce("root", at)).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("bigint")))
    return gapless(out, [thread, "root"], F.floor(F.col(turn) / PART), [turn, *sortable(out, (thread, "root", turn))], "position")


def mailbox(turns: DataFrame) -> DataFrame:
    """Conversations as a mail archive keeps them: every message ends with the one before it
    quoted, and the one before that quoted in the quote."""
    said = (turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
            .agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("said")))

    def quote(back, mark):
        return said.select(F.col("conv_id").alias(f"__c{back}"), (F.col("turn") + back).alias(f"__t{back}"),
                           F.concat(F.lit(mark), F.replace(F.col("said"), F.lit("\n"), F.lit("\n" + mark))).alias(f"__q{back}"))

    out = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for back, mark in ((1, "> "), (2, "> > ")):
        q = quote(back, mark)
        out = out.join(q, (F.col("conv_id") == F.col(f"__c{back}")) & (F.col("turn") == F.col(f"__t{back}")), "left")
    head = F.concat(F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(" they wrote:\n"))
    full = F.concat("text", F.lit("\n\n"), head, F.col("__q1"), F.coalesce(F.concat(F.lit("\n"), F.col("__q2")), F.lit("")))
    return out.select("conv_id", "turn", "role", F.coalesce(full, "text").alias("text"))


def op4_quote_links(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quotes")
    mail = scratch.write(mailbox(table(spark, sf_dir, "conversations")), "mail")
    # -1: replies to nothing
    return link_quotes(mail, scratch=scratch).select(
        "conv_id", "turn", "role", "text", "quoted", "linked", F.coalesce("parent", F.lit(-1)).alias("parent"), "root", "depth", "position")


def _sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


# own text and quotes of the mailbox are known from its making; linking and order are not
_SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, turn, min(text) AS said FROM t WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
own AS (SELECT DISTINCT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM t),
said AS (SELECT conv_id, md5({_sql_norm('line')}) AS key, min(turn) AS author FROM own
         WHERE {_sql_norm('line')} <> '' GROUP BY 1, 2),
q AS (SELECT s.conv_id, s.turn + 1 AS turn, 1 AS level, unnest(string_split(s.said, chr(10))) AS line FROM s
      UNION ALL SELECT s.conv_id, s.turn + 2, 2, unnest(string_split(s.said, chr(10))) FROM s
      WHERE EXISTS (SELECT 1 FROM s p WHERE p.conv_id = s.conv_id AND p.turn = s.turn + 1)),
w AS (SELECT conv_id, turn, count(DISTINCT role || text) AS kinds, count(*) AS copies FROM t GROUP BY 1, 2),
l AS (SELECT q.conv_id, q.turn, q.level, author, w.copies AS n FROM q JOIN w USING (conv_id, turn)
      JOIN said ON said.conv_id = q.conv_id AND said.key = md5({_sql_norm('q.line')}) WHERE {_sql_norm('q.line')} <> '' AND author < q.turn),
a AS (SELECT conv_id, turn, author, sum(n) AS n, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS direct FROM l GROUP BY 1, 2, 3),
r AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS linked, arg_max(author, (direct, author)) FILTER (WHERE direct > 0) AS parent FROM a GROUP BY 1, 2),
up(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, parent, 1 FROM r WHERE parent IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, r.parent, up.depth + 1 FROM up JOIN r ON r.conv_id = up.conv_id AND r.turn = up.root
  WHERE r.parent IS NOT NULL),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1, 2),
m AS (SELECT t.conv_id, t.turn, t.role, regexp_replace(t.text, '\s+$', '') AS text,
        CAST(coalesce(len(string_split(p1.said, chr(10))), 0) + CASE WHEN p1.said IS NULL THEN 0 ELSE coalesce(len(string_split(p2.said, chr(10))), 0) END AS BIGINT) AS quoted,
        coalesce(r.linked, 0) AS linked, r.parent, coalesce(top.root, t.turn) AS root, CAST(coalesce(top.depth, 0) AS BIGINT) AS depth
      FROM t LEFT JOIN s p1 ON p1.conv_id = t.conv_id AND p1.turn = t.turn - 1
      LEFT JOIN s p2 ON p2.conv_id = t.conv_id AND p2.turn = t.turn - 2
      LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn LEFT JOIN top ON top.conv_id = t.conv_id AND top.turn = t.turn)
SELECT conv_id, turn, role, text, quoted, linked, coalesce(parent, -1) AS parent, root, depth,
  row_number() OVER (PARTITION BY conv_id, root ORDER BY turn, role, text) - 1 AS position FROM m
"""

QUERIES = {"op4_quote_links": op4_quote_links}
ORACLE = {"op4_quote_links": _SQL}
