"""Merkle manifest of a table, with a proof and a tampering check for every row.

A row's leaf is H, the lowercase hex SHA-256 of its fields written as ``-`` (null) or byte
count, ``:`` and value.  Per group (language), leaves ascend by id; every 8 consecutive
nodes of a level become one node, H of their hex digests, until one is left, the subroot;
subroots, by group (null first, then UTF-8 bytes), give the root in the same way.

The tree is built by a rollup of nested structs.  Leaves get gapless ranks (ranges of the
order, prefix sums of their counts), and a rank is read as octal digits.  Inside a block of
8 ** ``LEVELS`` consecutive ranks the digit columns are grouped away one after the other, the
children becoming an array of structs inside their parent; all groupings of a block share
one partitioning, so they need one exchange.  A block's row is bounded by its 512 leaves.
Blocks are the nodes of the next tier, with their indexes as ranks, and so on up to the
subroots, whose tier is built by the same function.  A tier's nested rows then unfold from
the top by transform and explode: every step turns a node into its children, each with the
digests left and right of it, so siblings are never looked up by a join; the only joins give
a block's row the path above it, one row of the tier per 512.

Equal rows (a third of the table, say) are counted before they are sorted and repeated
afterwards, so no task sorts them.  Leaves of equal ids are ordered by leaf; null ids come
first.  A null or empty text is a field like any other.  ``-`` stands for null only, as
every value has its count.  A text may be as long as a row may be.  An empty table gives an
empty result.  Columns other than the five are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .shard_tree import _nibble_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 8
LEVELS = 3  # tree levels of a block: 512 leaves
_PATH = "array<struct<left:string,right:string>>"


def h(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def touched(doc_id: str) -> Column:
    """True where 3 divides the CRC-32 of the decimal id (a null id is never touched)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0


def lowered(text: str) -> Column:
    """A-Z alone in lower case."""
    return F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


def ranked(scratch: Scratch, nodes: DataFrame, group: str, order: list[str], count: str, name: str) -> DataFrame:
    """``nodes`` with ``first``, the number of rows of the group before each (a node stands for
    ``count`` rows), and ``size``, the rows of the group.  Ranges of (group, order) are cut
    into partitions, which are written with their numbers; a window holds one of them."""
    ranges = nodes.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    cut = scratch.write(ranges, name)
    held = cut.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.sum(count).alias("__n"))
    of_group = Window.partitionBy("__g")
    offsets = held.select("__g", "__p", F.coalesce(F.sum("__n").over(of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                          F.sum("__n").over(of_group).alias("size"))
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    return (cut.join(offsets, on).withColumn("first", F.col("__before") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
            .drop("__g", "__p", "__part", "__before"))


def _digests(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda x: x["hash"]), "")


def rollup(nodes: DataFrame, group: str, carry: list[str], level: int) -> DataFrame:
    """One row per block: group, size, rank (the block's index), hash and the nested children.
    ``nodes`` has group, size (leaves of the group), hash, the first rank it stands for and the
    count of ranks; ``level`` is the tree level of the nodes.  A level that would only wrap the
    last node of a group is passed over."""
    low, width = F.col("block") * RUN ** LEVELS, RUN ** LEVELS - 1
    end = F.col("first") + F.col("count") - 1
    spans = F.sequence(F.shiftright("first", 3 * LEVELS), F.shiftright(end, 3 * LEVELS))
    at = nodes.select(group, "size", "first", "count", "hash", *carry, F.explode(spans).alias("block")).repartition(group, "block")
    at = at.select(group, "size", "block", F.struct("hash", *carry).alias("node"),
                   F.explode(F.sequence(F.greatest("first", low), F.least(end, low + width))).alias("rank"))
    digits = [(F.shiftright("rank", 3 * i) % RUN).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    at = at.select(group, "size", "block", *digits, "node")
    for i in range(LEVELS):
        keys = [group, "size", "block", *[f"d{j}" for j in range(LEVELS - 1, i, -1)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "node.*")))
        at = at.groupBy(*keys).agg(kids.alias("kids"))
        several = F.col("size") > RUN ** (level + i)  # more than one node stands on this level
        own = F.when(several, h(_digests(F.col("kids")))).otherwise(F.col("kids")[0]["hash"])
        at = at.select(*keys, F.struct(own.alias("hash"), "kids").alias("node"))
    return at.select(group, "size", F.col("block").alias("rank"), "node.hash", "node.kids")


def unfold(blocks: DataFrame, group: str, carry: list[str], level: int, keep: list[str]) -> DataFrame:
    """The nodes below ``blocks`` (rows of :func:`rollup` with ``path``, the steps above them):
    group, rank, carried and kept columns, hash and path, a step having the digests left and
    right of the node, the lowest level first."""
    at = blocks.select(group, "size", "rank", "path", *keep, "kids")
    for i in reversed(range(LEVELS)):
        spread = F.transform("kids", lambda x: F.struct(
            x.alias("x"), _digests(F.filter("kids", lambda y: y["digit"] < x["digit"])).alias("left"),
            _digests(F.filter("kids", lambda y: y["digit"] > x["digit"])).alias("right")))
        at = at.select(group, "size", "rank", "path", *keep, F.explode(spread).alias("s"))
        step = F.when(F.col("size") > RUN ** (level + i), F.array(F.struct("s.left", "s.right"))).otherwise(F.array().cast(_PATH))
        below = ["s.x.kids"] if i else ["s.x.hash", *[f"s.x.{c}" for c in carry]]
        at = at.select(group, "size", (F.col("rank") * RUN + F.col("s.x.digit")).alias("rank"),
                       F.concat(step, F.col("path")).alias("path"), *keep, *below)
    return at.drop("size")


def tree(scratch: Scratch, nodes: DataFrame, group: str, carry: list[str], name: str):
    """(roots, paths): one row (group, hash) per group, and a function that turns paths of the
    groups (group, path, further columns) into rows of the leaves (group, rank, hash, carried
    columns, path from the leaf up, the further columns)."""
    largest = nodes.agg(F.max("size")).first()[0] or 0  # one number
    tiers = [scratch.write(rollup(nodes, group, carry, 0), f"{name}-tier0")]
    while largest > RUN ** (LEVELS * len(tiers)):
        below = tiers[-1].select(group, "size", "hash", F.col("rank").alias("first"), F.lit(1).alias("count"))
        tiers.append(scratch.write(rollup(below, group, [], LEVELS * len(tiers)), f"{name}-tier{len(tiers)}"))

    def paths(up: DataFrame) -> DataFrame:
        keep = [c for c in up.columns if c not in (group, "path")]
        up = up.withColumn("rank", F.lit(0).cast("bigint"))
        for t in reversed(range(len(tiers))):
            above = up.select(F.col(group).alias("__group"), F.col("rank").alias("__rank"), "path", *keep)
            at = tiers[t].join(above, F.col(group).eqNullSafe(F.col("__group")) & (F.col("rank") == F.col("__rank")))
            up = unfold(at, group, carry if t == 0 else [], LEVELS * t, keep)
        return up

    return tiers[-1].select(group, "hash"), paths


def manifest(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    leaf = lambda **other: h(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]))
    hashed = docs.select("lang", "doc_id", leaf().alias("hash"), F.when(touched("doc_id"), leaf(text=lowered("text"))).alias("other"))
    counted = hashed.groupBy("lang", "doc_id", "hash", "other").agg(F.count(F.lit(1)).alias("count"))
    leaves = ranked(scratch, counted, "lang", ["doc_id", "hash"], "count", "leaves")
    # a null second leaf stands for an untouched row
    subroots, below = tree(scratch, leaves, "lang", ["doc_id", "other"], "lang")
    tops = ranked(scratch, subroots.select(F.lit(0).alias("one"), "lang", "hash", F.lit(1).alias("count")), "one", ["lang"], "count", "tops")
    root, langs = tree(scratch, tops, "one", ["lang"], "top")
    starts = root.select("one", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    of_langs = langs(starts).select("lang", "path", "root", F.col("hash").alias("subroot"))
    rows = below(of_langs)
    proof = h(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("path", F.coalesce("other", "hash"), lambda at, s: h(F.concat(s["left"], at, s["right"])))
    return (rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


SQL_LEVELS = 8  # of the twin: up to 8 ** 8 rows a language


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


def _sql_crc(text: str) -> str:
    return f"""(4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
  flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT]))),
  lambda a, b: xor(a >> 4, {_nibble_table()}[xor(a & 15, b) + 1]::BIGINT)))"""


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """CTEs {name}0.. with (g, i, hash, l, r, several) per node of each level, from (g, i, hash)."""
    out = []
    for k in range(levels + 1):
        if k:
            src = f"""SELECT g, i // {RUN} AS i, CASE WHEN any_value(several) THEN sha256(string_agg(hash, '' ORDER BY i))
              ELSE any_value(hash) END AS hash FROM {name}{k - 1} GROUP BY g, i // {RUN}"""
        else:
            src = f"SELECT g, i, hash FROM {leaves}"
        side = lambda frame: f"coalesce(string_agg(hash, '') OVER (PARTITION BY g, i // {RUN} ORDER BY i ROWS BETWEEN {frame}), '')"
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT g, i, hash, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l,
          {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r, count(*) OVER (PARTITION BY g) > 1 AS several FROM ({src}))""")
    return ",\n".join(out)


def _sql_steps(src: str, name: str, levels: int, out: str) -> str:
    """CTEs that carry (cur, proof) of {src} (g, i, cur, proof, ...) up the tree {name}; the last is {out}."""
    ctes, prev = [], src
    for k in range(levels):
        cur = out if k == levels - 1 else f"{out}_{k}"
        ctes.append(f"""{cur} AS (SELECT s.* REPLACE (CASE WHEN n.several THEN sha256(n.l || s.cur || n.r) ELSE s.cur END AS cur,
          CASE WHEN n.several THEN s.proof || n.l || n.r ELSE s.proof END AS proof)
          FROM {prev} s JOIN {name}{k} n ON n.g IS NOT DISTINCT FROM s.g AND n.i = s.i // {RUN ** k})""")
        prev = cur
    return ",\n".join(ctes)


_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, {_sql_leaf('text')} AS hash,
  CASE WHEN {_sql_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0
    THEN {_sql_leaf("translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')")} END AS other FROM documents),
x AS MATERIALIZED (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS i, hash, doc_id, other FROM d),
{_sql_tree('n', 'x', SQL_LEVELS)},
y AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, hash, g AS lang FROM n{SQL_LEVELS} WHERE i = 0),
{_sql_tree('t', 'y', 3)},
s0 AS (SELECT x.g, x.i, x.doc_id, x.hash AS leaf, coalesce(x.other, x.hash) AS cur, '' AS proof FROM x),
{_sql_steps('s0', 'n', SQL_LEVELS, 's1')},
s2 AS (SELECT y.g, y.i, s1.doc_id, s1.leaf, y.hash AS subroot, s1.cur, s1.proof FROM s1 JOIN y ON y.lang IS NOT DISTINCT FROM s1.g),
{_sql_steps('s2', 't', 3, 's3')}
SELECT doc_id, leaf, subroot, t3.hash AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t3.hash AS verified
FROM s3 JOIN t3 ON t3.i = 0
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": _SQL}
