"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard.  At every node each child makes one weighted
draw, ``-ln(u) / weight`` with u hashed from the row's key and the child's path, and the
smallest draw wins, so a child is chosen in proportion to its weight.  A child's draw
depends on nothing but the key, its path and its weight: when a weight changes, rows move
only into (or out of) the subtree that holds the change, and below every unchanged node
nothing moves.  A new shard that opens a subtree of its own takes rows into itself only.

Null keys read as '' and share one place; rows with equal keys always share a shard; a
child of weight zero takes no rows; an empty table gives an empty result.  Columns other
than the key and the text are carried along only by :func:`place`, and names beginning
with two underscores are reserved.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import draw, gapless, sortable, sql_draw, table, text_bytes

SEED = 11
SHARDS = 24
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4


def topology(n: int, racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> list[tuple]:
    """Shards 0..n-1 of weight 1, filled rack by rack: (region, rack, shard, weight)."""
    return [(s // (racks * per_rack), s // per_rack, s, 1.0) for s in range(n)]


def _children(tree) -> list[dict]:
    """Per level, parent path -> {child path: weight}."""
    levels = [defaultdict(dict) for _ in range(3)]
    for region, rack, shard, w in tree:
        path = ""
        for level, step in enumerate((f"r{region}", f"/k{rack}", f"/s{shard}")):
            kids = levels[level][path]
            path += step
            kids[path] = kids.get(path, 0.0) + w
    return [{p: {c: w for c, w in kids.items() if w > 0} for p, kids in level.items()} for level in levels]


def _u(key: Column, path, seed: int) -> Column:
    return draw(seed, "tree", path, key) + F.lit(2.0 ** -53)


def shard_of(key: Column, tree, seed: int = SEED) -> Column:
    """The shard that ``key`` reaches in ``tree`` (built-in expressions only)."""
    at = F.lit("")
    for level in _children(tree):
        kids = F.create_map(*[x for p, ks in level.items() for x in (
            F.lit(p), F.array(*[F.struct(F.lit(c).alias("p"), F.lit(w).alias("w")) for c, w in ks.items()]))])
        drawn = F.transform(kids[at], lambda c: F.struct((-F.ln(_u(key, c.p, seed)) / c.w).alias("d"), c.p.alias("p")))
        at = F.array_min(drawn)["p"]
    return F.substring_index(at, "/s", -1).cast("int")


def place(df: DataFrame, key: str, tree, grown=None, seed: int = SEED, out: str = "shard") -> DataFrame:
    """``df`` with the shard of every row, and its shard in the ``grown`` tree."""
    df = df.withColumn(out, shard_of(F.col(key), tree, seed))
    return df if grown is None else df.withColumn(f"grown_{out}", shard_of(F.col(key), grown, seed))


def slots(df: DataFrame, key: str, shard: str = "shard", out: str = "slot") -> DataFrame:
    """A gapless number from 0 inside each shard, in the order of hashed keys.  Parts are
    4096 ranges of the hash, so no task holds a shard; rows with equal keys share a part."""
    ordered = df.withColumn("__key", F.md5(F.concat_ws("|", F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    return gapless(ordered, [shard], F.substring("__key", 1, 3), ["__key", key, *sortable(df, (key, shard))], out).drop("__key")


def op5_shard_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (text_bytes("text") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"))
    placed = place(docs, "doc_id", topology(SHARDS), topology(SHARDS + 1))
    return slots(placed, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                                          "slot", "grown_shard")


def _sql_place(n: int, name: str) -> str:
    rows = ", ".join(f"('r{r}', 'r{r}/k{k}', 'r{r}/k{k}/s{s}', {w!r})" for r, k, s, w in topology(n))

    def step(parent, child, level):
        up = "''" if parent is None else parent
        src = "ids" if parent is None else f"{name}_{level - 1}"
        d = f"-ln({sql_draw(SEED, 'tree', 'c', 'key')} + {2.0 ** -53!r}) / w"
        where = "" if parent is None else f" WHERE t.p = {src}.at"
        return (f"{name}_{level} AS (SELECT key, arg_min(c, ROW({d}, c)) AS at FROM {src}, (SELECT {up} AS p, {child} AS c, "
                f"sum(w) AS w FROM {name}_tree GROUP BY 1, 2) t{where} GROUP BY key)")

    return (f"{name}_tree(r, k, s, w) AS (VALUES {rows}), " + ", ".join((
        step(None, "r", 0), step("r", "k", 1), step("k", "s", 2))))


def _nibble_table() -> list[int]:
    """CRC-32 of each 4-bit value (reflected polynomial 0xEDB88320), from its rule."""
    out = []
    for v in range(16):
        for _ in range(4):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


# half a byte at a time, low half first
_SQL_CRC = f"""(4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
  flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda x: [('0x' || x[2])::BIGINT, ('0x' || x[1])::BIGINT]))),
  lambda a, b: xor(a >> 4, {_nibble_table()}[xor(a & 15, b) + 1]::BIGINT)))"""

_SQL = f"""
WITH ids AS (SELECT DISTINCT doc_id AS key FROM documents),
{_sql_place(SHARDS, 'a')}, {_sql_place(SHARDS + 1, 'b')},
d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size,
  CAST({_SQL_CRC} AS BIGINT) AS text_crc32,
  CAST(string_split(a_2.at, '/s')[2] AS INT) AS shard, CAST(string_split(b_2.at, '/s')[2] AS INT) AS grown_shard
  FROM documents JOIN a_2 ON documents.doc_id IS NOT DISTINCT FROM a_2.key
  JOIN b_2 ON documents.doc_id IS NOT DISTINCT FROM b_2.key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', 'slot', coalesce(CAST(doc_id AS VARCHAR), ''))),
                     doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM d
"""

QUERIES = {"op5_shard_tree": op5_shard_tree}
ORACLE = {"op5_shard_tree": _SQL}
