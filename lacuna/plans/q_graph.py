"""Graph preparation, triplet sources and feature acquisition queries (G1-G7,
S13, S23, Q1-Q3, Q9), each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_key, sql_hash_unit
from ..operators import acquire as Q
from ..operators.graphprep import bipartite_edges, edge_metadata, topic_edges, topic_links
from ..operators.split import element_split
from ..sources.files import flatten, triplets_last_wins
from ..sources.tables import read
from .catalog import register

SEED = 100


@register("bipartite_edges", """
WITH r AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS ridx FROM (SELECT DISTINCT user_id FROM events)),
i AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS iidx FROM (SELECT DISTINCT event_type FROM events)),
n AS (SELECT count(*) AS n FROM r),
e AS (SELECT ridx AS src, iidx + n AS dst FROM (SELECT DISTINCT user_id, event_type FROM events) x
      JOIN r USING (user_id) JOIN i USING (event_type), n)
SELECT src, dst, 'row_item' AS kind FROM e UNION ALL SELECT dst AS src, src AS dst, 'item_row' AS kind FROM e""")
def _g3(spark, sf):
    return bipartite_edges(read(spark, sf, "events"), "user_id", "event_type")


@register("topic_links", """
SELECT DISTINCT t[i] AS parent, t[i + 1] AS child FROM
  (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT [p_type, p_brand, p_name] AS t FROM part))""")
def _g4(spark, sf):
    # topic path of an item: type -> brand -> name
    p = read(spark, sf, "part").select("p_partkey", F.array("p_type", "p_brand", "p_name").alias("topics"))
    return topic_links(p, "topics")


@register("item_leaf_topics", """
SELECT p_partkey AS src, t[len(t)] AS dst, 'item_topic' AS kind, CAST(len(t) - 1 AS INTEGER) AS level
FROM (SELECT p_partkey, [p_type, p_brand, p_name] AS t FROM part)""")
def _g4b(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.array("p_type", "p_brand", "p_name").alias("topics"))
    return topic_edges(p, "p_partkey", "topics", leaf_only=True)


_ONEHOT = ", ".join(f"CAST(attr = {i} AS INTEGER) AS oh_{i}" for i in range(5))


@register("edge_metadata", f"""
WITH e AS (SELECT event_id, user_id, ts, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS attr FROM events),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM e)
SELECT event_id, user_id, attr,
  CAST(epoch_us(ts) - epoch_us(lo) AS DOUBLE) / CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) AS ts_norm, {_ONEHOT}
FROM e, b""", doubles=("ts_norm",))
def _g6(spark, sf):
    ev = read(spark, sf, "events")
    types = sorted(r[0] for r in ev.select("event_type").distinct().collect())  # a short categorical domain
    m = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))])
    e = ev.select("event_id", "user_id", "ts", m[F.col("event_type")].alias("attr"))
    out = edge_metadata(e, "ts", "attr", len(types))
    return out.select("event_id", "user_id", "attr", "ts_norm",
                      *[F.col("attr_onehot")[i].alias(f"oh_{i}") for i in range(len(types))])


@register("triplets_last_wins",
          "SELECT user_id AS row_id, event_type AS col_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
          doubles=("value",))
def _s13(spark, sf):
    ev = read(spark, sf, "events").select(F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id"),
                                          "value", F.col("event_id").alias("seq"))
    return triplets_last_wins(ev)


@register("flatten_event_props",
          "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k FROM events")
def _s23(spark, sf):
    ev = read(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return flatten(ev, sep="_")


# ---- acquisition ------------------------------------------------------------------------

_CELLS = "SELECT user_id AS row_id, event_type AS col_id, avg(value) AS value FROM events GROUP BY ALL"
_CKEY = "concat_ws(':', CAST(row_id AS VARCHAR), CAST(col_id AS VARCHAR))"
_OBS = (f"SELECT * FROM ({_CELLS}) WHERE {sql_hash_unit(sql_hash_key(SEED, 'cell', _CKEY))} < CAST(0.5 AS DOUBLE)")
_CANDS = f"SELECT c.* FROM ({_CELLS}) c ANTI JOIN ({_OBS}) o USING (row_id, col_id)"


def _cells(spark, sf):
    ev = read(spark, sf, "events")
    cells = ev.groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id")).agg(
        F.avg("value").alias("value"))
    flagged = element_split(cells, SEED, 0.5, "row_id", "col_id", "observed")
    return cells, flagged.where("observed").drop("observed")


_RANDOM_SQL = (f"SELECT row_id, col_id, value FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY "
               f"{sql_hash_key(SEED, 'acq:0', _CKEY)}, col_id) AS r FROM ({_CANDS})) WHERE r = 1")


@register("next_feature_random", _RANDOM_SQL, doubles=("value",))
def _q2(spark, sf):
    cells, observed = _cells(spark, sf)
    return Q.next_random(Q.observable(cells, observed), 1, SEED, 0)


_GAINS = f"SELECT col_id, var_samp(value) AS gain FROM ({_OBS}) GROUP BY ALL"
_GAIN_SQL = (f"SELECT row_id, col_id, value, gain FROM (SELECT c.*, g.gain, row_number() OVER (PARTITION BY row_id "
             f"ORDER BY g.gain DESC, c.col_id) AS r FROM ({_CANDS}) c JOIN ({_GAINS}) g USING (col_id)) WHERE r = 1")


def _gains(observed):
    return observed.groupBy("col_id").agg(F.var_samp("value").alias("gain"))


@register("next_feature_global_gain", _GAIN_SQL, doubles=("value", "gain"))
def _q3(spark, sf):
    cells, observed = _cells(spark, sf)
    return Q.next_by_global_gain(Q.observable(cells, observed), _gains(observed), 1)


@register("acquisition_agreement", f"""
SELECT CAST(0 AS INTEGER) AS step, avg(CASE WHEN a.col_id = b.col_id THEN 1.0 ELSE 0.0 END) AS agreement
FROM ({_RANDOM_SQL}) a JOIN ({_GAIN_SQL}) b USING (row_id)""", doubles=("agreement",))
def _q9(spark, sf):
    cells, observed = _cells(spark, sf)
    cands = Q.observable(cells, observed)
    a = Q.next_random(cands, 1, SEED, 0).withColumn("step", F.lit(0))
    b = Q.next_by_global_gain(cands, _gains(observed), 1).withColumn("step", F.lit(0))
    return Q.agreement(a, b)
