"""Neighbour queries: kNN imputation (I15), weighted neighbours (I26), kNN
classifier (L15) and certain predictions over a repair space (L21-L24)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import first_k, hash_index, hash_key, sql_hash_key, sql_hash_unit
from ..operators.impute.neighbour import certain_predictions, certain_share, knn_classify, knn_impute, weighted_neighbour_impute
from ..operators.split import TRAIN
from ..sources.tables import DATASETS, load, read
from .catalog import register
from .experiment import prepare_parts, sql_prepare_parts

SEED = 100
ORD = DATASETS["orders"]
FEATS = list(ORD["numeric"]) + list(ORD["categorical"])
K_IMPUTE = 5
K_CLASSIFY = 3


def _knn_impute_sql():
    parts = sql_prepare_parts("orders", FEATS, "exp1_mcar3", SEED, 0.2)
    n1, n2 = ORD["numeric"]
    c1, c2 = ORD["categorical"]
    allnn = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
    anyn = " OR ".join(f"{c} IS NULL" for c in FEATS)
    return f"""
WITH parts AS MATERIALIZED ({parts}),
train AS (SELECT * FROM parts WHERE part = '{TRAIN}'),
st AS (SELECT avg({n1}) AS m1, coalesce(nullif(stddev_pop({n1}), 0), 1) AS s1,
              avg({n2}) AS m2, coalesce(nullif(stddev_pop({n2}), 0), 1) AS s2,
              count(DISTINCT {c1}) AS w1, count(DISTINCT {c2}) AS w2 FROM train),
donors AS (SELECT t.row_id AS donor_id, ({n1} - m1) / s1 AS z1, ({n2} - m2) / s2 AS z2, {c1} AS k1, {c2} AS k2,
                  {n1} AS v1, {n2} AS v2 FROM train t, st WHERE {allnn}),
q AS (SELECT p.part, p.row_id, ({n1} - m1) / s1 AS z1, ({n2} - m2) / s2 AS z2, {c1} AS k1, {c2} AS k2,
             w1, w2 FROM parts p, st WHERE {anyn}),
pairs AS (
  SELECT q.part, q.row_id, d.donor_id,
    sqrt(((CASE WHEN q.z1 IS NULL THEN 0.0 ELSE (q.z1 - d.z1) * (q.z1 - d.z1) END)
        + (CASE WHEN q.z2 IS NULL THEN 0.0 ELSE (q.z2 - d.z2) * (q.z2 - d.z2) END)
        + (CASE WHEN q.k1 IS NULL THEN 0.0 WHEN q.k1 <> d.k1 THEN 2.0 ELSE 0.0 END)
        + (CASE WHEN q.k2 IS NULL THEN 0.0 WHEN q.k2 <> d.k2 THEN 2.0 ELSE 0.0 END))
      * ((2 + q.w1 + q.w2) / CAST((CASE WHEN q.z1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q.z2 IS NULL THEN 0 ELSE 1 END)
          + (CASE WHEN q.k1 IS NULL THEN 0 ELSE q.w1 END) + (CASE WHEN q.k2 IS NULL THEN 0 ELSE q.w2 END) AS DOUBLE))) AS dist,
    d.v1, d.v2, d.k1, d.k2
  FROM q, donors d),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, row_id ORDER BY dist, donor_id) AS rk FROM pairs)
       WHERE rk <= {K_IMPUTE}),
num AS (SELECT part, row_id, avg(v1) AS f1, avg(v2) AS f2 FROM nn GROUP BY ALL),
m1 AS (SELECT part, row_id, k1 AS f3 FROM (SELECT part, row_id, k1, row_number() OVER (PARTITION BY part, row_id
       ORDER BY count(*) DESC, k1) AS r FROM nn GROUP BY part, row_id, k1) WHERE r = 1),
m2 AS (SELECT part, row_id, k2 AS f4 FROM (SELECT part, row_id, k2, row_number() OVER (PARTITION BY part, row_id
       ORDER BY count(*) DESC, k2) AS r FROM nn GROUP BY part, row_id, k2) WHERE r = 1)
SELECT part, row_id, {n1}, {n2}, {c1}, {c2} FROM parts WHERE {allnn}
UNION ALL
SELECT p.part, p.row_id, coalesce(p.{n1}, num.f1) AS {n1}, coalesce(p.{n2}, num.f2) AS {n2},
       coalesce(p.{c1}, m1.f3) AS {c1}, coalesce(p.{c2}, m2.f4) AS {c2}
FROM parts p JOIN num USING (part, row_id) JOIN m1 USING (part, row_id) JOIN m2 USING (part, row_id)"""


@register("knn_impute", _knn_impute_sql(), doubles=tuple(ORD["numeric"]))
def _i15(spark, sf):
    spec = load(spark, sf, "orders")
    parts = prepare_parts(spec, "exp1_mcar3", SEED)
    return knn_impute(parts, TRAIN, spec.numeric, spec.categorical, k=K_IMPUTE).select("part", "row_id", *FEATS)


K_WEIGHTED = 10


def _weighted_sql():
    parts = sql_prepare_parts("orders", FEATS, "exp1_mcar3", SEED, 0.2)
    n1, n2 = ORD["numeric"]
    both = f"{n1} IS NOT NULL AND {n2} IS NOT NULL"
    present = "((CASE WHEN q.z1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q.z2 IS NULL THEN 0 ELSE 1 END))"
    square = "(CASE WHEN q.{0} IS NULL THEN 0.0::DOUBLE ELSE (q.{0} - d.{0}) * (q.{0} - d.{0}) END)"
    return f"""
WITH parts AS MATERIALIZED ({parts}), train AS (SELECT * FROM parts WHERE part = '{TRAIN}'),
st AS (SELECT avg({n1}) AS m1, coalesce(nullif(stddev_pop({n1}), 0), 1) AS s1, avg({n2}) AS m2, coalesce(nullif(stddev_pop({n2}), 0), 1) AS s2 FROM train),
donors AS (SELECT row_id AS donor_id, ({n1} - m1) / s1 AS z1, ({n2} - m2) / s2 AS z2, {n1} AS v1, {n2} AS v2 FROM train, st WHERE {both}),
q AS (SELECT part, row_id, ({n1} - m1) / s1 AS z1, ({n2} - m2) / s2 AS z2 FROM parts, st WHERE NOT ({both})),
pairs AS (SELECT q.part, q.row_id, d.donor_id, v1, v2, CASE WHEN {present} = 0 THEN 'infinity'::DOUBLE
  ELSE sqrt(({square.format('z1')} + {square.format('z2')}) * (2.0::DOUBLE / {present})) END AS dist FROM q, donors d),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, row_id ORDER BY dist, donor_id) AS rk FROM pairs) WHERE rk <= {K_WEIGHTED}),
w AS (SELECT *, CASE WHEN min(dist) OVER (PARTITION BY part, row_id) = 0 THEN CASE WHEN dist = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN isinf(dist) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / dist END AS w FROM nn),
f AS (SELECT part, row_id, sum(w * v1) / nullif(sum(w), 0) AS f1, sum(w * v2) / nullif(sum(w), 0) AS f2 FROM w GROUP BY ALL)
SELECT p.part, p.row_id, coalesce(p.{n1}, f1, m1) AS {n1}, coalesce(p.{n2}, f2, m2) AS {n2} FROM st, parts p LEFT JOIN f USING (part, row_id)"""


@register("weighted_neighbour_impute", _weighted_sql(), doubles=tuple(ORD["numeric"]), note="I26: inverse-distance weights, uncertainty gate")
def _i26(spark, sf):
    spec = load(spark, sf, "orders")
    parts = prepare_parts(spec, "exp1_mcar3", SEED)
    return weighted_neighbour_impute(parts.select("part", "row_id", *spec.numeric), TRAIN, spec.numeric, k=K_WEIGHTED)


def _emb_split(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    keyed = e.withColumn("__k", hash_key(SEED, "val", "vec_id"))
    n = e.count()
    is_val = first_k(keyed, "__k", math.ceil(0.2 * n))
    return keyed.where(~is_val).drop("__k"), keyed.where(is_val).drop("__k")


_EMB_VAL = (f"SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label, "
            f"row_number() OVER (ORDER BY {sql_hash_key(SEED, 'val', 'vec_id')}) <= ceil(0.2 * count(*) OVER ()) AS is_val "
            f"FROM embeddings")


@register("knn_classifier", f"""
WITH e AS MATERIALIZED ({_EMB_VAL}),
pairs AS (SELECT v.vec_id AS qid, t.vec_id AS did, t.label AS nlabel,
                 list_distance(v.embedding, t.embedding) AS dist
          FROM e v, e t WHERE v.is_val AND NOT t.is_val),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS rk FROM pairs) WHERE rk <= {K_CLASSIFY}),
votes AS (SELECT qid, nlabel, count(*) AS n, min(rk) AS first FROM nn GROUP BY ALL),
pred AS (SELECT qid, nlabel AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, first) AS r FROM votes) WHERE r = 1)
SELECT e.vec_id, e.label, pred.prediction FROM pred JOIN e ON e.vec_id = pred.qid""")
def _l15(spark, sf):
    train, val = _emb_split(spark, sf)
    return knn_classify(train, val, K_CLASSIFY, "vec_id", "embedding").select("vec_id", "label", "prediction")


_CERTAIN = f"""
e AS MATERIALIZED ({_EMB_VAL}),
t AS (SELECT vec_id, embedding, label, {sql_hash_unit(sql_hash_key(SEED, 'dirty', 'vec_id'))} AS u,
  ('0x' || substr({sql_hash_key(SEED, 'dirty', 'vec_id')}, 25, 8))::BIGINT % len(embedding) AS j FROM e WHERE NOT is_val),
x AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS j FROM t WHERE u >= 0.3),
s AS (SELECT j, avg(x) AS mean, min(x) AS lo, max(x) AS hi FROM x GROUP BY j),
r AS (SELECT vec_id, embedding, label FROM t WHERE u >= 0.3 UNION ALL
  SELECT vec_id, list_transform(embedding, lambda v, i: CASE WHEN i - 1 = j THEN fill ELSE v END), label FROM (
    SELECT t.*, unnest([s.mean, s.lo, s.hi]) AS fill FROM t JOIN s USING (j) WHERE u < 0.3)),
sim AS (SELECT v.vec_id AS qid, r.vec_id AS rid, r.label AS rlabel, 1 / (1 + list_distance(v.embedding, r.embedding)) AS sim
  FROM e v, r WHERE v.is_val),
mm AS (SELECT qid, rid, rlabel, min(sim) AS lo, max(sim) AS hi FROM sim GROUP BY ALL),
pc AS (SELECT qid, c, rid, rlabel, CASE WHEN rlabel = c THEN hi ELSE lo END AS s FROM mm, (SELECT DISTINCT label AS c FROM r)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, c ORDER BY s DESC, rid) AS k FROM pc) WHERE k <= {K_CLASSIFY}),
win AS (SELECT qid, c, rlabel AS pred FROM (SELECT qid, c, rlabel, row_number() OVER (PARTITION BY qid, c ORDER BY count(*) DESC, rlabel) AS k
  FROM top GROUP BY qid, c, rlabel) WHERE k = 1),
res AS (SELECT qid AS vec_id, count(*) FILTER (WHERE pred = c) = 1 AS is_certain, CASE WHEN count(*) FILTER (WHERE pred = c) = 1
  THEN min(c) FILTER (WHERE pred = c) END AS certain_label FROM win GROUP BY qid)"""


@register("certain_prediction_share", f"WITH {_CERTAIN} SELECT avg(CASE WHEN is_certain THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS certain_share, count(*) AS n FROM res",
          doubles=("certain_share",), note="L24")
def _l24(spark, sf):
    return certain_share(_l23(spark, sf))


@register("certain_predictions", f"WITH {_CERTAIN} SELECT res.vec_id, is_certain, coalesce(certain_label, -1) AS certain_label, e.label "
          "FROM res JOIN e ON e.vec_id = res.vec_id", note="L21-L24: min/max similarity over repairs, best case per class; -1: not certain")
def _l23(spark, sf):
    train, val = _emb_split(spark, sf)
    # dirty rows: 30% (hash), one hash-chosen coordinate unknown; repairs fill it
    # with the coordinate's mean / min / max over the clean train rows.
    dims = train.select(F.size("embedding")).first()[0]
    t = train.withColumn("__u", F.conv(F.substring(hash_key(SEED, "dirty", "vec_id"), 17, 8), 16, 10).cast("double") / 4294967296.0)
    t = t.withColumn("__j", hash_index(hash_key(SEED, "dirty", "vec_id"), dims))
    stats = t.where("__u >= 0.3").select(F.posexplode("embedding").alias("j", "x")).groupBy("j").agg(
        F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    fills = {r["j"]: r for r in stats.collect()}  # one row per coordinate (bounded by the dimension)
    clean = t.where("__u >= 0.3").select("vec_id", F.lit("clean").alias("repair"), "embedding", "label")
    dirty = t.where("__u < 0.3")
    reps = []
    for name in ("mean", "min", "max"):
        m = F.create_map(*[x for j, r in fills.items() for x in (F.lit(j), F.lit(float(r[name])))])
        vec = F.transform("embedding", lambda x, i: F.when(i == F.col("__j"), m[i]).otherwise(x))
        reps.append(dirty.select("vec_id", F.lit(name).alias("repair"), vec.alias("embedding"), "label"))
    space = clean.unionByName(reps[0]).unionByName(reps[1]).unionByName(reps[2])
    res = certain_predictions(space, val, K_CLASSIFY, "vec_id", "embedding")
    return res.withColumn("certain_label", F.coalesce("certain_label", F.lit(-1))).join(val.select("vec_id", "label"), "vec_id")
