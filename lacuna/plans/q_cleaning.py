"""Cleaning a repair space (L21, L24-L28), drop-column importance (L14), early-stopped
boosting (L4) and votes (L27) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_index, hash_key, sql_hash_index, sql_hash_key
from ..operators.boosting import early_stopped_cv
from ..operators.impute import cleaning as C
from ..operators.impute.repairs import repair_space
from ..operators.split import TRAIN, kfold
from ..sources.tables import DATASETS, load, read
from .catalog import register
from .experiment import impute, prepare_parts, sql_prepare_parts
from .q_neighbours import _CERTAIN, _emb_split, K_CLASSIFY, SEED

STEPS = 10
ORD = DATASETS["orders"]
ORD_FEATS = [*ORD["numeric"], *ORD["categorical"]]


def _space(spark, sf):
    """(repairs with their true one marked, validation rows): 30 % of the train vectors have one
    unknown coordinate, filled with the mean, the least or the greatest of the complete rows."""
    train, val = _emb_split(spark, sf)
    dims = train.select(F.size("embedding")).first()[0]
    t = train.withColumn("__u", F.conv(F.substring(hash_key(SEED, "dirty", "vec_id"), 17, 8), 16, 10).cast("double") / 4294967296.0)
    t = t.withColumn("__j", hash_index(hash_key(SEED, "dirty", "vec_id"), dims))
    stats = t.where("__u >= 0.3").select(F.posexplode("embedding").alias("j", "x")).groupBy("j").agg(
        F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    fills = F.array(*[F.struct(F.lit(n).alias("repair"), F.col(n).alias("fill")) for n in ("mean", "min", "max")])
    named = stats.select(F.col("j").alias("__k"), F.explode(fills).alias("f"))
    dirty = t.where("__u < 0.3").join(named, F.col("__j") == F.col("__k")).select(
        "vec_id", "f.repair", F.transform("embedding", lambda x, i: F.when(i == F.col("__j"), F.col("f.fill")).otherwise(x)).alias("embedding"), "label")
    space = t.where("__u >= 0.3").select("vec_id", F.lit("clean").alias("repair"), "embedding", "label").unionByName(dirty)
    return C.true_repairs(space, train, "vec_id", "embedding"), val


# the repair space of q_neighbours with names, the true repair and the step of every row
_SPACE = _CERTAIN.split("sim AS (")[0].replace(
    "r AS (SELECT vec_id, embedding, label FROM t WHERE u >= 0.3 UNION ALL", "r0 AS (SELECT vec_id, 'clean' AS repair, embedding, label, 0.0::DOUBLE AS d, 0 AS n FROM t WHERE u >= 0.3 UNION ALL").replace(
    "SELECT vec_id, list_transform(", "SELECT vec_id, repair, list_transform(").replace(
    "END), label FROM (", "END), label, (fill - embedding[j + 1]) * (fill - embedding[j + 1]) AS d, 1 AS n FROM (").replace(
    "unnest([s.mean, s.lo, s.hi]) AS fill", "unnest([s.mean, s.lo, s.hi]) AS fill, unnest(['mean', 'min', 'max']) AS repair")
_STEP = f"({sql_hash_index(sql_hash_key(SEED, 'clean', 'vec_id'), STEPS)} + 1)"
_SPACE += f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, repair) = 1 AS is_true,
  CASE WHEN n = 1 THEN {_STEP} ELSE 0 END AS step FROM r0)"""
_SERIES = f"""{_SPACE},
sim AS (SELECT v.vec_id AS qid, r.vec_id AS rid, r.label AS rlabel, r.step, r.is_true, 1 / (1 + list_distance(v.embedding, r.embedding)) AS sim
  FROM e v, r WHERE v.is_val),
mm AS MATERIALIZED (SELECT qid, rid, rlabel, step, min(sim) AS lo, max(sim) AS hi, max(CASE WHEN is_true THEN sim END) AS tr FROM sim GROUP BY ALL),
pc AS (SELECT qid, t, c, rid, rlabel, CASE WHEN step > 0 AND step <= t THEN tr WHEN rlabel = c THEN hi ELSE lo END AS s
  FROM mm, (SELECT DISTINCT label AS c FROM r), (SELECT unnest(range({STEPS + 1})) AS t)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, t, c ORDER BY s DESC, rid) AS k FROM pc) WHERE k <= {K_CLASSIFY}),
win AS (SELECT qid, t, c, rlabel AS pred FROM (SELECT qid, t, c, rlabel, row_number() OVER (PARTITION BY qid, t, c ORDER BY count(*) DESC, rlabel) AS k
  FROM top GROUP BY qid, t, c, rlabel) WHERE k = 1),
res AS MATERIALIZED (SELECT qid, t, count(*) FILTER (WHERE pred = c) = 1 AS sure FROM win GROUP BY qid, t)"""


@register("cleaning_series", f"""WITH {_SERIES},
first AS (SELECT qid, min(CASE WHEN sure THEN t END) AS f FROM res GROUP BY qid),
share AS (SELECT t AS step, count(CASE WHEN f <= t THEN 1 END) / CAST(count(*) AS DOUBLE) AS certain_share FROM first, (SELECT unnest(range({STEPS + 1})) AS t) GROUP BY t)
SELECT CAST(step AS INT) AS step, CAST((SELECT count(DISTINCT vec_id) FROM r WHERE r.step > 0 AND r.step <= share.step) AS BIGINT) AS rows_cleaned, certain_share,
  coalesce(lag(certain_share) OVER (ORDER BY step), 0) < 1 AS needed FROM share""", doubles=("certain_share",),
          note="L24, L25: certain share over the rows cleaned, the twin tests every step anew")
def _l25(spark, sf):
    space, val = _space(spark, sf)
    return C.cleaning_series(space, val, K_CLASSIFY, STEPS, SEED, "vec_id", "embedding")


@register("certain_from_step", f"WITH {_SERIES} SELECT qid AS vec_id, CAST(coalesce(min(CASE WHEN sure THEN t END), -1) AS INT) AS certain_from FROM res GROUP BY qid",
          note="L25: the step from which a validation row is certain (-1: never)")
def _l25_rows(spark, sf):
    space, val = _space(spark, sf)
    out = C.certain_from(space, val, K_CLASSIFY, STEPS, SEED, "vec_id", "embedding")
    return out.withColumn("certain_from", F.coalesce("certain_from", F.lit(-1)).cast("int"))


@register("true_repairs", f"WITH {_SPACE} SELECT repair, count(*) AS n, sum(CASE WHEN is_true THEN 1 ELSE 0 END) AS n_true FROM r GROUP BY repair",
          note="L21: how often each repair is the one nearest to the clean row")
def _l21(spark, sf):
    return _space(spark, sf)[0].groupBy("repair").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_true").alias("n_true"))


@register("cleaned_table", f"""WITH {_SPACE}
SELECT vec_id, repair, label, n = 1 AND step <= 4 AS cleaned, list_sum(embedding) AS total FROM r
WHERE CASE WHEN n = 0 THEN true WHEN step <= 4 THEN is_true ELSE repair = 'mean' END""", doubles=("total",), note="L28: true repairs up to step 4, the mean elsewhere")
def _l28(spark, sf):
    done = C.cleaned_table(_space(spark, sf)[0], 4, STEPS, SEED, "vec_id")
    return done.select("vec_id", "repair", "label", "cleaned", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("label_entropy", """
SELECT c_nationkey, count(*) AS n0, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""".replace("count(*) AS n0, ", ""),
          doubles=("entropy",), note="L26: entropy of the market segments of a nation's customers")
def _l26(spark, sf):
    return C.label_entropy(read(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@register("majority_votes", """
WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2),
a AS (SELECT user_id, event_type AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1),
b AS (SELECT user_id, event_type AS first_met FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM n) WHERE r = 1)
SELECT user_id, lowest, first_met FROM a JOIN b USING (user_id)""", note="L27: both tie rules")
def _l27(spark, sf):
    ev = read(spark, sf, "events")
    a = C.majority_vote(ev, ["user_id"], "event_type").withColumnRenamed("vote", "lowest")
    b = C.majority_vote(ev, ["user_id"], "event_type", "event_id").withColumnRenamed("vote", "first_met")
    return a.join(b, "user_id")


# ---- L14: exact powers of two as scales, so that both engines compare the same doubles ----------

_VARIANTS = {"size": "t2 + t1", "price": "t0 + t2", "p_brand": "t0 + t1", "": "t0 + t1 + t2"}
_IMPORTANCE = f"""
WITH p AS MATERIALIZED (SELECT p_partkey AS id, p_size / 16.0::DOUBLE AS size, p_retailprice / 64.0::DOUBLE AS price, p_brand, p_type,
  {sql_hash_index(sql_hash_key(SEED, 'fold', 'p_partkey'), 5)} AS fold FROM part),
x AS MATERIALIZED (SELECT q.id AS qid, d.id AS did, (q.size - d.size) * (q.size - d.size) AS t0, (q.price - d.price) * (q.price - d.price) AS t1,
  CASE WHEN q.p_brand <> d.p_brand THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS t2 FROM p q JOIN p d ON q.fold <> d.fold),
nn AS ({' UNION ALL '.join(f"SELECT * FROM (SELECT '{v}' AS variant, qid, did, row_number() OVER (PARTITION BY qid ORDER BY sqrt({e}), did) AS r FROM x) WHERE r <= 3" for v, e in _VARIANTS.items())}),
vote AS (SELECT variant, qid, p_type FROM (SELECT variant, qid, p_type, row_number() OVER (PARTITION BY variant, qid ORDER BY count(*) DESC, p_type) AS r
  FROM nn JOIN p ON p.id = nn.did GROUP BY variant, qid, p_type) WHERE r = 1),
a AS (SELECT variant, avg(a) AS a FROM (SELECT variant, fold, avg(CASE WHEN vote.p_type = p.p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a
  FROM vote JOIN p ON p.id = vote.qid GROUP BY variant, fold) GROUP BY variant)
SELECT a.variant AS "column", w.a AS accuracy_all, a.a AS accuracy_without, w.a - a.a AS importance FROM a, a w WHERE w.variant = '' AND a.variant <> ''"""


@register("drop_column_importance", _IMPORTANCE, doubles=("accuracy_all", "accuracy_without", "importance"),
          note="L14: kNN accuracy on parts with and without each column, five folds")
def _l14(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(16.0)).alias("size"),
                                       (F.col("p_retailprice") / F.lit(64.0)).alias("price"), "p_brand", "p_type")
    return C.drop_column_importance(kfold(p, SEED, 5, "id"), ["size", "price"], ["p_brand"], 3, "id", "p_type", "fold")


# ---- L4 ---------------------------------------------------------------------------------------------

# Depths and least node sizes from the tuning grid, as far as three folds of each take minutes, not hours.
BOOST_GRID = [{"maxDepth": d, "minInstancesPerNode": n} for d in (3, 5) for n in (100, 1000)]


def _boosted(spark, sf):
    spec = load(spark, sf, "orders")
    imputed, _, _ = impute(spec, prepare_parts(spec, "exp1_mcar3", SEED), "median-mode")
    return early_stopped_cv(imputed.where(F.col("part") == TRAIN), spec.numeric, spec.categorical, BOOST_GRID, max_rounds=50, patience=5, seed=SEED)


@register("early_stopped_boosting", None, note="L4: best round per parameter set and fold, rounds of the refit")
def _l4(spark, sf):
    return _boosted(spark, sf)[1]


@register("boosting_losses", None, note="L4: held-out loss of every round")
def _l4_losses(spark, sf):
    return _boosted(spark, sf)[0]


# ---- I13: numeric and categorical branches -----------------------------------------------------------

_DAMAGED = sql_prepare_parts("orders", ORD_FEATS, "exp1_mcar3", SEED, ORD["test_fraction"])
_TRAIN_SQL = f"(SELECT * FROM parts WHERE part = '{TRAIN}')"


def _damaged(spark, sf):
    spec = load(spark, sf, "orders")
    return spec, prepare_parts(spec, "exp1_mcar3", SEED).where(F.col("part") == TRAIN)


def _numeric_sql():
    num = ORD["numeric"]
    fills = {"mean": "avg({0})", "min": "min({0})", "max": "max({0})", "25-grid": "min({0}) + (max({0}) - min({0})) * CAST(0.25 AS DOUBLE)",
             "75-grid": "min({0}) + (max({0}) - min({0})) * CAST(0.75 AS DOUBLE)"}
    arms = [f"SELECT row_id, '{n}' AS repair, {', '.join(f'coalesce({c}, (SELECT {e.format(c)} FROM {_TRAIN_SQL})) AS {c}' for c in num)} "
            f"FROM {_TRAIN_SQL} WHERE {' OR '.join(f'{c} IS NULL' for c in num)}" for n, e in fills.items()]
    return f"WITH parts AS MATERIALIZED ({_DAMAGED}) {' UNION ALL '.join(arms)}"


@register("repair_space_numeric", _numeric_sql(), doubles=tuple(ORD["numeric"]), note="I13: numeric columns alone, statistics")
def _i13_numeric(spark, sf):
    spec, df = _damaged(spark, sf)
    return repair_space(df, spec.numeric, [], learned=False)


@register("repair_space_learned", None, note="I13: numeric columns alone, with nearest rows and a chained tree")
def _i13_learned(spark, sf):
    spec, df = _damaged(spark, sf)
    return repair_space(df, spec.numeric, [], seed=SEED)


def _categorical_sql():
    first, other = ORD["categorical"]
    rank = lambda c: (f"SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r, count(*) OVER () AS m FROM {_TRAIN_SQL} "  # noqa: E731
                      f"WHERE {c} IS NOT NULL GROUP BY 1")
    return f"""WITH parts AS MATERIALIZED ({_DAMAGED}), a AS MATERIALIZED ({rank(first)}), b AS MATERIALIZED ({rank(other)}),
fill AS (SELECT CASE WHEN a.r = 1 THEN 'mean' ELSE a.r || '_frequent' END AS repair, a.v AS x, b.v AS y FROM a JOIN b ON b.r = least(a.r, b.m)
  UNION ALL SELECT 'dummy', 'missing', 'missing')
SELECT row_id, repair, coalesce({first}, x) AS {first}, coalesce({other}, y) AS {other} FROM {_TRAIN_SQL}, fill WHERE {first} IS NULL OR {other} IS NULL"""


@register("repair_space_categorical", _categorical_sql(), note="I13: categorical columns alone, every value of the domain by frequency")
def _i13_categorical(spark, sf):
    spec, df = _damaged(spark, sf)
    return repair_space(df, [], spec.categorical)
