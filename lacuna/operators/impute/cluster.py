"""Cluster imputer (I21-I23): k-prototypes on the never-missing columns, then
per-cluster mean / mode of the columns that miss values.

Distributed Lloyd iterations: centroids (k rows -- bounded) are shipped to the
tasks, assignment is a narrow projection, the update is one group-by per
iteration.  Initial centroids: the k rows with the smallest seeded hash keys.
Only missing cells are filled (observed cells are never overwritten).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.hashing import hash_key, kth_keys
from ..encode import ColumnScaler
from .simple import ranked_values


def _dist_expr(centroid: dict, num_cols, cat_cols, gamma: float):
    # a missing coordinate (test rows) contributes nothing
    e = F.lit(0.0)
    for c in num_cols:
        e = e + F.coalesce((F.col(c) - F.lit(centroid[c])) ** 2, F.lit(0.0))
    for c in cat_cols:
        e = e + F.coalesce(F.lit(gamma) * (F.col(c) != F.lit(centroid[c])).cast("double"), F.lit(0.0))
    return e


def _assign(df: DataFrame, cents: list, num_cols, cat_cols, gamma: float) -> DataFrame:
    dists = [_dist_expr(c, num_cols, cat_cols, gamma) for c in cents]
    best = F.lit(0)
    bestd = dists[0]
    for i in range(1, len(dists)):
        best = F.when(dists[i] < bestd, F.lit(i)).otherwise(best)
        bestd = F.least(bestd, dists[i])
    return df.withColumn("cluster", best).withColumn("__cost", bestd)


@dataclass
class ClusterModel:
    centroids: list
    scaler: ColumnScaler
    num_cols: list
    cat_cols: list
    gamma: float
    stats: dict  # (cluster, column) -> value
    fallback: dict
    shares: dict
    cost: float

    def assign(self, df: DataFrame) -> DataFrame:
        # scaled copies, originals kept
        z = df.withColumns({f"__z_{c}": (F.col(c) - F.lit(self.scaler.params[c][0])) / F.lit(self.scaler.params[c][1])
                            for c in self.num_cols})
        zc = [f"__z_{c}" for c in self.num_cols]
        cents = [{**{f"__z_{c}": cen[c] for c in self.num_cols}, **{c: cen[c] for c in self.cat_cols}}
                 for cen in self.centroids]
        return _assign(z, cents, zc, self.cat_cols, self.gamma).drop(*zc, "__cost")

    def transform(self, df: DataFrame) -> DataFrame:
        a = self.assign(df)
        upd = {}
        for col in {c for (_, c) in self.stats}:
            e = None
            for (k, c), v in self.stats.items():
                if c != col:
                    continue
                e = F.when(F.col("cluster") == k, F.lit(v)) if e is None else e.when(F.col("cluster") == k, F.lit(v))
            upd[col] = F.coalesce(F.col(col), e, F.lit(self.fallback.get(col)))
        return a.withColumns(upd).drop("cluster")


def fit_kprototypes(train: DataFrame, observed_num, observed_cat, missing_num, missing_cat, k: int,
                    seed: int, max_iter: int = 10, row_id: str = "row_id", gamma: float | None = None) -> ClusterModel:
    scaler = ColumnScaler.fit(train, list(observed_num), "zscore")
    z = train.withColumns({f"__z_{c}": (F.col(c) - F.lit(scaler.params[c][0])) / F.lit(scaler.params[c][1])
                           for c in observed_num}).cache()
    zc = [f"__z_{c}" for c in observed_num]
    g = 0.5 if gamma is None else gamma  # half the (unit) std of the scaled numerics
    keyed = z.withColumn("__k", hash_key(seed, "kproto-init", row_id))
    thr = kth_keys(keyed, "__k", {"__all__": k})["__all__"]
    init = keyed.where(F.col("__k") <= F.lit(thr)).orderBy("__k").select(*zc, *observed_cat).collect()
    cents = [r.asDict() for r in init]
    cost = None
    for _ in range(max_iter):
        a = _assign(z, cents, zc, list(observed_cat), g)
        aggs = [F.avg(c).alias(c) for c in zc] + [F.sum("__cost").alias("__cost"), F.count("*").alias("__n")]
        rows = {r["cluster"]: r for r in a.groupBy("cluster").agg(*aggs).collect()}
        modes = {}
        for c in observed_cat:
            m = (a.groupBy("cluster", c).count().groupBy("cluster")
                 .agg(F.min_by(c, F.struct((-F.col("count")).alias("n"), F.col(c))).alias("v")).collect())
            modes[c] = {r["cluster"]: r["v"] for r in m}
        new_cost = sum(r["__cost"] for r in rows.values())
        new = []
        for i, old in enumerate(cents):
            if i in rows:
                new.append({**{c: rows[i][c] for c in zc}, **{c: modes[c].get(i, old[c]) for c in observed_cat}})
            else:
                new.append(old)
        done = cost is not None and abs(cost - new_cost) <= 1e-9 * max(1.0, abs(cost))
        cents, cost = new, new_cost
        if done:
            break
    a = _assign(z, cents, zc, list(observed_cat), g).cache()
    stats = {}
    n = a.count()
    shares = {r["cluster"]: r["count"] / n for r in a.groupBy("cluster").count().collect()}
    if missing_num:
        for r in a.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in missing_num]).collect():
            for c in missing_num:
                if r[c] is not None:
                    stats[(r["cluster"], c)] = r[c]
    for c in missing_cat:
        m = (a.where(F.col(c).isNotNull()).groupBy("cluster", c).count().groupBy("cluster")
             .agg(F.min_by(c, F.struct((-F.col("count")).alias("n"), F.col(c))).alias("v")).collect())
        for r in m:
            stats[(r["cluster"], c)] = r["v"]
    fallback = dict(train.agg(*[F.avg(c).alias(c) for c in missing_num]).first().asDict()) if missing_num else {}
    fallback.update(ranked_values(train, list(missing_cat)))
    a.unpersist()
    z.unpersist()
    cents_out = [{**{c: cen[f"__z_{c}"] for c in observed_num}, **{c: cen[c] for c in observed_cat}} for cen in cents]
    return ClusterModel(cents_out, scaler, list(observed_num), list(observed_cat), g, stats, fallback, shares, cost)


def cluster_impute(df: DataFrame, train_part: str, numeric, categorical, k: int, seed: int,
                   part_col: str = "part", max_iter: int = 10) -> tuple:
    """Columns with nulls in train are imputed; the others drive the clusters."""
    train = df.where(F.col(part_col) == train_part)
    feats = list(numeric) + list(categorical)
    nulls = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feats]).first()
    missing = [c for c in feats if nulls[c] > 0]
    obs_num = [c for c in numeric if c not in missing]
    obs_cat = [c for c in categorical if c not in missing]
    if not obs_num and not obs_cat:
        raise ValueError("every feature has missing values: nothing to cluster on")
    # K4: statistics for every feature, so cells missing only in a test part are filled too
    model = fit_kprototypes(train, obs_num, obs_cat, list(numeric), list(categorical), k, seed, max_iter)
    return model.transform(df), model


def cluster_grid(df: DataFrame, train_part: str, numeric, categorical, ks, seed: int, part_col: str = "part"):
    """Cost per k (driver loop over a short grid); pick the caller's rule."""
    return [(k, cluster_impute(df, train_part, numeric, categorical, k, seed, part_col)[1].cost) for k in ks]
