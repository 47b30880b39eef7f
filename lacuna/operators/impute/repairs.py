"""Repair sets (I13, I14): several candidate repairs of every incomplete row.

A repair = one simple-imputer family applied to the missing cells, originals
kept (P15).  The long repair table (row_id, repair, features...) is built by one
``explode`` over the (small, fixed) list of repair names -- a narrow operator,
no join -- each branch a ``coalesce`` with that repair's fitted statistic.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simple import SimpleImputer

# The numeric x categorical families of the repair space.
NUM_FAMILIES = ["mean", "median", "most_frequent"]
CAT_FAMILIES = ["most_frequent", "constant"]


def repair_families(numeric_missing: bool, categorical_missing: bool):
    """Which families apply depends on which kinds of columns miss values."""
    if numeric_missing and categorical_missing:
        return [f"{n}-{c}" for n, c in itertools.product(NUM_FAMILIES, CAT_FAMILIES)]
    if numeric_missing:
        return [f"{n}-none" for n in NUM_FAMILIES]
    return [f"none-{c}" for c in CAT_FAMILIES]


def fit_repairs(train: DataFrame, numeric, categorical) -> dict:
    """repair name -> column -> fill value (one aggregate job per family)."""
    num_stats = {f: SimpleImputer(f, "constant").fit(train, numeric, []).stats for f in NUM_FAMILIES}
    cat_stats = {f: SimpleImputer("median", f).fit(train, [], categorical).stats for f in CAT_FAMILIES}
    out = {}
    for name in repair_families(bool(numeric), bool(categorical)):
        n, c = name.split("-")
        out[name] = {**(num_stats.get(n, {})), **(cat_stats.get(c, {}))}
    return out


def repair_table(df: DataFrame, repairs: dict, features, row_id: str = "row_id") -> DataFrame:
    """Long table of candidate repairs for every row that has a missing feature."""
    incomplete = None
    for c in features:
        e = F.col(c).isNull()
        incomplete = e if incomplete is None else incomplete | e
    names = sorted(repairs)
    rows = df.where(incomplete).withColumn("repair", F.explode(F.array(*[F.lit(n) for n in names])))
    upd = {}
    for c in features:
        e = None
        for n in names:
            if c in repairs[n]:
                v = F.lit(repairs[n][c])
                e = F.when(F.col("repair") == n, v) if e is None else e.when(F.col("repair") == n, v)
        if e is not None:
            upd[c] = F.coalesce(F.col(c), e)
    return rows.withColumns(upd).select(row_id, "repair", *features)


def _incomplete(columns):
    from functools import reduce
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def ranked_domain(df: DataFrame, columns) -> dict[str, list]:
    """Every value of each column, the most frequent first (smaller values first on ties)."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = df.select(stack.alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, list] = {c: [] for c in columns}
    for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["v"])):  # the categories of the columns
        out[r["c"]].append(r["v"])
    return out


def repair_space(df: DataFrame, numeric, categorical, row_id: str = "row_id", learned: bool = True, seed: int = 0) -> DataFrame:
    """I13, whole: the repairs that apply to the kinds of columns that miss values, as the long
    table (row_id, repair, features).

    Both kinds: every numeric with every categorical family.  Numeric ones alone: mean, least,
    greatest, a quarter and three quarters of the way between them, and with ``learned`` the five
    nearest rows and a chained decision tree.  Categorical ones alone: the most frequent value,
    a value of its own ('dummy'), and every further value of the domain of the first column
    that misses some, by frequency (a column with a smaller domain repeats its last).
    No missing value gives an empty table."""
    numeric, categorical = list(numeric), list(categorical)
    feats = numeric + categorical
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feats]).first()
    gone_num, gone_cat = [c for c in numeric if row[c]], [c for c in categorical if row[c]]
    if not gone_num and not gone_cat:
        return df.limit(0).select(row_id, F.lit("").alias("repair"), *feats)
    if gone_num and gone_cat:
        return repair_table(df, fit_repairs(df, numeric, categorical), feats, row_id)
    if gone_cat:
        domain = ranked_domain(df, categorical)
        nth = lambda c, i: domain[c][min(i, len(domain[c]) - 1)] if domain[c] else None
        repairs = {"mean": {c: nth(c, 0) for c in categorical}, "dummy": {c: "missing" for c in categorical}}
        repairs |= {f"{i + 1}_frequent": {c: nth(c, i) for c in categorical} for i in range(1, len(domain[gone_cat[0]]))}
        return repair_table(df, repairs, feats, row_id)
    fitted = {name: SimpleImputer(how, p=p).fit(df, numeric, []).stats for name, how, p in
              (("mean", "mean", None), ("min", "min", None), ("max", "max", None), ("25-grid", "grid", 25), ("75-grid", "grid", 75))}
    out = repair_table(df, fitted, feats, row_id)
    if learned:
        from .iterative import IterativeImputer
        from .neighbour import knn_impute
        part = df.select(row_id, *feats).withColumn("part", F.lit("train"))
        gone = part.where(_incomplete(feats)).select(F.col(row_id).alias("__id"))
        for name, whole in (("knn", knn_impute(part, "train", numeric, categorical, 5, row_id)),
                            ("dt_iterative", IterativeImputer("decision_tree", seed=seed, row_id=row_id).fit_transform(part, "train", numeric)[0])):
            kept = whole.join(gone, F.col(row_id) == F.col("__id"), "left_semi")
            out = out.unionByName(kept.select(row_id, F.lit(name).alias("repair"), *feats))
    return out


def grid_repairs(df: DataFrame, a: str, b: str, points: int = 4, row_id: str = "row_id") -> DataFrame:
    """For two numeric columns, candidate values = linspace(min, max, points)
    plus the mean of each; a row missing both gets every pair (bounded: (points+1)^2
    per row, the product of two short literal arrays)."""
    r = df.agg(F.min(a).alias("amin"), F.max(a).alias("amax"), F.avg(a).alias("amean"),
               F.min(b).alias("bmin"), F.max(b).alias("bmax"), F.avg(b).alias("bmean")).first()
    va = [float(x) for x in np.linspace(r["amin"], r["amax"], points)] + [float(r["amean"])]
    vb = [float(x) for x in np.linspace(r["bmin"], r["bmax"], points)] + [float(r["bmean"])]
    ca = F.when(F.col(a).isNull(), F.array(*[F.lit(x) for x in va])).otherwise(F.array(F.col(a)))
    cb = F.when(F.col(b).isNull(), F.array(*[F.lit(x) for x in vb])).otherwise(F.array(F.col(b)))
    return (df.withColumn("__a", F.explode(ca)).withColumn("__b", F.explode(cb))
            .withColumn(a, F.col("__a")).withColumn(b, F.col("__b")).drop("__a", "__b"))


def sql_repair_table(src: str, train_src: str, numeric, categorical, row_id: str = "row_id") -> str:
    from .simple import sql_num_stat, sql_rank_value
    feats = list(numeric) + list(categorical)
    arms = []
    for name in repair_families(bool(numeric), bool(categorical)):
        n, c = name.split("-")
        sel = []
        for col in numeric:
            if n == "none":
                sel.append(col)
            elif n == "most_frequent":
                sel.append(f"coalesce({col}, {sql_rank_value(col, train_src, 1, 'DOUBLE')}) AS {col}")
            else:
                sel.append(f"coalesce({col}, {sql_num_stat(col, n, train_src)}) AS {col}")
        for col in categorical:
            if c == "none":
                sel.append(col)
            elif c == "constant":
                sel.append(f"coalesce({col}, 'missing') AS {col}")
            else:
                sel.append(f"coalesce({col}, {sql_rank_value(col, train_src)}) AS {col}")
        arms.append(f"SELECT {row_id}, '{name}' AS repair, {', '.join(sel)} FROM ({src}) WHERE "
                    + " OR ".join(f"{x} IS NULL" for x in feats))
    return " UNION ALL ".join(arms)
