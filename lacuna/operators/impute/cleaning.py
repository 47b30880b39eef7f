"""Cleaning a repair space row by row (L21, L24-L28) and what a column is worth.

The repair space is a long table (id, repair, vector, label); a complete row has one repair.
Cleaning replaces the candidates of a dirty row by its true one, the repair nearest to the
clean row.  Rows are cleaned in a hash order, dealt into ``steps`` steps.

A row's similarity to a validation row changes once, at its step, so the whole series needs
one block pass: of the rows a task sees, only those can ever be among the k nearest whose
larger similarity (before or after cleaning) reaches the k-th largest of the smaller ones;
all others stay in the task.  The candidates that are left are ranked again at the steps at
which one of their validation row's changes, no others.  A validation row counts as certain
from the first step on at which the test finds it so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.hashing import hash_index, hash_key
from ...session import write_barrier
from ..encode import OrdinalCodes
from .neighbour import AT_ONCE, _kth, _meet, _squares, knn_topk, repair_extremes


# ---- L21, L28 ------------------------------------------------------------------------------------

def true_repairs(repairs: DataFrame, clean: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``repairs`` with ``is_true``, set for the repair of each row with the least squared
    distance to the clean row (ties by name)."""
    d = F.aggregate(F.zip_with(vec_col, "__clean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    both = repairs.join(clean.select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__clean")), F.col(id_col) == F.col("__id"))
    best = both.groupBy(F.col(id_col).alias("__best_id")).agg(F.min_by("repair", F.struct(d.alias("d"), F.col("repair"))).alias("__best"))
    return (repairs.join(best, F.col(id_col) == F.col("__best_id"))
            .withColumn("is_true", F.col("repair") == F.col("__best")).drop("__best_id", "__best"))


def cleaning_step(id_col: str, steps: int, seed: int):
    """The step (from 1) at which a dirty row is cleaned."""
    return (hash_index(hash_key(seed, "clean", id_col), steps) + 1).cast("int")


def cleaned_table(repairs: DataFrame, steps_done: int, steps: int, seed: int, id_col: str, start: str = "mean") -> DataFrame:
    """One row per id: rows cleaned up to ``steps_done`` with their true repair, other
    dirty rows with the repair ``start``, complete rows as they are.  Needs ``is_true``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))  # the repairs of one row
    done = cleaning_step(id_col, steps, seed) <= steps_done
    marked = repairs.withColumn("__n", n).withColumn("cleaned", (F.col("__n") > 1) & done)
    keep = F.when(F.col("__n") == 1, F.lit(True)).when(F.col("cleaned"), F.col("is_true")).otherwise(F.col("repair") == start)
    return marked.where(keep).drop("__n", "is_true")


# ---- L24, L25 ------------------------------------------------------------------------------------

def _candidates(repairs: DataFrame, val: DataFrame, k: int, steps: int, seed: int, id_col: str, vec_col: str, label: str) -> DataFrame:
    """(qid, rid, rlabel, low, high, true, step) of every row that some world ranks among the k
    most similar, for some class; step 0 for complete rows."""

    def block(q, r):
        names = ["qid", "rid", "rlabel", "low", "high", "true", "step"]
        out = [pd.DataFrame({n: [] for n in names}).astype({"low": float, "high": float, "true": float, "step": "int32"})]
        if len(q) and len(r):
            r = r.sort_values([id_col, "repair"], kind="stable")
            rid, start = np.unique(r[id_col].to_numpy(), return_index=True)
            rl, step = r[label].to_numpy()[start], r["__step"].to_numpy()[start]
            own = np.flatnonzero(r["is_true"].to_numpy())  # one per id, in the order of ids
            dm, qm = (np.stack(x.apply(lambda a: np.asarray(a, dtype=float)).to_numpy()) for x in (r[vec_col], q[vec_col]))
            ids = q["qid"].to_numpy()
            step = np.where(np.diff(np.append(start, len(r))) > 1, step, 0).astype(np.int32)
            for lo in range(0, len(q), AT_ONCE):
                part, at = qm[lo:lo + AT_ONCE], min(k, len(rid))
                squares, slack = _squares(part, dm)
                near, far = np.minimum.reduceat(squares, start, axis=1), np.maximum.reduceat(squares, start, axis=1)
                i, j = np.nonzero(near <= _kth(far, k) + slack)  # in no world can others be among the k
                some, col = np.unique(j, return_inverse=True)
                low, high, true = np.full((3, len(part), len(some)), -np.inf)
                low[i, col], high[i, col], sim, begin = repair_extremes(part, dm, start, i, j)
                true[i, col] = sim[begin + own[j] - start[j]]
                keep = np.zeros(low.shape, bool)
                for c in np.unique(rl).tolist() + [None]:  # None: a class that no row of the block has
                    first = np.where(rl[some] == c, high, low)
                    floor = -np.partition(-np.minimum(first, true), at - 1, axis=1)[:, at - 1]
                    keep |= np.maximum(first, true) >= floor[:, None]
                i, col = np.nonzero(keep)
                j, low, high, true = some[col], low[i, col], high[i, col], true[i, col]
                out.append(pd.DataFrame({"qid": ids[lo + i], "rid": rid[j], "rlabel": rl[j], "low": low, "high": high, "true": true, "step": step[j]}))
        return pd.concat(out[1:] or out)[names]

    types = dict(repairs.dtypes)
    repairs, val = repairs.toDF(*repairs.columns), val.toDF(*val.columns)  # both may come from one table
    rows = repairs.select(id_col, "repair", "is_true", vec_col, label, cleaning_step(id_col, steps, seed).alias("__step"))
    return _meet(val.select(F.col(id_col).alias("qid"), vec_col), rows, "qid", id_col).applyInPandas(
        block, f"qid {dict(val.dtypes)[id_col]}, rid {types[id_col]}, rlabel {types[label]}, low double, high double, true double, step int")


def certain_from(repairs: DataFrame, val: DataFrame, k: int, steps: int, seed: int, id_col: str, vec_col: str, label: str = "label") -> DataFrame:
    """(id, certain_from): the step after which each validation row is certain (0: before any
    cleaning), null where it is not even then.  ``repairs`` needs ``is_true``."""
    found, _ = write_barrier(_candidates(repairs, val, k, steps, seed, id_col, vec_col, label), "cleaning")
    classes = repairs.select(F.col(label).alias("c")).distinct()
    # the steps at which a candidate of the validation row changes
    moved = found.where((F.col("step") > 0) & ((F.col("low") < F.col("true")) | (F.col("true") < F.col("high"))))
    times = moved.select("qid", F.col("step").alias("t")).unionByName(found.select("qid", F.lit(0).alias("t"))).distinct()
    every = times.join(classes.agg(F.collect_list("c").alias("cs"))).select("qid", "t", F.explode("cs").alias("c"))  # one row of classes
    s = F.when((F.col("step") <= F.col("t")) & (F.col("step") > 0), F.col("true")).when(F.col("rlabel") == F.col("c"), F.col("high")).otherwise(F.col("low"))
    ranked = every.join(found, "qid").select("qid", "t", "c", "rid", "rlabel", s.alias("s"))
    w = Window.partitionBy("qid", "t", "c").orderBy(F.desc("s"), "rid")
    top = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    win = majority_vote(top, ["qid", "t", "c"], "rlabel").withColumnRenamed("vote", "pred")
    sure = win.groupBy("qid", "t").agg((F.count_if(F.col("pred") == F.col("c")) == 1).alias("sure"))
    return sure.groupBy(F.col("qid").alias(id_col)).agg(F.min(F.when(F.col("sure"), F.col("t"))).alias("certain_from"))


def cleaning_series(repairs: DataFrame, val: DataFrame, k: int, steps: int, seed: int, id_col: str, vec_col: str, label: str = "label") -> DataFrame:
    """Step (0 to ``steps``), rows_cleaned so far, certain_share of the validation
    rows, needed (false once all rows were certain before the step)."""
    certain = certain_from(repairs, val, k, steps, seed, id_col, vec_col, label)
    dirty = repairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(cleaning_step(id_col, steps, seed).alias("step"))
    marks = certain.select(F.col("certain_from").alias("step"), F.lit(1).alias("sure"), F.lit(0).alias("cleaned")).unionByName(
        dirty.select("step", F.lit(0).alias("sure"), F.lit(1).alias("cleaned")))
    # one row a step from here on
    per_step = marks.groupBy("step").agg(F.sum("sure").alias("sure"), F.sum("cleaned").alias("cleaned"))
    total = per_step.agg(F.sum("sure").alias("n"))
    steps_df = repairs.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = steps_df.join(per_step, "step", "left").select("step", F.sum(F.coalesce("cleaned", F.lit(0))).over(so_far).alias("rows_cleaned"),
                                                         F.sum(F.coalesce("sure", F.lit(0))).over(so_far).alias("sure"))
    share = run.join(total).select("step", "rows_cleaned", F.try_divide(F.col("sure").cast("double"), F.col("n")).alias("certain_share"))
    before = F.coalesce(F.lag("certain_share").over(Window.orderBy("step")), F.lit(0.0))
    return share.withColumn("needed", before < 1.0)


# ---- L26, L27 ------------------------------------------------------------------------------------

def label_entropy(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Entropy (natural logarithm) of the labels of each group, and their number."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.sum("n").alias("n"))


def majority_vote(df: DataFrame, by: list[str], label: str, order: str | None = None) -> DataFrame:
    """The most frequent label of each group as ``vote``; ties go to the lowest label, or
    to the label met first by ``order`` where it is given."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n"), *([F.min(order).alias("__first")] if order else []))
    tie = F.col("__first") if order else F.col(label)
    return n.groupBy(*by).agg(F.min_by(label, F.struct((-F.col("__n")).alias("n"), tie.alias("tie"))).alias("vote"))


# ---- L14 ------------------------------------------------------------------------------------------

def drop_column_neighbours(df: DataFrame, numeric, categorical, k: int, id_col: str, fold: str) -> DataFrame:
    """(qid, variant, did, dist, rank): the k nearest rows of other folds, by all columns
    (variant '') and by all but each.  Numeric columns must be scaled (rows that lack one are
    compared where it is left out); categories that differ add 2, and null is one of them.
    Every variant is a query that misses a coordinate, so ``knn_topk`` finds them all at once
    in its cells of neighbouring rows."""
    numeric, categorical = list(numeric), list(categorical)
    names = numeric + categorical
    codes = OrdinalCodes.fit(df, categorical)
    none = {c: F.lit(float(len(codes.labels.get(c, [])))) for c in categorical}
    rows = codes.encode(df.select(id_col, fold, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in numeric], *categorical))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), none[c]) for c in categorical})
    each = rows.withColumn("variant", F.explode(F.array(*[F.lit(c) for c in [*names, ""]])))
    for c in numeric:
        each = each.where((F.col("variant") == c) | F.col(c).isNotNull())
    queries = each.withColumns({c: F.when(F.col("variant") != c, F.col(c)) for c in names}).withColumn("__q", F.struct(F.col(id_col).alias("qid"), "variant"))
    near = knn_topk(queries, rows.withColumnRenamed(id_col, "did"), k, "__q", "did", numeric, categorical, scaled=False, apart=fold)
    # without any column left all rows are equally near
    return near.select("__q.qid", "__q.variant", "did", F.when(F.col("dist") == float("inf"), 0.0).otherwise(F.col("dist")).alias("dist"), "rank")


def drop_column_importance(df: DataFrame, numeric, categorical, k: int, id_col: str, label: str, fold: str) -> DataFrame:
    """Column, accuracy with all columns and without this one (mean over the folds of a
    majority vote of the k nearest rows of other folds, ties to the lowest label), importance."""
    near = drop_column_neighbours(df, numeric, categorical, k, id_col, fold)
    voted = majority_vote(near.join(df.select(F.col(id_col).alias("did"), F.col(label).alias("nlabel")), "did"), ["qid", "variant"], "nlabel")
    truth = df.select(F.col(id_col).alias("qid"), F.col(label).alias("__label"), F.col(fold).alias("__fold"))
    per_fold = voted.join(truth, "qid").groupBy("variant", "__fold").agg(F.avg((F.col("vote") == F.col("__label")).cast("double")).alias("a"))
    mean = per_fold.groupBy("variant").agg(F.avg("a").alias("accuracy"))
    whole = mean.where("variant = ''").select(F.col("accuracy").alias("accuracy_all"))
    return (mean.where("variant <> ''").join(whole)
            .select(F.col("variant").alias("column"), "accuracy_all", F.col("accuracy").alias("accuracy_without"),
                    (F.col("accuracy_all") - F.col("accuracy")).alias("importance")))
