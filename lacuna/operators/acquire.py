"""Feature acquisition (Q0-Q10) over long cells (row, col, value).

Every step is relational: observable cells are an anti join, the next feature
per row is a hash / gain ranked ``row_number`` (bounded by the row's width),
the replay loop is a short driver loop over steps with one imputer refit per
step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_key
from ..session import cut_lineage


def observable(cells: DataFrame, observed: DataFrame, variables: DataFrame | None = None,
               row="row_id", col="col_id") -> DataFrame:
    """Q1: cells that have data, are not observed yet and are queryable."""
    c = cells.join(observed.select(row, col), [row, col], "left_anti")
    if variables is not None:
        c = c.join(variables.where("query").select(F.col("name").alias(col)), col, "left_semi")
    return c


def next_random(cands: DataFrame, n: int, seed: int, step: int = 0, row="row_id", col="col_id") -> DataFrame:
    """Q2: n features per row in seeded hash order."""
    key = hash_key(seed, f"acq:{step}", F.concat_ws(":", F.col(row).cast("string"), F.col(col).cast("string")))
    w = Window.partitionBy(row).orderBy("__k", col)
    return (cands.withColumn("__k", key).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
            .drop("__k", "__r"))


def next_by_global_gain(cands: DataFrame, gains: DataFrame, n: int, row="row_id", col="col_id") -> DataFrame:
    """Q3: one global gain per feature; top n available features per row."""
    w = Window.partitionBy(row).orderBy(F.desc("gain"), col)
    return (cands.join(gains.select(col, "gain"), col).withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= n).drop("__r"))


def next_by_row_gain(cands: DataFrame, gains: DataFrame, n: int, row="row_id", col="col_id") -> DataFrame:
    """Q4: per-row gains, NULL gains excluded, top n per row."""
    g = gains.where(F.col("gain").isNotNull())
    w = Window.partitionBy(row).orderBy(F.desc("gain"), col)
    return (cands.join(g.select(row, col, "gain"), [row, col]).withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= n).drop("__r"))


def improvement_reward(new: DataFrame, old: DataFrame, observed: DataFrame, row="row_id", col="col_id",
                       value="value") -> DataFrame:
    """Q5: max(new - old, 0); NULL where the cell is already observed."""
    j = new.select(row, col, F.col(value).alias("new")).join(old.select(row, col, F.col(value).alias("old")), [row, col])
    j = j.join(observed.select(row, col).withColumn("__obs", F.lit(True)), [row, col], "left")
    return j.select(row, col, F.when(F.col("__obs"), F.lit(None).cast("double"))
                    .otherwise(F.greatest(F.lit(0.0), F.col("new") - F.col("old"))).alias("reward"))


def observed_after_steps(initial: DataFrame, chosen: DataFrame, row="row_id", col="col_id") -> DataFrame:
    """Q6: observed set after each step s = initial + choices of steps <= s."""
    acc = chosen.select(row, col, "step")
    w = Window.partitionBy(row).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_row = acc.groupBy(row, "step").agg(F.collect_set(col).alias("cols"))
    cum = per_row.withColumn("acquired", F.array_distinct(F.flatten(F.collect_list("cols").over(w))))
    base = initial.groupBy(row).agg(F.collect_set(col).alias("initial"))
    return cum.join(base, row, "left").select(
        row, "step", F.array_sort(F.array_union(F.coalesce("initial", F.array().cast("array<string>")),
                                                F.col("acquired").cast("array<string>"))).alias("observed"))


def auic(per_step: DataFrame, metric: str = "metric", by=("strategy",)) -> DataFrame:
    """Q8: area under the information curve = sum of the metric over steps."""
    return per_step.groupBy(*by).agg(F.sum(metric).alias("auic"))


def agreement(a: DataFrame, b: DataFrame, row="row_id", col="col_id") -> DataFrame:
    """Q9: share of (row, step) choices equal to a reference strategy's."""
    j = a.select(row, "step", F.col(col).alias("ca")).join(b.select(row, "step", F.col(col).alias("cb")), [row, "step"])
    return j.groupBy("step").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("agreement"))


def replay(cells: DataFrame, initial: DataFrame, steps: int, seed: int, impute_fn, row="row_id", col="col_id",
           value="value", checkpoint: bool = True) -> tuple:
    """Q0/Q10: each step picks one random observable feature per row, marks it
    observed and re-imputes; returns (choices per step, imputations per step)."""
    observed = initial.select(row, col, value)
    chosen_all, imputed_all = None, None
    for s in range(steps):
        cands = observable(cells, observed, row=row, col=col)
        pick = next_random(cands, 1, seed, s, row, col).withColumn("step", F.lit(s))
        observed = observed.unionByName(pick.select(row, col, value))
        if checkpoint:
            observed = cut_lineage(observed)  # reliable checkpoint: the step chain stays short
        imp = impute_fn(observed).withColumn("step", F.lit(s))
        chosen_all = pick if chosen_all is None else chosen_all.unionByName(pick)
        imputed_all = imp if imputed_all is None else imputed_all.unionByName(imp)
    return chosen_all, imputed_all


# ---- Q0, Q7, Q10: strategies replayed side by side ---------------------------------------------

def global_gains(observed: DataFrame, col="col_id", value="value") -> DataFrame:
    """A gain per (strategy, feature): the variance of what has been observed of it."""
    return observed.groupBy("strategy", col).agg(F.var_pop(value).alias("gain"))


def row_gains(observed: DataFrame, row="row_id", col="col_id", value="value") -> DataFrame:
    """A gain per (strategy, row, feature): how far the feature's mean lies from the mean of
    what the row has shown; rows that have shown nothing have none."""
    means = observed.groupBy("strategy", col).agg(F.avg(value).alias("__m"))
    shown = observed.groupBy("strategy", row).agg(F.avg(value).alias("__s"))
    return means.join(shown, "strategy").select("strategy", row, col, F.abs(F.col("__m") - F.col("__s")).alias("gain"))


def replay_strategies(cells: DataFrame, initial: DataFrame, steps: int, seed: int, impute_fn, strategies=("random", "global", "row"),
                      row="row_id", col="col_id", value="value"):
    """Q10: every strategy acquires one feature a row and step from the same start; gains are
    ranked anew at each step from what its own replay has observed so far.  The state of all
    strategies is one table, which a step writes once.  Ties and rows without a gain go by the
    feature's name, after those with one.  Returns (choices, state, imputations): state has
    the step at which a cell was observed (0: from the start), imputations (strategy, step,
    row, col, imputed) every cell not observed after the step.  ``impute_fn`` fits on the
    observed cells (strategy, row, col, value) and fills those that it is given."""
    names = F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy")
    every = cells.select(names, row, col, value)
    state = cut_lineage(initial.select(names, row, col, value, F.lit(0).alias("step")))
    chosen, imputed = None, None
    for step in range(steps + 1):
        if step:
            left = every.join(state.select("strategy", row, col), ["strategy", row, col], "left_anti")
            seen = state.drop("step")
            tie = hash_key(seed, f"acq:{step - 1}", F.concat_ws(":", F.col(row).cast("string"), F.col(col).cast("string")))
            ranked = (left.join(global_gains(seen, col, value).withColumnRenamed("gain", "__g"), ["strategy", col], "left")
                      .join(row_gains(seen, row, col, value).withColumnRenamed("gain", "__r"), ["strategy", row, col], "left"))
            gain = F.when(F.col("strategy") == "global", F.col("__g")).when(F.col("strategy") == "row", F.col("__r"))
            order = [F.col("gain").desc_nulls_last(), F.when(F.col("strategy") == "random", tie), F.col(col)]
            ranked = ranked.withColumn("gain", gain)
            pick = (ranked.withColumn("__n", F.row_number().over(Window.partitionBy("strategy", row).orderBy(*order))).where("__n = 1")
                    .select("strategy", row, col, value, F.lit(step).alias("step")))
            state = cut_lineage(state.unionByName(pick))
            chosen = state.where(F.col("step") > 0)
        rest = every.join(state.select("strategy", row, col), ["strategy", row, col], "left_anti")
        filled = impute_fn(state.drop("step"), rest).select("strategy", F.lit(step).alias("step"), row, col, "imputed")
        imputed = filled if imputed is None else imputed.unionByName(filled)
    return chosen if chosen is not None else state.limit(0), state, imputed


def step_metrics(cells: DataFrame, imputed: DataFrame, row="row_id", col="col_id", value="value") -> DataFrame:
    """Q7: root mean squared error per strategy, step and column, and for 'all' columns; cells
    that were observed by then count as right."""
    size = cells.groupBy(col).agg(F.count(value).alias("__n"))
    error = (imputed.join(cells.select(row, col, F.col(value).alias("__truth")), [row, col])
             .groupBy("strategy", "step", col).agg(F.sum((F.col("imputed") - F.col("__truth")) ** 2).alias("__e")))
    grid = imputed.select("strategy", "step").distinct().join(size)  # strategies x steps x columns
    per = grid.join(error, ["strategy", "step", col], "left").select("strategy", "step", F.col(col).cast("string").alias("column"), "__n", F.coalesce("__e", F.lit(0.0)).alias("__e"))
    both = per.unionByName(per.withColumn("column", F.lit("all")))
    return both.groupBy("strategy", "step", "column").agg(F.sqrt(F.sum("__e") / F.sum("__n")).alias("rmse"), F.sum("__n").alias("n"))
