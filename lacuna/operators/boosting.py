"""Cross-validation of boosted trees with early stopping (L4).

Every parameter set is boosted to ``max_rounds`` on all folds but one; the held-out loss of
each round is read off that model, and the scan for the best round ends when ``patience``
rounds brought no gain.  A set's mark is its mean loss at the folds' best rounds; the set
with the least mark (the first on ties) is fitted on all rows for the mean best round.
Features are fitted inside the fold.  Losses of all rounds come back, so that every stop can
be checked.  Binary labels only, as Spark's boosted trees; a fold without rows is an error.

Trees are grown from counts by cell (:mod:`cell_trees`), all sets of a fold side by side, each in
a task; tables that could have too many cells go to Spark's learner row by row.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cell_trees as T
from .encode import OneHotScale
from .models import stable_input
from .split import kfold


def stop_round(losses: list[float], patience: int, gain: float = 0.0) -> int:
    """The best round (from 1) that the scan has seen when it ends: the first that no later
    one within ``patience`` rounds of the last improvement undercuts by more than ``gain``."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best] - gain:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _cells(rows: DataFrame, known, feats, numeric, categorical, seed: int, row_id: str):
    """The counts of the ``known`` rows and the others by cell, or None if they could be too many."""
    inputs = [*numeric, *categorical]
    train = rows.where(known)
    n = train.count()
    stable = feats.transform(stable_input(train.select(row_id, *inputs), row_id, n))
    grid = T.Grid.of(stable, n, feats, seed)
    return grid.count(rows, feats, known) if grid else None


def _held_out_losses(cells, params: dict, rounds: int) -> list[float]:
    return [cells.log_loss(m) for m in T.boosted_margins(cells, params["maxDepth"], params["minInstancesPerNode"], rounds)]


def early_stopped_cv(train: DataFrame, numeric, categorical, grid: list[dict], max_rounds: int = 100, patience: int = 10, gain: float = 0.0,
                     folds: int = 3, seed: int = 42, parallelism: int = 4, row_id: str = "row_id"):
    """(losses, choice, model, features).  ``losses``: set, params, fold, round, loss;
    ``choice``: set, params, fold, best_round, best_loss, mean_loss, rounds, chosen."""
    spark = train.sparkSession
    folded = kfold(train, seed, folds, row_id)
    shown = [str(sorted(p.items())) for p in grid]
    losses: dict = {}
    full = [{"maxDepth": 5, "minInstancesPerNode": 1, **p} for p in grid]
    in_cells = all(set(p) <= {"maxDepth", "minInstancesPerNode"} for p in grid)
    for fold in range(folds):
        known, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        feats = OneHotScale(numeric, categorical).fit(known)
        cells = _cells(folded, F.col("fold") != fold, feats, numeric, categorical, seed, row_id) if in_cells else None
        if cells and cells.b0.sum() + cells.b1.sum():
            sent = spark.sparkContext.broadcast(cells)
            for i, got in enumerate(T.in_tasks(spark, full, lambda p: _held_out_losses(sent.value, p, max_rounds))):
                losses[i, fold] = got
            sent.unpersist()
            continue
        a = stable_input(feats.transform(known).select(row_id, "features", "label"), row_id).cache()
        b = feats.transform(held).select(row_id, "features", F.col("label").cast("double").alias("label")).cache()

        def run(i):
            est = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_rounds, seed=seed, **grid[i])
            return i, [float(x) for x in est.fit(a).evaluateEachIteration(b)]

        with ThreadPool(parallelism) as pool:
            for i, got in pool.imap_unordered(run, range(len(grid))):
                losses[i, fold] = got
        a.unpersist()
        b.unpersist()
    stops = {k: stop_round(v, patience, gain) for k, v in losses.items()}
    mark = [sum(losses[i, f][stops[i, f] - 1] for f in range(folds)) / folds for i in range(len(grid))]
    rounds = [max(1, round(sum(stops[i, f] for f in range(folds)) / folds)) for i in range(len(grid))]
    best = min(range(len(grid)), key=lambda i: (mark[i], i))
    feats = OneHotScale(numeric, categorical).fit(train)
    cells = _cells(train, F.lit(True), feats, numeric, categorical, seed, row_id) if in_cells else None
    if cells:
        whole = cells.whole()
        *_, margin = T.boosted_margins(whole, full[best]["maxDepth"], full[best]["minInstancesPerNode"], rounds[best])
        model = T.CellModel(whole.grid, margin > 0, rounds[best])
    else:
        data = stable_input(feats.transform(train).select(row_id, "features", "label"), row_id)
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds[best], seed=seed, **grid[best]).fit(data)
    all_losses = spark.createDataFrame([(i, shown[i], f, r + 1, x) for (i, f), xs in sorted(losses.items()) for r, x in enumerate(xs)],
                                       "set int, params string, fold int, round int, loss double")
    choice = spark.createDataFrame([(i, shown[i], f, stops[i, f], losses[i, f][stops[i, f] - 1], mark[i], rounds[i], i == best)
                                    for i in range(len(grid)) for f in range(folds)],
                                   "set int, params string, fold int, best_round int, best_loss double, mean_loss double, rounds int, chosen boolean")
    return all_losses, choice, model, feats
