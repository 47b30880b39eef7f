"""the model queries tune the whole grid, every parameter set of it once a fold."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier

from lacuna.operators import cell_trees as T
from lacuna.operators import models as M
from lacuna.operators.encode import OneHotScale
from lacuna.operators.models import stable_input
from lacuna.plans import q_models
from paths import SF_SMALL
from test_cell_trees import _rows


def test_queries_ask_for_the_whole_grid(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "model_registry", lambda seed=42, n_features=1, n_rows=1, grid="full": asked.append(grid))
    q_models.reset()
    try:
        with pytest.raises(Exception):
            q_models._experiment(spark, SF_SMALL)
    finally:
        q_models.reset()
    assert asked and set(asked) == {"full"}


@pytest.mark.parametrize("name,sets,runs", [("dt_clf", 40, 10), ("gbt_clf", 224, 56), ("rf_clf", 108, 6)])
def test_every_set_of_the_grid_is_read_once(spark, name, sets, runs):
    est, params = M.model_registry(grid="full")[name]
    grouped = M._grouped(name, {i: M._values(est, p) for i, p in enumerate(params)})
    assert sorted(i for wanted in grouped.values() for i, _, _ in wanted) == list(range(sets)) and len(grouped) == runs


def _cells(spark):
    df = _rows(spark)
    feats = OneHotScale(["x", "y"], ["k"]).fit(df)
    a = stable_input(feats.transform(df)).cache()
    grid = T.Grid.of(a, a.count(), feats, 3)
    return df, feats, grid.count(a, feats)


def test_fewer_trees_are_the_first_of_more_and_votes_do_not_depend_on_tasks(spark):
    df, _, cells = _cells(spark)
    whole = T.forest_votes(cells, [3, 6], 2, True, 1, 0, 6)
    parts = [T.forest_votes(cells, [3, 6], 2, True, 1, *ab) for ab in ((0, 1), (1, 4), (4, 6))]
    for d in (3, 6):
        assert np.allclose(whole[d], sum(p[d] for p in parts))
        # a shallow forest is the top of the deep one
        assert np.allclose(whole[3], T.forest_votes(cells, [3], 2, True, 1, 0, 6)[3])
    said = whole[6] > 3
    assert cells.a1[said].sum() + cells.a0[~said].sum() > 0.75 * 1500


def test_a_fitted_model_predicts_as_the_row_learner(spark):
    df, feats, _ = _cells(spark)
    tuned, fitted, feats = M.tune(df, ["x", "y"], ["k"], names=("gbt_clf", "rf_clf"), folds=2, seed=3, grid="small")
    rows = feats.transform(df)
    got = {r["row_id"]: r["prediction"] for r in fitted["gbt_clf"].transform(rows).select("row_id", "prediction").collect()}
    want = GBTClassifier(seed=3, maxIter=10, maxDepth=3).fit(stable_input(rows.select("row_id", "features", "label")))
    assert got == {r["row_id"]: r["prediction"] for r in want.transform(rows).select("row_id", "prediction").collect()}
    assert fitted["rf_clf"].getNumTrees == 20 and M.macro_f1_and_accuracy(fitted["rf_clf"].transform(rows))[1] > 0.75
    assert tuned.count() == 2


def test_bootstrap_rows_are_dealt_once(spark, monkeypatch):
    """replicas are filters of one table in partitions, not a shuffle each."""
    from pyspark.ml.classification import LogisticRegression
    df = _rows(spark, 300)
    feats, dealt, stable = OneHotScale(["x", "y"], ["k"]).fit(df), [], M.stable_input
    monkeypatch.setattr(M, "stable_input", lambda *a, **k: dealt.append(1) or stable(*a, **k))
    preds = M.bootstrap_predictions(df, df, feats, LogisticRegression(featuresCol="features", labelCol="label"), replicas=3, seed=1)
    assert preds.count() == 900 and dealt == [1]
