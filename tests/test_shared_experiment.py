"""Queries that train models of their own do not tune the five of the registry."""

import pytest

from lacuna.operators.models import tune
from lacuna.plans import catalog, q_models
from paths import SF_SMALL


def test_importance_tunes_no_other_model(spark, monkeypatch):
    q_models.reset()
    monkeypatch.setattr(q_models.M, "tune", lambda *a, **k: pytest.fail("models were tuned"))
    try:
        assert catalog.queries()["rf_feature_importance"](spark, SF_SMALL).count() > 0
        spec, _, imputed, feats = q_models._imputed(spark, SF_SMALL)
    finally:
        q_models.reset()
    # the features that tuning would have fitted
    train = imputed.where("part = 'X_train_val'")
    want = tune(train, spec.numeric, spec.categorical, names=("lr_clf",), folds=2, seed=q_models.SEED, grid="small")[2]
    a, b = (f.transform(train).select("row_id", "features").orderBy("row_id").limit(50).collect() for f in (feats, want))
    assert feats.names == want.names and a == b
