"""The store of metric rows is derived once, by one plan for all imputers."""

import math

import pytest

from lacuna.operators.score.cells import counted_cells
from lacuna.plans import catalog, experiment, q_reports
from lacuna.sources.tables import load
from paths import SF_SMALL


@pytest.fixture
def cold():
    q_reports.reset()
    yield
    q_reports.reset()


def test_reports_that_read_no_density_derive_none(spark, cold, monkeypatch):
    from lacuna.operators.score import kl
    monkeypatch.setattr(kl, "numeric_kl", lambda *a, **k: pytest.fail("a density was derived"))
    assert catalog.queries()["finished_runs"](spark, SF_SMALL).count() == 6


def test_grid_scores_all_imputers_in_one_plan(spark, monkeypatch):
    spec, calls = load(spark, SF_SMALL, "orders"), []
    score = experiment.score
    monkeypatch.setattr(experiment, "score", lambda *a, **k: calls.append(1) or score(*a, **k))
    imputers = ["median-mode", "deletion"]
    keys = ["null_imputer_name", "dataset_part", "column_with_nulls", "subgroup"]
    values = ["sample_size", "kl_divergence_pred", "kl_divergence_total", "rmse", "f1_score"]
    rows = experiment.run_grid(spec, imputers, ["exp1_mcar3"], [100]).select(*keys, *values).collect()
    assert len(calls) == 1
    alone = [r for i in imputers for r in experiment.imputation_metrics(spec, i, "exp1_mcar3", 100).select(*keys, *values).collect()]
    got, want = ({tuple(r[k] for k in keys): [math.nan if r[v] is None else r[v] for v in values] for r in some} for some in (rows, alone))
    assert len(rows) == len(alone) and got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9, nan_ok=True)


def test_categorical_cells_are_counted_before_the_subgroups(spark):
    df = spark.createDataFrame([("p", "A", "u", "v", True)] * 500 + [("p", "B", "u", "u", False)] * 500,
                               "part string, seg string, __real_c string, c string, __miss_c boolean")
    got = {(r.subgroup, r.miss): r.n for r in counted_cells(df, ["c"], {"seg": "A"}).collect()}
    assert got == {("overall", True): 500, ("overall", False): 500, ("seg_dis", True): 500, ("seg_priv", False): 500}
