"""Scoring formulas on hand-made tables and a numpy brute force for the KDE KL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators.score import kl
from lacuna.operators.score.cells import cells, score
from lacuna.operators.score.kl import ABSENT, SQRT2PI


def kde_kl_reference(true: np.ndarray, pred: np.ndarray, grid: int = 1000):
    """Plain numpy version of the same definition (for brute-force checks)."""
    true = np.asarray(true, float)
    pred = np.asarray(pred, float)
    mu, sd = true.mean(), true.std()
    s = sd if sd != 0 else 1.0
    ts, ps = (true - mu) / s, (pred - mu) / s
    if len(true) <= 2:
        return None
    ut, up = len(np.unique(true)), len(np.unique(pred))
    lo, hi = min(ts.min(), ps.min()), max(ts.max(), ps.max())

    def kde(v, x):
        h = v.std(ddof=1) * len(v) ** -0.2
        d = (x[None, :] - v[:, None]) / h
        return np.exp(-0.5 * d * d).sum(axis=0) / (len(v) * h * SQRT2PI)

    if up == 1 and ut == 1:
        return 0.0 if pred[0] == true[0] else 100.0
    if up == 1:
        x = np.append(np.linspace(lo, hi, grid - 1), ps[0])
        P, Q = kde(ts, x), np.where(x == ps[0], 1.0, ABSENT)
    elif ut == 1:
        x = np.append(np.linspace(lo, hi, grid - 1), ts[0])
        P, Q = np.where(x == ts[0], 1.0, ABSENT), kde(ps, x)
    else:
        x = np.linspace(lo, hi, grid)
        P, Q = kde(ts, x), kde(ps, x)
        Q[Q == 0] = ABSENT
    P, Q = P / P.sum(), Q / Q.sum()
    return float(np.sum(P * np.log(P / Q)))


def _table(spark, rows):
    # rows: (part, seg, real_x, imputed_x, miss_x, real_c, imputed_c, miss_c)
    df = spark.createDataFrame(rows, "part string, seg string, __real_x double, x double, __miss_x boolean, "
                                     "__real_c string, c string, __miss_c boolean")
    return df


def test_rmse_accuracy_and_categorical_kl(spark):
    rows = [("p", "A", 1.0, 2.0, True, "u", "u", True), ("p", "A", 3.0, 2.0, True, "v", "u", True),
            ("p", "B", 5.0, 5.0, False, "v", "v", False), ("p", "B", 7.0, 2.0, True, "w", "u", True)]
    m = score(_table(spark, rows), ["x"], ["c"], {"seg": "A"}, numeric_kl=False)
    got = {(r.column_with_nulls, r.subgroup): r for r in m.collect()}
    t, p = np.array([1, 3, 7.0]), np.array([2, 2, 2.0])
    assert got[("x", "overall")].sample_size == 3
    assert got[("x", "overall")].rmse == pytest.approx(np.sqrt(np.mean((t - p) ** 2)) / t.std())
    assert got[("c", "overall")].f1_score == pytest.approx(1 / 3)
    # KL pred on categories: P = (u 1/3, v 1/3, w 1/3), Q = (u 1, v 1e-9, w 1e-9), renormalised
    P = np.array([1, 1, 1]) / 3
    Q = np.array([1, 1e-9, 1e-9])
    Q = Q / Q.sum()
    assert got[("c", "overall")].kl_divergence_pred == pytest.approx(float(np.sum(P * np.log(P / Q))))
    assert got[("c", "seg_dis")].sample_size == 2 and got[("x", "seg_priv")].sample_size == 1


def test_constant_truth_rmse_uses_unit_scale(spark):
    rows = [("p", "A", 4.0, 1.0, True, "u", "u", False)] * 3
    r = score(_table(spark, rows), ["x"], [], {"seg": "A"}, numeric_kl=True).where("subgroup = 'overall'").first()
    assert r.rmse == pytest.approx(3.0)
    assert r.kl_divergence_pred == 100.0  # both sides constant, different values


@pytest.mark.parametrize("case", ["kde", "pred_point", "true_point", "tiny"])
def test_numeric_kl_matches_numpy_brute_force(spark, case):
    rng = np.random.default_rng(5)
    t = rng.normal(10, 3, 400)
    p = t + rng.normal(0, 2, 400)
    if case == "pred_point":
        p = np.full(400, np.median(t))
    if case == "true_point":
        t = np.full(400, 4.0)
    if case == "tiny":
        t, p = t[:2], p[:2]
    rows = [("p", "A", float(a), float(b), True, "u", "u", False) for a, b in zip(t, p)]
    df = _table(spark, rows).repartition(4)
    r = score(df, ["x"], [], {"seg": "A"}).where("subgroup = 'overall'").first()
    ref = kde_kl_reference(t, p)
    if ref is None:
        assert r.kl_divergence_pred is None
    else:
        assert r.kl_divergence_pred == pytest.approx(ref, rel=1e-9, abs=1e-12)
        assert r.kl_divergence_total == pytest.approx(ref, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("narrow", [False, True])
def test_density_work_follows_cells_not_values(spark, narrow):
    """20,000 different values a side: the rows evaluated on the grid are cells, and the
    result is that of every value; also where the imputed side's density is zero."""
    rng = np.random.default_rng(11)
    t = rng.normal(10, 3, 20_000)
    p = rng.normal(10, 0.05, 20_000) if narrow else np.concatenate([t[:10_000], rng.exponential(2, 10_000)])
    df = _table(spark, [("p", "A", float(a), float(b), True, "u", "u", False) for a, b in zip(t, p)]).repartition(4)
    scoped = kl._scoped(cells(df, ["x"], {"seg": "A"}, "double").where("subgroup = 'overall'"))
    per_side = kl.density_cells(scoped, kl._group_stats(scoped, 1000)).groupBy("gid", "side").count().collect()
    assert len(per_side) == 4 and all(r["count"] < 2_500 for r in per_side)
    r = score(df, ["x"], [], {"seg": "A"}).where("subgroup = 'overall'").first()
    ref = kde_kl_reference(t, p)
    assert r.kl_divergence_pred == pytest.approx(ref, rel=1e-9)
    assert r.kl_divergence_total == pytest.approx(ref, rel=1e-9)


def test_subgroup_membership(spark):
    from lacuna.operators.score.groups import membership
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "s string, r string")
    got = [sorted(r.g) for r in df.select(membership({"s": "a", "r": ["x"], "s & r": None}).alias("g")).collect()]
    assert got[0] == sorted(["overall", "s_dis", "r_dis", "s&r_dis"])
    assert got[1] == sorted(["overall", "s_dis", "r_priv"])
    assert got[2] == sorted(["overall", "s_priv", "r_dis"])
    assert got[3] == sorted(["overall", "r_dis"])
