"""Rank correlations, mixed layouts and replayed strategies against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.hashing import hash_key
from lacuna.operators import acquire as Q
from lacuna.operators.correlation import average_ranks, rank_correlations
from lacuna.operators.mixed import Layout


def ranks(values):
    out = []
    for v in values:
        less, same = sum(x < v for x in values), sum(x == v for x in values)
        out.append(less + (same + 1) / 2)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_correlations(spark, parts):
    rng = np.random.default_rng(0)
    rows = [("uv"[i % 2] if i % 9 else None, float(rng.integers(6)), float(rng.normal()), None if i % 11 == 4 else float(i % 5), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double").repartition(parts)
    by = defaultdict(list)
    for r in rows:
        if None not in r[1:]:
            by[r[0]].append(r[1:])
    got = {(r["g"], r["feature_a"], r["feature_b"]): (r["spearman"], r["n"]) for r in rank_correlations(df, list("abcd"), ["g"]).collect()}
    assert len(got) == 3 * 6
    for g, held in by.items():
        cols = dict(zip("abcd", ([*map(float, ranks(c))] for c in zip(*held))))
        for x, y in ("ab", "ac", "bc"):
            assert math.isclose(got[g, x, y][0], np.corrcoef(cols[x], cols[y])[0, 1], abs_tol=1e-9) and got[g, x, y][1] == len(held)
        assert got[g, "a", "d"][0] is None  # a constant column
    one = rank_correlations(df, ["a", "b"], (), ["b"]).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in one] == [("a", "b")]


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 3.0, 2.0)], "a double").repartition(3)
    assert {r["value"]: r["rank"] for r in average_ranks(df, ["a"]).collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}
    assert rank_correlations(df.select("a", F.col("a").alias("b"), F.lit("g").alias("g")).limit(0), ["a", "b"], ["g"]).count() == 0


LAYOUT = [("b", "binary", None, "int"), ("x", "continuous", (-5.0, 5.0), "double"), ("s", "categorical", ("p", "q", "r"), "string"), ("k", "categorical", ("7", "9"), "int")]


def test_mixed_round_trip_and_masks(spark):
    rows = [(1, 0, -5.0, "p", 7), (2, 1, 2.5, "r", 9), (3, None, None, None, None), (4, 1, 7.5, "q", 7), (5, 0, 0.0, "zz", 9)]
    df = spark.createDataFrame(rows, "id int, b int, x double, s string, k int")
    layout = Layout(LAYOUT)
    assert layout.width == 7 and [s.start for s in layout.slots] == [0, 1, 2, 5]
    slots = {r["id"]: r["slots"] for r in layout.process(df).collect()}
    assert slots[1] == [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0] and slots[2] == [1.0, 0.75, 0.0, 0.0, 1.0, 0.0, 1.0]
    assert slots[3] == [None] * 7 and slots[4][1] == 1.25 and slots[5][2:5] == [None] * 3
    back = {r["id"]: tuple(r)[1:] for r in layout.revert(layout.process(df)).collect()}
    assert back == {r[0]: (r[1:3] + ((None,) if r[3] == "zz" else r[3:4]) + r[4:]) for r in rows}
    masks = df.withColumn("m", layout.observed()).withColumn("w", layout.expand_mask("m")).withColumn("back", layout.squash_mask("w")).collect()
    for r in masks:
        assert r["back"] == r["m"] and r["w"] == [f for f, s in zip(r["m"], layout.slots) for _ in range(s.width)]
    soft = spark.createDataFrame([([0.2, 0.5, 0.3, 0.3, 0.1, 0.0, 1.0],)], "slots array<double>")
    assert tuple(layout.revert(soft).first()) == (0, 0.0, "p", 9)  # the first of equal slots


def test_layout_is_read_and_checked(spark):
    df = spark.createDataFrame([(1, 2.0, "u"), (0, 6.0, "t"), (None, None, None)], "b int, x double, s string")
    layout = Layout.read(df, ["b"], ["x"], ["s"])
    assert [(s.name, s.levels, s.lower, s.scale) for s in layout.slots] == [("b", (), 0.0, 1.0), ("x", (), 2.0, 4.0), ("s", ("t", "u"), 0.0, 1.0)]
    assert layout.revert(layout.process(df)).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        Layout([("x", "text", None, "string")])
    with pytest.raises(ValueError):
        Layout([("x", "categorical", ("a", "a"), "string")])


def test_replay_of_strategies(spark):
    rng = np.random.default_rng(1)
    cells = [(r, f"f{c}", float(rng.normal(c, c + 1))) for r in range(12) for c in range(4) if rng.random() < 0.9]
    start = [x for x in cells if rng.random() < 0.5]
    df, initial = (spark.createDataFrame(x, "row_id bigint, col_id string, value double") for x in (cells, start))

    def means(observed, rest):
        return rest.join(observed.groupBy("strategy", "col_id").agg(F.avg("value").alias("imputed")), ["strategy", "col_id"])

    chosen, state, imputed = Q.replay_strategies(df, initial, 2, 5, means)
    got = {(r["strategy"], r["step"], r["row_id"]): r["col_id"] for r in chosen.collect()}
    key = {(s, r["row_id"], r["col_id"]): r["k"] for s in (0, 1) for r in df.withColumn("k", hash_key(5, f"acq:{s}", F.concat_ws(":", F.col("row_id").cast("string"), "col_id"))).collect()}
    metrics = {(r["strategy"], r["step"], r["column"]): r["rmse"] for r in Q.step_metrics(df, imputed).collect()}
    for strategy in ("random", "global", "row"):
        seen = list(start)
        for step in (0, 1, 2):
            if step:
                by_col, by_row, taken = defaultdict(list), defaultdict(list), []
                for r, c, v in seen:
                    by_col[c].append(v)
                    by_row[r].append(v)
                for r in range(12):
                    left = [x for x in cells if x[0] == r and x not in seen]
                    if not left:
                        assert (strategy, step, r) not in got
                        continue
                    gain = {"random": lambda x: None, "global": lambda x: np.var(by_col[x[1]]) if by_col[x[1]] else None,
                            "row": lambda x: abs(np.mean(by_col[x[1]]) - np.mean(by_row[r])) if by_col[x[1]] and by_row[r] else None}[strategy]
                    best = min(left, key=lambda x: (gain(x) is None, -(gain(x) or 0), key[step - 1, r, x[1]] if strategy == "random" else "", x[1]))
                    assert got[strategy, step, r] == best[1]
                    taken.append(best)
                seen += taken
            mean = {c: np.mean([v for _, k, v in seen if k == c]) for c in {x[1] for x in seen}}
            e = {x: (mean[x[1]] - x[2]) ** 2 for x in cells if x not in seen}
            assert math.isclose(metrics[strategy, step, "all"], math.sqrt(sum(e.values()) / len(cells)), abs_tol=1e-9)
            for c in {x[1] for x in cells}:
                assert math.isclose(metrics[strategy, step, c], math.sqrt(sum(v for k, v in e.items() if k[1] == c) / sum(x[1] == c for x in cells)), abs_tol=1e-9)
