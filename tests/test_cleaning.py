"""Cleaning series, drop-column importance, votes and early stopping against plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.hashing import hash_index, hash_key
from lacuna.operators import boosting as B
from lacuna.operators.impute import cleaning as C
from lacuna.operators.impute import neighbour as N

K, STEPS, SEED = 3, 4, 7


def space(n=40, n_val=12, seed=0):
    rng = np.random.default_rng(seed)
    clean = [(i, [float(x) for x in rng.normal(0, 1, 3)], int(rng.integers(3))) for i in range(n)]
    repairs = []
    for i, v, label in clean:
        if i % 3:
            repairs.append((i, "clean", v, label))
        else:
            for name, d in (("mean", 0.0), ("min", -2.0), ("max", 2.5)):
                repairs.append((i, name, [d, *v[1:]], label))
    val = [(1000 + i, [float(x) for x in rng.normal(0, 1, 3)], 0) for i in range(n_val)]
    return clean, repairs, val


def frames(spark, clean, repairs, val):
    return (spark.createDataFrame(clean, "id bigint, vec array<double>, label int"), spark.createDataFrame(repairs, "id bigint, repair string, vec array<double>, label int"),
            spark.createDataFrame(val, "id bigint, vec array<double>, label int"))


def nearest(clean, repairs):
    by = {i: v for i, v, _ in clean}
    out = {}
    for i, name, v, _ in repairs:
        d = sum((a - b) ** 2 for a, b in zip(v, by[i]))
        out[i] = min(out.get(i, (d, name)), (d, name))
    return {i: name for i, (_, name) in out.items()}


def brute(clean, repairs, val, step_of):
    """Per validation row the steps at which it is certain, every step tested anew."""
    true, by = nearest(clean, repairs), defaultdict(dict)
    label = {i: y for i, _, _, y in repairs}
    for i, name, v, _ in repairs:
        by[i][name] = np.array(v)
    out = {}
    for q, x, _ in val:
        sims = {i: {n: 1 / (1 + math.sqrt(((np.array(x) - v) ** 2).sum())) for n, v in reps.items()} for i, reps in by.items()}
        for t in range(STEPS + 1):
            wins = []
            for c in set(label.values()):
                s = {}
                for i, reps in sims.items():
                    done = len(reps) > 1 and step_of[i] <= t
                    s[i] = reps[true[i]] if done else (max if label[i] == c else min)(reps.values())
                top = sorted(s, key=lambda i: (-s[i], i))[:K]
                votes = Counter(label[i] for i in top)
                wins.append(min(votes, key=lambda y: (-votes[y], y)) == c)
            out.setdefault(q, []).append(sum(wins) == 1)
    return out


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (7, 5)])
def test_series_equals_full_recomputation(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "DONOR_BLOCK", blocks[0])
    monkeypatch.setattr(N, "QUERY_BLOCK", blocks[1])
    clean, repairs, val = space()
    c, r, v = frames(spark, clean, repairs, val)
    step_of = {x["id"]: x["s"] for x in c.select("id", C.cleaning_step("id", STEPS, SEED).alias("s")).collect()}
    want = brute(clean, repairs, val, step_of)
    marked = C.true_repairs(r.repartition(3), c, "id", "vec")
    got = {x["id"]: x["certain_from"] for x in C.certain_from(marked, v, K, STEPS, SEED, "id", "vec").collect()}
    assert got == {q: (flags.index(True) if True in flags else None) for q, flags in want.items()}
    dirty = {i for i, name, _, _ in repairs if name != "clean"}
    rows = C.cleaning_series(marked, v, K, STEPS, SEED, "id", "vec").orderBy("step").collect()
    assert [x["step"] for x in rows] == list(range(STEPS + 1))
    for x in rows:
        assert x["rows_cleaned"] == sum(step_of[i] <= x["step"] for i in dirty)
        assert math.isclose(x["certain_share"], sum(any(f[:x["step"] + 1]) for f in want.values()) / len(val))
    assert rows[-1]["certain_share"] == 1.0  # one world is left


def test_true_repairs_and_cleaned_table(spark):
    clean, repairs, val = space()
    c, r, _ = frames(spark, clean, repairs, val)
    marked = C.true_repairs(r, c, "id", "vec")
    true = nearest(clean, repairs)
    assert {x["id"]: x["repair"] for x in marked.where("is_true").collect()} == true
    step_of = {x["id"]: x["s"] for x in c.select("id", C.cleaning_step("id", STEPS, SEED).alias("s")).collect()}
    got = {x["id"]: (x["repair"], x["cleaned"]) for x in C.cleaned_table(marked, 2, STEPS, SEED, "id").collect()}
    dirty = {i for i, name, _, _ in repairs if name != "clean"}
    assert got == {i: ((true[i], True) if i in dirty and step_of[i] <= 2 else ("mean" if i in dirty else "clean", False)) for i, _, _ in clean}


def test_votes_and_entropy(spark):
    rows = [("x", "b", 1), ("x", "a", 2), ("x", "b", 3), ("x", "a", 4), ("y", "c", 5), ("z", "a", 6), ("z", None, 7)]
    df = spark.createDataFrame(rows, "g string, label string, at int")
    assert {r["g"]: r["vote"] for r in C.majority_vote(df.where("label IS NOT NULL"), ["g"], "label").collect()} == {"x": "a", "y": "c", "z": "a"}
    assert {r["g"]: r["vote"] for r in C.majority_vote(df.where("label IS NOT NULL"), ["g"], "label", "at").collect()} == {"x": "b", "y": "c", "z": "a"}
    got = {r["g"]: (r["entropy"], r["n"]) for r in C.label_entropy(df, ["g"]).collect()}
    assert math.isclose(got["x"][0], math.log(2)) and abs(got["y"][0]) < 1e-12 and math.isclose(got["z"][0], math.log(2)) and got["x"][1] == 4


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (20, 11)])
def test_importance_equals_a_run_per_column(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "DONOR_BLOCK", blocks[0])
    monkeypatch.setattr(N, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(8)), float(rng.normal()), "uvw"[rng.integers(3)], int(rng.integers(2))) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c string, label int").withColumn("fold", hash_index(hash_key(1, "fold", "id"), 3).cast("int"))
    fold = {r["id"]: r["fold"] for r in df.collect()}

    def accuracy(cols):
        hits = defaultdict(list)
        for r in rows:
            d = sorted((math.sqrt(sum((r[j] - s[j]) ** 2 if j < 3 else 2.0 * (r[j] != s[j]) for j in cols)), s[0]) for s in rows if fold[s[0]] != fold[r[0]])[:3]
            votes = Counter(rows[i][4] for _, i in d)
            hits[fold[r[0]]].append(min(votes, key=lambda y: (-votes[y], y)) == r[4])
        return np.mean([np.mean(h) for h in hits.values()])

    got = {r["column"]: r for r in C.drop_column_importance(df, ["a", "b"], ["c"], 3, "id", "label", "fold").collect()}
    for j, c in ((1, "a"), (2, "b"), (3, "c")):
        assert math.isclose(got[c]["accuracy_all"], accuracy([1, 2, 3])) and math.isclose(got[c]["accuracy_without"], accuracy([x for x in (1, 2, 3) if x != j]))
        assert math.isclose(got[c]["importance"], got[c]["accuracy_all"] - got[c]["accuracy_without"])


def test_importance_meets_cells_not_all_blocks(spark, monkeypatch):
    """Rows are compared in cells of neighbours (F13), many cells a variant and fold, with the
    neighbours of a plain search; a row without a number is compared where it is left out."""
    monkeypatch.setattr(N, "DONOR_CELL", 64)
    monkeypatch.setattr(N, "_meet", lambda *a: pytest.fail("all pairs of blocks"))
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(40)), float(rng.normal()) if i % 50 else None, "uvw"[rng.integers(3)] if i % 70 else None, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c string, fold int")
    got = defaultdict(list)
    for r in C.drop_column_neighbours(df, ["a", "b"], ["c"], 3, "id", "fold").collect():
        got[r["qid"], r["variant"]].append((r["rank"], r["dist"], r["did"]))
    for variant, cols in {"": [1, 2, 3], "a": [2, 3], "b": [1, 3], "c": [1, 2]}.items():
        some = [r for r in rows if r[2] is not None or 2 not in cols]
        for r in some:
            d = sorted((math.sqrt(sum((r[j] - s[j]) ** 2 if j < 3 else 2.0 * (r[j] != s[j]) for j in cols)), s[0]) for s in some if s[4] != r[4])[:3]
            assert [x[2] for x in sorted(got[r[0], variant])] == [i for _, i in d]
            assert [x[1] for x in sorted(got[r[0], variant])] == pytest.approx([x for x, _ in d])
    assert sum(map(len, got.values())) == 3 * (3 * sum(r[2] is not None for r in rows) + len(rows))


def test_stop_round():
    def scan(losses, patience):
        """The best round among those seen before ``patience`` rounds passed without a gain."""
        for end in range(1, len(losses) + 1):
            seen = losses[:end]
            if end - 1 - seen.index(min(seen)) >= patience:
                return seen.index(min(seen)) + 1
        return losses.index(min(losses)) + 1

    rng = np.random.default_rng(0)
    for _ in range(300):
        losses = [float(x) for x in rng.integers(0, 12, rng.integers(1, 25))]
        for patience in (1, 2, 5, 30):
            assert B.stop_round(losses, patience) == scan(losses, patience)
    assert B.stop_round([5.0, 4.0, 3.95, 3.0], 1, gain=0.1) == 2


def test_early_stopped_boosting(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), "uv"[i % 2], int(x + rng.normal(0, 1) > 0)) for i, x in enumerate(rng.normal(0, 1, 240))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, c string, label int")
    losses, choice, model, feats = B.early_stopped_cv(df, ["a"], ["c"], [{"maxDepth": 2}, {"maxDepth": 4}], max_rounds=8, patience=2, folds=2)
    by = defaultdict(list)
    for r in losses.orderBy("round").collect():
        by[r["set"], r["fold"]].append(r["loss"])
    assert all(len(v) == 8 for v in by.values()) and len(by) == 4
    rows = choice.collect()
    for r in rows:
        assert r["best_round"] == B.stop_round(by[r["set"], r["fold"]], 2) and r["best_loss"] == by[r["set"], r["fold"]][r["best_round"] - 1]
    mean = {s: np.mean([r["best_loss"] for r in rows if r["set"] == s]) for s in (0, 1)}
    chosen = {r["set"] for r in rows if r["chosen"]}
    assert chosen == {min(mean, key=lambda s: mean[s])}
    assert model.getNumTrees == next(r["rounds"] for r in rows if r["chosen"])
    assert model.transform(feats.transform(df)).where(F.col("prediction") == F.col("label")).count() > 140


def test_repair_spaces_by_kind(spark):
    from lacuna.operators.impute.repairs import repair_space
    rows = [(i, None if i % 4 == 1 else float(i), None if i % 5 == 2 else float(-i), None if i % 3 == 0 else "uuuvvw"[i % 6], "pq"[i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, s string, t string")
    names = lambda out: {r[0] for r in out.select("repair").distinct().collect()}
    num = repair_space(df, ["a", "b"], ["t"])
    assert names(num) == {"mean", "min", "max", "25-grid", "75-grid", "knn", "dt_iterative"}
    gone = {r[0] for r in rows if None in r[1:3]}
    assert num.count() == 7 * len(gone) and num.where("a IS NULL OR b IS NULL").count() == 0
    seen = [r[1] for r in rows if r[1] is not None]
    got = {(r["row_id"], r["repair"]): r["a"] for r in num.collect()}
    assert got[1, "25-grid"] == min(seen) + (max(seen) - min(seen)) * 0.25 and got[1, "max"] == max(seen) and got[2, "min"] == 2.0
    cat = {(r["row_id"], r["repair"]): r["s"] for r in repair_space(df, [], ["s", "t"]).collect()}
    values = Counter(r[3] for r in rows if r[3])
    ranked = sorted(values, key=lambda v: (-values[v], v))
    assert [cat[0, n] for n in ["mean", *[f"{i}_frequent" for i in range(2, len(ranked) + 1)]]] == ranked and cat[0, "dummy"] == "missing"
    assert len(names(repair_space(df, ["a", "b"], ["s", "t"]))) == 6
    assert repair_space(df, [], ["t"]).count() == 0
