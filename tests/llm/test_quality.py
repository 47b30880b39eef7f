import duckdb
import numpy as np

from lacuna.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_against_labels_never_seen(spark):
    """The labels take no part in the fit, so all of them are held out."""
    out = {r["doc_id"]: r for r in Q.op1_quality(spark, SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    good = [out[d]["keep"] for d, q in labels if q == 1]
    poor = [out[d]["keep"] for d, q in labels if q == 0]
    assert len(good) > 100 and len(poor) > 20
    assert np.mean(good) >= 0.98
    assert np.mean(poor) <= 0.10


def test_em_finds_prior_and_accuracies():
    rng = np.random.default_rng(5)
    n, acc = 40_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6])
    y = np.where(rng.random(n) < 0.75, 1, -1)
    votes = np.where(rng.random((n, 6)) < acc, y[:, None], -y[:, None]) * (rng.random((n, 6)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit_label_model(patterns, counts.astype(float), kinds=1, belief=0.0)
    assert abs(model.prior - 0.75) < 0.02
    assert np.abs(model.accuracies() - acc).max() < 0.03


def test_junk_known_to_few_labellers_is_not_their_noise():
    """Three kinds of junk, each seen by two of six labellers."""
    rng = np.random.default_rng(6)
    n = 30_000
    kind = rng.choice(4, n, p=[0.85, 0.1, 0.03, 0.02])
    votes = np.ones((n, 6), int)
    for k in range(6):
        votes[(kind == k // 2 + 1) & (rng.random(n) < 0.95), k] = -1
        votes[rng.random(n) < 0.002, k] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit_label_model(patterns, counts.astype(float))
    right = (model.posterior(votes) >= 0.5) == (kind == 0)
    assert right.mean() > 0.98 and abs(model.prior - 0.85) < 0.02


def test_patterns_round_trip():
    v = np.random.default_rng(1).integers(-1, 2, (50, len(Q.LABELLERS)))
    assert (Q.votes_from(Q.pattern_of(v)) == v).all()


def test_measures_of_plain_texts():
    import pyarrow as pa
    texts = ["The cat sat. The dog ran!", "AB!! CD!! ef", "", "a a a b", "x### | y"]
    (view,) = list(Q._views(pa.array(texts), Q._stop_hashes()))
    m = view[-1]
    assert list(m[:, -1]) == [6, 3, 0, 4, 3]
    col = {name: m[:, k] for k, name in enumerate(Q.LABELLERS)}
    assert col["capitals"][1] == 4 / 6 and col["shouts"][1] == 2 / 3 and col["odd_words"][1] == 2 / 3
    assert col["repeats"][3] == 2 / 4 and col["triples"][3] == 1 / 4
    assert col["symbols"][4] == 3 / 6 and col["bars"][4] == 1 / 3 and col["lone_marks"][4] == 1 / 3
    assert len(view[3]) == len(view[2]) == 16


def test_edges(spark, docs_of):
    good = "The river and the town lie in the valley, and it is known for the mill. It was built by the old road. "
    bad = "BUY!! NOW!! ### $$$ | | %%% WIN!! "
    long = (good * 3000).strip()
    rows = [(i, good * (2 + i % 5) + f"It is the story of number{i}.") for i in range(60)] + [(100 + i, bad * (3 + i % 4)) for i in range(25)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (205, "The old town."), (203, long), (None, good * 3), (204, good * 3), (204, good * 3)]
    df = docs_of(rows)
    out = Q.classify(df)
    assert set(df.columns) < set(out.columns)
    got = [(r["doc_id"], r["keep"], r["score"]) for r in out.collect()]
    assert len(got) == len(rows)
    keep = {d: k for d, k, _ in got}
    assert all(keep[i] for i in range(60)) and not any(keep[100 + i] for i in range(25))
    assert not keep[200] and not keep[201] and not keep[202] and keep[203] and keep[None] and keep[204] and keep[205]
    again = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in Q.classify(df.repartition(7)).collect())
    assert again == sorted((str(d), round(s, 9)) for d, _, s in got)
    assert Q.classify(docs_of([])).count() == 0
