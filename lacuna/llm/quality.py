"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. Labellers look at whole texts and vote -1 (poor), +1 (good) or 0 (abstain).  All
   documents are counted by their pattern of votes; there are at most 3 ** labellers
   patterns, however many documents.
2. Expectation-maximisation over those counts, so over every document, estimates the share
   of good documents and how each labeller votes on good ones and on each kind of poor
   ones.  It gives every pattern a posterior; no label is used.
3. A logistic scorer on hashed features (words, word shapes, repeats) is fitted to the
   posteriors of a bounded sample: ``SAMPLE`` documents, chosen by the hash of their ids
   (the only bounded step; it may hold fewer, and all of a smaller corpus).
4. Every document gets the scorer's probability over its whole text, and is kept from
   ``KEEP`` on.

A null text is an empty one; a text without words scores 0 and is rejected.  Equal texts
get equal scores; rows that repeat an id keep a row each; a null id is an id like others.  An
empty table gives an empty result (and no model).  Where the labellers never disagree with
"good" (or "poor"), the scorer learns that all documents are good (poor).  Other columns
pass through :func:`classify` untouched; names beginning with two underscores are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, draw, table
from .shingles import buffers, mix64, words

SAMPLE = 8_000
KEEP = 0.5
BUCKETS = 1 << 18
SEED = 17
ROUNDS = 200

# Frequent function words of four languages.
STOP_WORDS = """the of and to in is it that for was with as be this are on by not or have from at an
der die das und ist in den von zu mit sich auf für nicht ein eine auch als es an werden im dem
le la les de des et un une du en que est pour qui dans par sur pas au il elle avec sont
el los las una y que en del se por con para es su lo como más al o""".split()

#: Heuristics that overlap: every kind of junk is seen by two or more of them.
LABELLERS = ("symbols", "odd_words", "capitals", "shouts", "stop_words", "bars", "lone_marks", "repeats", "triples", "sentences", "word_length")
#: Belief before any document is seen: a labeller calls this share of good documents poor,
#: and the belief weighs as much as this share of the corpus.
FALSE_ALARMS, BELIEF = 0.005, 0.05
#: A hidden kind is poor where this many labellers say so on average: one alone may be wrong.
AGREE = 1.5
#: Texts with fewer words tell too little: all labellers abstain.
LEAST_WORDS = 20
#: The scorer adds to every text this many words that say what the prior says.
PRIOR_WORDS = 5


# ---- views of a batch -------------------------------------------------------------------

def _classes() -> np.ndarray:
    """Byte -> 0 other letter, 1 capital, 2 digit, 3 sentence end, 4 other usual mark,
    5 symbol, 6 bar, 7 exclamation mark, 8 space."""
    c = np.full(256, 5, np.uint8)
    c[ord("a"):ord("z") + 1] = 0
    c[128:] = 0
    c[ord("A"):ord("Z") + 1] = 1
    c[ord("0"):ord("9") + 1] = 2
    for marks, k in ((".?", 3), (",;:'\"()-/", 4), ("|", 6), ("!", 7), (" \t\n\r", 8)):
        for m in marks:
            c[ord(m)] = k
    return c


_CLASS = _classes()


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _stop_hashes() -> np.ndarray:
    import pyarrow as pa
    _, _, h, _ = next(words(pa.array([" ".join(STOP_WORDS)])))
    return np.unique(h)


def _views(column, stop):
    """Yields (first text, one past the last, word hashes, shape hashes, repeats, word bounds,
    measures) for ranges of texts whose words are separated by single spaces."""
    offsets, data = buffers(column)
    for i, j, hashes, bounds in words(column):
        lo, hi = int(offsets[i]), int(offsets[j])
        kind = _CLASS[data[lo:hi]]
        at = offsets[i:j + 1] - lo
        n = np.maximum(np.diff(bounds), 1).astype(np.float64)
        space = kind == 8
        begins = np.zeros(len(kind) + 1, bool)
        begins[at] = True
        begins = begins[:-1]
        if len(kind) > 1:
            begins[1:] |= space[:-1]
        word = np.cumsum(begins & ~space) - 1  # the word that a byte belongs to
        marks = np.maximum(_sums(~space, at), 1)
        letters = np.maximum(_sums(kind <= 1, at), 1)
        twice = np.zeros(len(kind), bool)
        if len(kind) > 1:
            twice[1:] = (kind[1:] == 7) & (kind[:-1] == 7) & ~begins[1:]
        odd, plain = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        odd[word[(kind == 5) | (kind == 6) | twice]] = True
        plain[word[kind <= 2]] = True
        repeat, triple = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        repeat[1:] = hashes[1:] == hashes[:-1]
        repeat[bounds[:-1][bounds[:-1] < len(hashes)]] = False  # a text's first word
        triple[1:] = repeat[1:] & repeat[:-1]
        m = np.stack([_sums(kind == 5, at) / marks, _sums(odd, bounds) / n, _sums(kind == 1, at) / letters, _sums(twice, at) / n,
                      _sums(np.isin(hashes, stop), bounds) / n, _sums(kind == 6, at) / n, _sums(~plain, bounds) / n,
                      _sums(repeat, bounds) / n, _sums(triple, bounds) / n, _sums((kind == 3) | (kind == 7), at) / n,
                      marks / n, np.diff(bounds).astype(np.float64)], axis=1)
        yield i, j, hashes, _shapes(kind, begins, space, word), repeat, bounds, m


def _shapes(kind: np.ndarray, begins: np.ndarray, space: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of every word's runs of character classes ("Word!!" is capital, letters, shout)."""
    new = begins.copy()
    new[1:] |= kind[1:] != kind[:-1]
    keep = new & ~space
    run_word = word[keep]
    if not len(run_word):
        return np.zeros(0, np.uint64)
    # a word's first eight runs, as digits of one number
    first = np.concatenate([[0], np.flatnonzero(np.diff(run_word)) + 1])
    nth = np.arange(len(run_word)) - np.repeat(first, np.diff(np.concatenate([first, [len(run_word)]])))
    digit = np.where(nth < 8, (kind[keep].astype(np.uint64) + np.uint64(1)) << (np.minimum(nth, 7).astype(np.uint64) * np.uint64(5)), np.uint64(0))
    return mix64(np.add.reduceat(digit, first) ^ np.uint64(0x5A5A0000000000))


def votes_of(m: np.ndarray) -> np.ndarray:
    """Votes of the labellers (columns as in LABELLERS) from the measures."""
    symbols, odd, capitals, shouts, stop, bars, lone, repeats, triples, ends, width, count = m.T
    v = np.zeros((len(m), len(LABELLERS)), np.int8)
    # poor, good; neither: abstain
    rules = ((symbols > 0.08, symbols < 0.02), (odd > 0.25, odd < 0.05), (capitals > 0.5, capitals < 0.2), (shouts > 0.2, shouts < 0.01),
             (stop < 0.02, stop > 0.1), (bars > 0.1, bars < 0.01), (lone > 0.15, lone < 0.02), (repeats > 0.2, repeats < 0.03),
             (triples > 0.1, triples < 0.01), ((ends > 0.6) | (ends < 0.002), (ends > 0.02) & (ends < 0.35)),
             ((width > 15) | (width < 2), (width > 3) & (width < 10)))
    for k, (poor, good) in enumerate(rules):
        v[:, k] = np.where(count < LEAST_WORDS, 0, np.where(poor, -1, np.where(good, 1, 0)))
    return v


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """Votes as one number, base 3."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def votes_from(pattern: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return np.asarray(pattern)[:, None] // (3 ** np.arange(n, dtype=np.int64)) % 3 - 1


# ---- label model ------------------------------------------------------------------------

@dataclass
class LabelModel:
    """A mixture of hidden kinds of documents, the first of them good: share of each kind,
    and per kind and labeller the chances of the votes -1, 0, 1."""
    shares: np.ndarray  # [kinds]
    table: np.ndarray  # [kinds, labellers, 3]

    @property
    def poor(self) -> np.ndarray:
        """The kinds that labellers agree on."""
        return (np.arange(len(self.shares)) > 0) & (self.table[:, :, 0].sum(axis=1) >= AGREE)

    @property
    def prior(self) -> float:
        return float(self.shares[~self.poor].sum())

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """P(kind | votes) of every row of votes."""
        which = np.arange(votes.shape[1])
        x = np.log(self.table)[:, which, votes + 1].sum(axis=2).T + np.log(self.shares)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        return self.kinds(votes)[:, ~self.poor].sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """P(right | votes) of each labeller."""
        side = np.where(self.poor, 0, 2)
        each = np.arange(len(self.shares))
        right, wrong = (self.shares @ self.table[each, :, v] for v in (side, 2 - side))
        return right / (right + wrong)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, kinds: int | None = None, belief: float = BELIEF,
                    rounds: int = ROUNDS) -> LabelModel:
    """EM over vote patterns and their counts.

    Junk comes in kinds that only some labellers know, so "poor" is a mixture: one kind
    starts from each labeller (or ``kinds`` = 1: a single one from all).  The belief about
    false alarms, which weighs alike at any size, keeps junk from being explained as the
    noise of labellers on good documents; a document more in every cell keeps all chances
    above 0."""
    n = votes.shape[1]
    total = counts.sum()
    says = np.stack([votes == v for v in (-1, 0, 1)], axis=2).reshape(len(votes), 3 * n).astype(np.float64)
    start = np.full((1 + (kinds or n), n, 3), (0.2, 0.3, 0.5))
    start[0] = (0.02, 0.28, 0.7)
    if kinds == 1:
        start[1] = (0.6, 0.2, 0.2)
    else:
        for k in range(len(start) - 1):
            start[k + 1, k % n] = (0.8, 0.1, 0.1)
    model = LabelModel(np.array([0.7, *[0.3 / (len(start) - 1)] * (len(start) - 1)]), start)
    for _ in range(rounds):
        weight = model.kinds(votes) * counts[:, None]
        shares = (weight.sum(axis=0) + 1) / (total + len(start))
        cells = (weight.T @ says).reshape(len(start), n, 3) + 1
        good = cells[0]
        alarm = (good[:, :1] + belief * total * FALSE_ALARMS) / (good.sum(axis=1, keepdims=True) + belief * total)
        cells = cells / cells.sum(axis=2, keepdims=True)
        cells[0] = np.concatenate([alarm, good[:, 1:] / good[:, 1:].sum(axis=1, keepdims=True) * (1 - alarm)], axis=1)
        done = max(np.abs(shares - model.shares).max(), np.abs(cells - model.table).max()) < 1e-7
        model = LabelModel(shares, cells)
        if done:
            break
    return model


# ---- hashed scorer ----------------------------------------------------------------------

def _features(hashes, shapes, repeat) -> np.ndarray:
    """Feature indices of all words: three a word (the word, its shape, shape and repeat)."""
    mask = np.uint64(BUCKETS - 1)
    said = np.where(repeat, np.uint64(0x7E9EA7), np.uint64(0x0)) + np.uint64(0x1234567)
    return np.stack([hashes & mask, shapes & mask, mix64(said) & mask], axis=1).astype(np.int32)


def _logit(p: float) -> float:
    p = min(max(p, 0.05), 0.95)
    return float(np.log(p / (1 - p)))


def fit_scorer(index: np.ndarray, value: np.ndarray, lengths: np.ndarray, target: np.ndarray, prior: float,
               steps: int = 150, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the intercept) from rows of features and values, row i
    the next ``lengths[i]`` of both, by full-batch gradient steps with per-weight scaling;
    deterministic.  A row's values add up to three times its weight of evidence, and the rest
    of 1 is the prior's."""
    n = len(lengths)
    value = value.astype(np.float64)
    owner = np.repeat(np.arange(n), lengths)
    sure = np.bincount(owner, value, n) / 3
    rest = (1 - sure) * _logit(prior)
    used, index = np.unique(index, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    scale, scale_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, value * w[index], n) + b * sure + rest
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        slope = (err * sure).mean()
        g = np.bincount(index, value * err[owner], len(used)) / n + shrink * w
        scale += g * g
        scale_b += slope ** 2
        w -= rate * g / np.sqrt(scale)
        b -= rate * slope / np.sqrt(scale_b)
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w, b
    return out


# ---- the operator -----------------------------------------------------------------------

def _spaced(text: str = "text"):
    """White space made single spaces, nothing else changed: the words as they are written."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n over all documents."""
    stop = _stop_hashes()

    def count(batches):
        import pyarrow as pa
        seen = {}
        for batch in batches:
            for *_, m in _views(batch.column("__t"), stop):
                for p, n in zip(*np.unique(pattern_of(votes_of(m)), return_counts=True)):
                    seen[int(p)] = seen.get(int(p), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return (docs.select(_spaced(text).alias("__t")).mapInArrow(count, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")))


def sample_rows(docs: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """order (a hash of the document), pattern, features and values of the documents whose
    id hashes below ``share``."""
    stop = _stop_hashes()

    def rows(batches):
        import pyarrow as pa
        for batch in batches:
            pattern, feats, values = [], [], []
            if not batch.num_rows:
                continue
            for i, j, hashes, shapes, repeat, bounds, m in _views(batch.column("__t"), stop):
                f = _features(hashes, shapes, repeat)
                pattern.append(pattern_of(votes_of(m)))
                for a, b in zip(bounds[:-1], bounds[1:]):
                    u, c = np.unique(f[a:b], return_counts=True)
                    feats.append(u)
                    values.append((c / (b - a + PRIOR_WORDS)).astype(np.float32))
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in feats])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("order"), pa.array(np.concatenate(pattern)), pa.ListArray.from_arrays(at, pa.array(np.concatenate(feats))),
                pa.ListArray.from_arrays(at, pa.array(np.concatenate(values)))], ["order", "pattern", "features", "weights"])

    return (docs.where(draw(seed, "sample", doc_id) < share)
            .select(F.xxhash64(F.col(doc_id), F.col(text)).alias("order"), _spaced(text).alias("__t"))
            .mapInArrow(rows, "order long, pattern long, features array<int>, weights array<float>"))


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray

    def score(self, docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
        """The columns to carry (all by default) with p_label (label model) and score (scorer)
        of every row."""
        stop, labels, weights, prior = _stop_hashes(), self.labels, self.weights.astype(np.float32), _logit(self.labels.prior)

        def run(batches):
            import pyarrow as pa
            for batch in batches:
                p, s = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for i, j, hashes, shapes, repeat, bounds, m in _views(batch.column("__t"), stop):
                    p[i:j] = labels.posterior(votes_of(m))
                    n = np.diff(bounds)
                    per_word = weights[_features(hashes, shapes, repeat)].sum(axis=1, dtype=np.float64)
                    total = np.concatenate([[0.0], np.cumsum(per_word)])
                    z = (total[bounds[1:]] - total[bounds[:-1]] + n * weights[-1] + PRIOR_WORDS * prior) / (n + PRIOR_WORDS)
                    s[i:j] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)
                cols = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "__t"]
                names = [n for n in batch.schema.names if n != "__t"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array(s)], [*names, "p_label", "score"])

        passed = docs.select(*[c for c in (carry or docs.columns) if c not in ("p_label", "score")], F.col(text).alias("__t"))
        kept = passed.drop("__t")
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "p_label double", "score double"])
        return passed.withColumn("__t", _spaced("__t")).mapInArrow(run, schema)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = SEED) -> Classifier | None:
    """Label model over all documents, scorer on a sample of at most about ``sample``."""
    seen = vote_counts(docs, text).collect()  # at most 3 ** len(LABELLERS) patterns
    if not seen:
        return None
    votes, counts = votes_from(np.array([r["pattern"] for r in seen])), np.array([r["n"] for r in seen], np.float64)
    labels = fit_label_model(votes, counts)
    # at most 2 * sample rows, as Arrow arrays; the exchange after the limit makes it one pass
    take = lambda share: sample_rows(docs, share, doc_id, text, seed).limit(2 * sample).repartition(1).toArrow()
    rows = take(sample / counts.sum())
    if not rows.num_rows:  # so small a corpus that no id was drawn: take it whole
        rows = take(2.0)
    rows = rows.sort_by("order").combine_chunks()  # independent of the partitioning
    target = labels.posterior(votes_from(rows["pattern"].to_numpy()))
    features, values = (rows[c].chunk(0) for c in ("features", "weights"))
    weights = fit_scorer(features.flatten().to_numpy(), values.flatten().to_numpy(), features.value_lengths().to_numpy(), target, labels.prior)
    return Classifier(labels, weights)


def classify(docs: DataFrame, keep: float = KEEP, carry: list[str] | None = None, **how) -> DataFrame:
    """The columns to carry (all by default) with p_label, score and keep."""
    bound_batches(docs.sparkSession)
    model = fit(docs, **how)
    if model is None:
        out = docs.select(*(carry or docs.columns)).drop("p_label", "score")
        return out.withColumns({"p_label": F.lit(0.0), "score": F.lit(0.0), "keep": F.lit(False)})
    return model.score(docs, how.get("text", "text"), carry).withColumn("keep", F.col("score") >= keep)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES = {"op1_quality": op1_quality}
ORACLE = {}
