"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import xxhash


def norm(text):
    return " ".join(re.sub(r"[\W_]+", " ", (text or "").lower()).split())


class Groups:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def draw(seed, salt, *ids):
    key = "|".join([str(seed), salt, *("" if i is None else str(i) for i in ids)])
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52


# ---- n-gram Jaccard ---------------------------------------------------------------------

def grams(text, n=5):
    w = norm(text).split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_rows(rows, threshold=0.8):
    """(doc_id, class_id, copy_of, copies, n_links) of every (doc_id, text), from all pairs
    that share an n-gram."""
    keys = [norm(t) for _, t in rows]
    texts = sorted(set(keys))
    sets = [grams(t) for t in texts]
    groups, links, where = Groups(len(texts)), [0] * len(texts), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j > i:
                    shared[j] += 1
        for j, c in shared.items():
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                groups.join(j, i)
    ids, members = defaultdict(list), defaultdict(list)
    for (d, _), t in zip(rows, keys):
        ids[t].append(d)
    low = lambda xs: min((x for x in xs if x is not None), default=None)
    for k, t in enumerate(texts):
        members[groups.find(k)] += ids[t]
    at = {t: k for k, t in enumerate(texts)}
    return sorted(((d, low(members[groups.find(at[t])]), low(ids[t]), len(ids[t]), links[at[t]]) for (d, _), t in zip(rows, keys)), key=str)


# ---- lines ------------------------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xx(text):
    return xxhash.xxh64(text.encode(), seed=42).intdigest()


def simhash(line):
    hashes = [xx(w) for w in norm(line).split()]
    out = 0
    for i in range(64):
        c = 2 * sum(h >> i & 1 for h in hashes)
        out |= (c > len(hashes) or (c == len(hashes) and i % 2 == 1)) << i
    return out


def edits(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def line_marks(rows, bits=3, similarity=0.8):
    """{(doc_id, text): [kept, ...] per line} and {line: group} by comparing all lines.  With
    ``bits`` the SimHashes of a pair may differ in so many and half of the words are shared;
    with None the edit similarity alone decides."""
    home = {}
    for d, t in rows:
        t = t or ""
        for i, line in enumerate(t.split("\n")):
            n = norm(line)
            if n:
                at = (d is not None, d if d is not None else 0, signed(xx(t)), i)
                home[n] = min(home.get(n, at), at)
    texts = sorted(home)
    groups = Groups(len(texts))
    size = np.array([len(t) for t in texts])
    letters = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 32, minlength=32) for t in texts]).reshape(len(texts), 32)
    pairs = np.array([np.bincount((c[:-1] * 31 + c[1:]) % 127, minlength=127) for t in texts for c in [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)]]).reshape(len(texts), 127)
    hashes = np.array([simhash(t) if bits is not None else 0 for t in texts], np.uint64)
    left = []
    for i in range(len(texts)):
        longer = np.maximum(size[i + 1:], size[i])
        most = (1 - similarity) * longer + 1e-9
        d = letters[i + 1:] - letters[i]  # an edit changes one letter on a side at most
        near = (np.abs(size[i + 1:] - size[i]) <= most) & (np.maximum(d.clip(0).sum(1), (-d).clip(0).sum(1)) <= most)
        d = pairs[i + 1:] - pairs[i]  # and two pairs of letters
        near &= np.maximum(d.clip(0).sum(1), (-d).clip(0).sum(1)) <= 2 * most
        if bits is None:
            left += [(i, int(j)) for j in np.flatnonzero(near) + i + 1]
            continue
        near &= np.bitwise_count(hashes[i + 1:] ^ hashes[i]) <= bits
        for j in np.flatnonzero(near) + i + 1:
            a, b = texts[i], texts[j]
            wa, wb = set(a.split()), set(b.split())
            if 2 * len(wa & wb) < max(len(wa), len(wb)):
                continue
            if edits(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
                groups.join(i, int(j))
    if left:
        import duckdb
        con = duckdb.connect()
        con.execute("CREATE TABLE t AS SELECT unnest(?) AS i, unnest(?) AS j, unnest(?) AS x, unnest(?) AS y",
                    [*map(list, zip(*left)), [texts[i] for i, _ in left], [texts[j] for _, j in left]])
        for i, j in con.sql(f"SELECT i, j FROM t WHERE levenshtein(x, y) <= {1 - similarity} * greatest(length(x), length(y)) + 1e-9").fetchall():
            groups.join(i, j)
    at = {t: groups.find(k) for k, t in enumerate(texts)}
    first = {}
    for t in texts:
        first[at[t]] = min(first.get(at[t], home[t]), home[t])
    marks = {}
    for d, t in rows:
        flags = []
        for i, line in enumerate((t or "").split("\n")):
            n = norm(line)
            flags.append(not n or first[at[n]] == (d is not None, d if d is not None else 0, signed(xx(t or "")), i))
        marks[d, t] = flags
    return marks, at


def dedup_text(text, flags):
    return text if all(flags) else "\n".join(x for x, k in zip(text.split("\n"), flags) if k)


# ---- mixing -----------------------------------------------------------------------------

def poisson_count(rate, u):
    """Smallest k whose distribution function exceeds u."""
    if rate <= 0:
        return 0
    k, total = 0, 0.0
    while k <= rate + 12 * math.sqrt(rate) + 40:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if u < total:
            return k
        k += 1
    return k


def mixing_rates(rows, epochs=1.0, temperature=0.5):
    size = defaultdict(float)
    for _, t, s in rows:
        size[s] += len((t or "").encode())
    weight = {s: n ** temperature if n else 0.0 for s, n in size.items()}
    total, w = sum(size.values()), sum(weight.values())
    return {s: weight[s] / w * total * epochs / n if n else 0.0 for s, n in size.items()}


# ---- packing ----------------------------------------------------------------------------

def least_padding(lengths, counts, buckets):
    """The least padded size over all choices of bounds."""
    import itertools
    hist = dict(zip(lengths, counts))
    values, best = sorted(hist), None
    for k in range(1, min(buckets, len(values)) + 1):
        for cut in itertools.combinations(values[:-1], k - 1):
            bounds = [*cut, values[-1]]
            cost = sum(n * min(b for b in bounds if b >= x) for x, n in hist.items())
            best = cost if best is None else min(best, cost)
    return best
