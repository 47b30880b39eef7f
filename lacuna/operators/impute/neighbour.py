"""Neighbour operators (I15, I26, L15, L21-L24, L30): exact k-nearest neighbours.

Plan for rows of a few columns (``metric="nan_euclidean"``): donors are dealt into cells of
neighbouring rows, one set of cells for every combination of coordinates that some query
holds, over those coordinates alone.  A query meets the cell it lies in, which gives a k-th
distance, and then only the other cells whose bounds are not farther; the k best of all the
cells it met are exact.  Of donors that agree in all coordinates of a combination only the k
smallest ids can ever be chosen, so no more are dealt.  A sample chooses where the cells are
cut, which decides no result; their bounds are taken over all donors.  Queries of a full cell
are dealt on to several tasks, each with a copy of the cell, so donors and queries are copied
a number of times that does not grow with the tables.

Plan for vectors (``metric="euclidean"``, and the repair spaces): queries and donors are dealt
into blocks by the hash of their ids, and every block of queries meets every block of donors
in a task of its own (``cogroup`` on both block numbers), which returns the k best donors per
query of the block.  Memory is one pair of blocks; a side is copied once per block of the
other side.

In both nothing is collected (but the sample, and the bounds and sizes of cells), broadcast or
refused, whatever the sizes.  Inside a task, boxes of donors that lie farther from a box of
queries than its k-th best donor are skipped.  Ordering ties break on the donor id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...session import drop_path, write_barrier
from .cells import Cells, scale

DONOR_BLOCK = 16_384  # rows of a donor block
QUERY_BLOCK = 8_192  # rows of a query block
DONOR_BOX, QUERY_BOX = 128, 32  # rows of the boxes that are compared or skipped as a whole
AT_ONCE = 512  # queries whose distances to a block are held at once
DONOR_CELL = 8_192  # rows of a cell of donors, about


def _meet(queries: DataFrame, donors: DataFrame, qid: str, did: str):
    """Both sides grouped by (query block, donor block), for ``cogroup``."""
    nq = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    nd = max(1, math.ceil(donors.count() / DONOR_BLOCK))

    def block(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    q = queries.withColumns({"__qb": block(qid, nq), "__db": F.explode(F.sequence(F.lit(0), F.lit(nd - 1)))})
    d = donors.withColumns({"__qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1))), "__db": block(did, nd)})
    return q.groupBy("__qb", "__db").cogroup(d.groupBy("__qb", "__db"))


def _encode_rows(pdf: pd.DataFrame, num_cols, cat_cols):
    num = pdf[num_cols].to_numpy(dtype=float) if num_cols else np.zeros((len(pdf), 0))
    cat = pdf[cat_cols].to_numpy(dtype=float) if cat_cols else np.zeros((len(pdf), 0))
    return num, cat


def _pair_dist(qn, qc, dn, dc, total_dims, cat_width):
    """nan-euclidean distance (queries may miss coordinates, donors are complete).
    Numeric coordinates add (dq - dd)^2; a categorical column with w one-hot
    coordinates adds 2 when the categories differ; the sum is scaled by
    total / present coordinates.  Terms are added in column order (the SQL twin
    adds them in the same order)."""
    d2 = np.zeros((qn.shape[0], dn.shape[0]))
    present = np.zeros(qn.shape[0])
    for j in range(qn.shape[1]):
        ok = ~np.isnan(qn[:, j])
        diff = np.subtract.outer(np.where(ok, qn[:, j], 0.0), dn[:, j])
        diff *= diff
        diff[~ok] = 0.0
        d2 += diff
        present += ok
    for j in range(qc.shape[1]):
        ok = ~np.isnan(qc[:, j])
        neq = np.not_equal.outer(qc[:, j], dc[:, j])
        neq[~ok] = False
        d2 += neq * 2.0
        present += ok * cat_width[j]
    # no common coordinate: infinitely far from every donor (ties then break on the donor id)
    return np.where((present > 0)[:, None], np.sqrt(d2 * scale(total_dims, np.maximum(present, 1))[:, None]), np.inf)


def _euclid(qm, dm, budget: float = 2e7):
    """Exact pairwise Euclidean distances from coordinate differences (no Gram
    shortcut: its cancellation error would reorder near ties), in blocks."""
    out = np.empty((qm.shape[0], dm.shape[0]))
    step = max(1, int(budget // max(1, dm.shape[0] * max(1, qm.shape[1]))))
    for lo in range(0, qm.shape[0], step):
        diff = qm[lo:lo + step, None, :] - dm[None, :, :]
        out[lo:lo + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def _pair_euclid(qm, dm, i, j, budget: int = 2_000_000):
    """:func:`_euclid` of the pairs (row i of ``qm``, row j of ``dm``) alone."""
    out, step = np.empty(len(i)), max(1, budget // max(1, qm.shape[1]))
    for lo in range(0, len(i), step):
        diff = qm[i[lo:lo + step]] - dm[j[lo:lo + step]]
        out[lo:lo + step] = np.sqrt((diff * diff).sum(axis=1))
    return out


def _squares(qm, dm):
    """Squared distances by a matrix product, and twice how far those of a query may lie from
    exact ones (1 / (1 + distance) included, which rounds near distances to one value): who is
    farther by more than that is farther.  Vectors that are not finite rule nothing out."""
    q2, d2 = (qm * qm).sum(axis=1), (dm * dm).sum(axis=1)
    slack = 8 * (qm.shape[1] + 8) * np.finfo(float).eps * (1 + np.sqrt(q2) + np.sqrt(d2.max())) ** 2
    if not np.isfinite(slack).all():
        return np.zeros((len(qm), len(dm))), np.full((len(qm), 1), np.inf)
    squares = qm @ dm.T
    squares *= -2
    squares += q2[:, None]
    squares += d2
    return squares, slack[:, None]


def _kth(x, k):
    """The k-th smallest of each row (the last, if it has fewer)."""
    k = min(k, x.shape[1])
    return np.partition(x, k - 1, axis=1)[:, k - 1:k]


def vector_topk(qm, dm, ids, k):
    """``_best`` of all pairs of vectors; exact distances of those only that a matrix product
    leaves among the k nearest."""
    squares, slack = _squares(qm, dm)
    i, j = np.nonzero(squares <= _kth(squares, k) + slack)
    some, at = np.unique(j, return_inverse=True)
    d = np.full((len(qm), len(some)), np.inf)
    d[i, at] = _pair_euclid(qm, dm, i, j)
    return _best(d, ids[some], k)


def repair_extremes(qm, dm, start, i, j):
    """The least and the greatest similarity of query i to the repairs of row j (which begin at
    ``start[j]`` in ``dm``), and the similarities of all those pairs with the first of each."""
    sizes = np.diff(np.append(start, len(dm)))[j]
    first = np.cumsum(sizes) - sizes
    rows = np.arange(sizes.sum()) - np.repeat(first - start[j], sizes)
    sim = 1.0 / (1.0 + _pair_euclid(qm, dm, np.repeat(i, sizes), rows))
    return np.minimum.reduceat(sim, first), np.maximum.reduceat(sim, first), sim, first


def _best(d: np.ndarray, ids: np.ndarray, k: int):
    """The k smallest distances per row with their ids, ordered by (distance, id)."""
    k = min(k, d.shape[1])
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    bd, bi = np.take_along_axis(d, part, axis=1), ids[part]
    edge = bd.max(axis=1)
    for q in np.nonzero((d <= edge[:, None]).sum(axis=1) > k)[0]:  # ties at the k-th distance: the id decides
        some = np.nonzero(d[q] <= edge[q])[0]
        o = some[np.lexsort((ids[some], d[q][some]))[:k]]
        bd[q], bi[q] = d[q][o], ids[o]
    o = np.lexsort((bi, bd), axis=-1)
    return np.take_along_axis(bd, o, axis=1), np.take_along_axis(bi, o, axis=1)


def knn_topk(queries: DataFrame, donors: DataFrame, k: int, qid: str, did: str, num_cols, cat_cols=(),
             cat_width=None, metric: str = "nan_euclidean", carry=(), scaled: bool = True, apart: str | None = None) -> DataFrame:
    """(qid, did, dist, rank) for the k nearest donors of each query, and the donors'
    columns ``carry``.

    ``num_cols``: numeric coordinates (already scaled); ``cat_cols``: integer codes
    of categorical columns whose one-hot width is ``cat_width``.  Without ``scaled``
    distances are not scaled up for coordinates that a query misses; a query meets no donor
    of its own value in the column ``apart`` (folds: a few values, never null).  For metric
    'euclidean' ``num_cols`` may name one array column (vectors)."""
    num_cols, cat_cols, carry = list(num_cols), list(cat_cols), list(carry)
    cat_width = list(cat_width or [1] * len(cat_cols))
    if metric == "euclidean":
        out = _vector_topk(queries, donors, k, qid, did, num_cols[0])
    else:
        out = _cell_topk(queries, donors, k, qid, did, num_cols, cat_cols, cat_width, carry, scaled, apart)
    return out.withColumnRenamed("qid", qid if qid != did else "qid").withColumnRenamed("did", did if qid != did else "did")


def _vector_topk(queries: DataFrame, donors: DataFrame, k: int, qid: str, did: str, vec: str) -> DataFrame:
    def vectors(pdf):
        return np.stack(pdf[vec].apply(lambda a: np.asarray(a, dtype=float)).to_numpy())

    def nearest(q, d):
        out = []
        if len(q) and len(d):
            ids, dids, qm, dm = q[qid].to_numpy(), d[did].to_numpy(), vectors(q), vectors(d)
            for lo in range(0, len(q), AT_ONCE):
                bd, bi = vector_topk(qm[lo:lo + AT_ONCE], dm, dids, k)
                out.append(pd.DataFrame({"qid": np.repeat(ids[lo:lo + AT_ONCE], bd.shape[1]), "did": bi.reshape(-1),
                                         "dist": bd.reshape(-1)}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "did": [], "dist": []}).astype(
            {"qid": q[qid].dtype, "did": d[did].dtype, "dist": "float64"})

    schema = f"qid {dict(queries.dtypes)[qid]}, did {dict(donors.dtypes)[did]}, dist double"
    part = _meet(queries.select(qid, vec), donors.select(did, vec), qid, did).applyInPandas(nearest, schema)
    w = Window.partitionBy("qid").orderBy("dist", "did")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cell_topk(queries, donors, k, qid, did, num_cols, cat_cols, cat_width, carry, scaled=True, apart=None) -> DataFrame:
    """The plan of cells; every query id must be of one row.  A set of cells belongs to a
    combination of coordinates (the low bits of ``__held``) and a value of ``apart``."""
    spark, coords = queries.sparkSession, num_cols + cat_cols
    total_dims, n_num = float(len(num_cols) + sum(cat_width)) if scaled else None, len(num_cols)
    qtype, dtype = dict(queries.dtypes)[qid], dict(donors.dtypes)[did]
    held = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords]
    mask = sum((F.when(h, 1 << i).otherwise(0) for i, h in enumerate(held)), F.lit(0)).cast("int")
    kept_apart = F.lit(0)
    if apart:
        values = sorted(r[0] for r in queries.select(apart).distinct().collect())  # one row per fold
        kept_apart = F.coalesce(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])[F.col(apart)], F.lit(-1))
        mask = mask + F.shiftleft(kept_apart, len(coords))
    q, q_path = write_barrier(queries.select(F.col(qid).alias("__qid"), mask.alias("__held"), *[
        F.when(h, F.col(c).cast("double")).alias(f"__x{i}") for i, (c, h) in enumerate(zip(coords, held))]), "queries")
    xs = [f"__x{i}" for i in range(len(coords))]
    holds = sorted(r[0] for r in q.select("__held").distinct().collect())  # at most one per set of coordinates
    d = donors.select(F.col(did).alias("__did"), *[F.col(c).cast("double").alias(x) for c, x in zip(coords, xs)],
                      *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], kept_apart.alias("__apart"))
    d = d.withColumn("__held", F.explode(F.array(*[F.lit(h) for h in holds]).cast("array<int>")))
    if apart:
        d = d.where(F.shiftright("__held", len(coords)) != F.col("__apart"))
    d = d.drop("__apart")
    # donors that lack a coordinate of the combination are at no distance
    for i, x in enumerate(xs):
        d = d.where((F.col("__held").bitwiseAND(F.lit(1 << i)) == 0) | (F.col(x).isNotNull() & ~F.isnan(x)))
    d = d.withColumns({x: F.when(F.col("__held").bitwiseAND(F.lit(1 << i)) != 0, F.col(x)) for i, x in enumerate(xs)})
    alike = Window.partitionBy("__held", *xs).orderBy("__did")
    d, d_path = write_barrier(d.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= k).drop("__r"), "donors")

    cells = Cells.cut(d, holds, xs, n_num, cat_width, total_dims, DONOR_CELL)
    d = cells.deal(d)
    cells.bound(d)
    q = cells.deal(q)

    cs = [f"__c{i}" for i in range(len(carry))]
    lists = [f"dist array<double>, did array<{dtype}>"] + [f"{c} array<{dict(d.dtypes)[c]}>" for c in cs]
    schema = f"__qid {qtype}, __held int, {', '.join(f'{x} double' for x in xs)}, {', '.join(lists)}"

    def nearest(further):
        names = ["__qid", "__held", *xs, "dist", "did", *cs] + (["more"] if further else [])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("__did")  # positions in the order of ids
            if not right.num_rows:
                left = left.slice(0, 0)
            dx, qx = _columns(right, xs), _columns(left, xs)
            bd, bi, _ = boxed_topk(qx[:, :n_num], qx[:, n_num:], dx[:, :n_num], dx[:, n_num:], np.arange(len(dx)), k, total_dims, cat_width)
            ends = pa.array(np.arange(0, bd.size + 1, bd.shape[1], dtype=np.int32) if bd.size else np.zeros(len(bd) + 1, np.int32))
            at = pa.array(bi.reshape(-1))
            out = [left.column(c).combine_chunks() for c in names[:2 + len(xs)]]
            out += [pa.ListArray.from_arrays(ends, pa.array(bd.reshape(-1)))]
            out += [pa.ListArray.from_arrays(ends, right.column(c).combine_chunks().take(at)) for c in ("__did", *cs)]
            if further:
                kth = bd[:, k - 1] if bd.shape[1] == k else np.full(len(bd), np.inf)
                who, where = cells.not_farther(qx, kth, left.column("__held")[0].as_py(), left.column("__cell")[0].as_py()) if len(qx) else (np.zeros(0, int),) * 2
                ends = pa.array(np.searchsorted(who, np.arange(len(qx) + 1)).astype(np.int32))
                out.append(pa.ListArray.from_arrays(ends, pa.array(where.astype(np.int32))))
            return pa.Table.from_arrays(out, names=names)

        return run

    def meet(q, further):
        """Queries with the donors of their cell; a full cell's queries are dealt on to several tasks."""
        n = q.groupBy("__cell").count().collect()  # one row per cell
        shares = spark.createDataFrame([(r[0], max(1, math.ceil(r[1] / QUERY_BLOCK))) for r in n], "__cell int, __of int")
        qs = q.join(F.broadcast(shares), "__cell").withColumn("__s", F.pmod(F.xxhash64("__qid"), F.col("__of")).cast("int")).drop("__of")
        ds = d.join(F.broadcast(shares), "__cell").withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__of") - 1))).drop("__of")
        return qs.groupBy("__cell", "__s").cogroup(ds.groupBy("__cell", "__s")).applyInArrow(
            nearest(further), schema + (", more array<int>" if further else ""))

    found, _ = write_barrier(meet(q, True), "neighbours")
    drop_path(spark, q_path)
    open_ = found.where(F.size("more") > 0)
    # written here, so that the donors, copied for every combination, go before the caller's next step
    again = meet(open_.select("__qid", "__held", *xs, F.explode("more").alias("__cell")), False)
    again, _ = write_barrier(again.select("__qid", "dist", "did", *cs), "neighbours")
    drop_path(spark, d_path)

    def rows(df, *also):
        one = df.select("__qid", F.posexplode(F.arrays_zip("dist", "did", *cs)).alias("__p", "__n"))
        return one.select(F.col("__qid").alias("qid"), "__n.did", "__n.dist", *[F.col(f"__n.{c}").alias(n) for c, n in zip(cs, carry)], *also)

    w = Window.partitionBy("qid").orderBy("dist", "did")
    both = rows(open_).unionByName(rows(again)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows(found.where(F.size("more") == 0), (F.col("__p") + 1).alias("rank")).unionByName(both)


def _columns(table: pa.Table, names) -> np.ndarray:
    """Columns of doubles as a matrix, nulls as NaN."""
    return np.column_stack([table.column(n).to_numpy() for n in names]) if names else np.zeros((table.num_rows, 0))


def _boxes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of boxes of at most ``size`` rows: halves along the widest side."""
    left, out = [np.arange(len(x))], []
    while left:
        rows = left.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > size else np.zeros(1)
        if len(rows) <= size or spread.max() == 0:
            out += [rows[i:i + size] for i in range(0, len(rows), size)]
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(x[rows, int(np.argmax(spread))], half)]
        left += [rows[:half], rows[half:]]
    return out


def boxed_topk(qn, qc, dn, dc, ids, k, total_dims, cat_width):
    """``_best`` of all pairs of a block, and how many pairs were evaluated.  Queries that miss
    the same coordinates are put into boxes, donors too; the nearest donor boxes give a
    first k-th distance, and only boxes that are not farther are compared besides (a box's
    distance over the numeric coordinates is a lower bound, as categories only add to it)."""
    bd, bi = np.empty((len(qn), min(k, len(dn)))), np.empty((len(qn), min(k, len(dn))), ids.dtype)
    evaluated, missing = 0, np.isnan(np.hstack([qn, qc]))
    patterns, group = np.unique(missing, axis=0, return_inverse=True)
    for g, gone in enumerate(patterns):
        mine = np.flatnonzero(group.reshape(-1) == g)
        cols = np.flatnonzero(~gone[:qn.shape[1]])
        present = len(cols) + sum(w for w, m in zip(cat_width, gone[qn.shape[1]:]) if not m)
        if len(cols):
            boxes = _boxes(dn[:, cols], DONOR_BOX)
            low, high = (np.array([f(dn[b][:, cols], axis=0) for b in boxes]) for f in (np.min, np.max))
        for rows in _boxes(qn[mine][:, cols], QUERY_BOX) if len(cols) else [np.arange(i, min(i + AT_ONCE, len(mine))) for i in range(0, len(mine), AT_ONCE)]:
            at = mine[rows]

            def measure(some):
                return _pair_dist(qn[at], qc[at], dn[some], dc[some], total_dims, cat_width)

            if not len(cols):
                bd[at], bi[at] = _best(measure(np.arange(len(dn))), ids, k)
                evaluated += len(at) * len(dn)
                continue
            x = qn[at][:, None, cols]
            gap = np.maximum(0, np.maximum(low - x, x - high))
            away = np.sqrt((gap * gap).sum(axis=2) * scale(total_dims, present)) * (1 - 1e-9)  # query by box
            near = np.argsort(away.min(axis=0), kind="stable")
            enough = 1 + int(np.searchsorted(np.cumsum([len(boxes[b]) for b in near]), min(k, len(dn))))
            first = np.union1d(near[:enough], away.argmin(axis=1))
            some = np.concatenate([boxes[b] for b in first])
            dist = measure(some)
            kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] >= k else np.full(len(at), np.inf)
            wanted = (away <= kth[:, None]).any(axis=0)  # at the same distance there may be a smaller id
            wanted[first] = False
            rest = [boxes[b] for b in np.flatnonzero(wanted)]
            if rest:
                more = np.concatenate(rest)
                some, dist = np.concatenate([some, more]), np.hstack([dist, measure(more)])
            bd[at], bi[at] = _best(dist, ids[some], k)
            evaluated += dist.size
    return bd, bi, evaluated


# ---- I15 kNN imputation ------------------------------------------------------------------

def knn_impute(df: DataFrame, train_part: str, numeric, categorical, k: int = 5, row_id: str = "row_id",
               part_col: str = "part") -> DataFrame:
    """Fill each missing cell with the mean (numeric) / most frequent value
    (categorical, smallest on ties) of its k nearest complete train rows.
    Distance: nan-euclidean over train-z-scored numerics and one-hot categoricals."""
    from ..encode import ColumnScaler, OrdinalCodes
    feats = list(numeric) + list(categorical)
    train = df.where(F.col(part_col) == train_part)
    complete = None
    for c in feats:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    scaler = ColumnScaler.fit(train, list(numeric), "zscore")
    codes = OrdinalCodes.fit(train, list(categorical))
    def enc(x):
        z = scaler.transform(x.select(part_col, row_id, *feats, *[F.col(c).alias(f"__d_{c}") for c in feats]))
        return codes.encode(z)
    donors = enc(train.where(complete)).withColumnRenamed(row_id, "donor_id")
    qrows = df.where(~complete).withColumn("qkey", F.concat_ws("|", F.col(part_col), F.col(row_id).cast("string")))
    queries = enc(qrows).withColumn("qkey", F.concat_ws("|", F.col(part_col), F.col(row_id).cast("string")))
    widths = [len(codes.labels[c]) for c in categorical]
    nn = knn_topk(queries, donors, k, "qkey", "donor_id", list(numeric), list(categorical), widths, carry=[f"__d_{c}" for c in feats])

    def most_frequent(values):  # the smallest on ties, of k values
        def times(x):
            return F.size(F.filter(values, lambda y: y == x))
        most = F.array_max(F.transform(values, times))
        return F.array_min(F.filter(values, lambda x: times(x) == most))

    out = nn.groupBy("qkey").agg(*[F.avg(f"__d_{c}").alias(f"__v_{c}") for c in numeric],
                                 *[F.collect_list(f"__d_{c}").alias(f"__v_{c}") for c in categorical])
    out = out.withColumns({f"__v_{c}": most_frequent(F.col(f"__v_{c}")) for c in categorical})
    filled = qrows.join(out, "qkey", "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"__v_{c}")) for c in feats}).drop("qkey", *[f"__v_{c}" for c in feats])
    return df.where(complete).unionByName(filled.select(*df.columns))


# ---- I26 neighbour-weighted imputation with uncertainty gate ----------------------------------

def weighted_neighbour_impute(df: DataFrame, train_part: str, numeric, k: int = 10, tau: float | None = None,
                              row_id: str = "row_id", part_col: str = "part") -> DataFrame:
    """Numeric cells from inverse-distance weighted neighbours (a zero
    distance takes all the weight); the neighbours' weighted std is the cell's
    uncertainty, and with ``tau`` a cell is filled only when it is <= tau."""
    from ..encode import ColumnScaler
    train = df.where(F.col(part_col) == train_part)
    complete = None
    for c in numeric:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    scaler = ColumnScaler.fit(train, list(numeric), "zscore")
    donors = scaler.transform(train.where(complete).select(row_id, *numeric, *[F.col(c).alias(f"__d_{c}") for c in numeric])
                              ).withColumnRenamed(row_id, "donor_id")
    qrows = df.where(~complete).withColumn("qkey", F.concat_ws("|", F.col(part_col), F.col(row_id).cast("string")))
    queries = scaler.transform(qrows.select("qkey", *numeric))
    nn = knn_topk(queries, donors, k, "qkey", "donor_id", list(numeric), carry=[f"__d_{c}" for c in numeric])
    met = (F.col("dist") == 0).cast("double")
    near = F.when(F.col("dist") == float("inf"), F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))

    def over(x):  # sums by weight: a zero distance takes all of it
        return F.when(F.max(met) == 1, F.sum(met * x)).otherwise(F.sum(near * x))

    aggs = []
    for c in numeric:
        v = F.col(f"__d_{c}")
        mean = F.try_divide(over(v), over(F.lit(1.0)))
        aggs += [mean.alias(f"__v_{c}"),
                 F.sqrt(F.greatest(F.lit(0.0), F.try_divide(over(v * v), over(F.lit(1.0))) - mean * mean)).alias(f"__u_{c}")]
    out = nn.groupBy("qkey").agg(*aggs)
    fallback = train.agg(*[F.avg(c).alias(c) for c in numeric]).first()
    fill = {}
    for c in numeric:
        ok = F.lit(True) if tau is None else (F.col(f"__u_{c}") <= F.lit(tau))
        # a row with no finite-distance neighbour falls back to the train mean
        fill[c] = F.coalesce(F.col(c), F.when(ok, F.col(f"__v_{c}")),
                             F.lit(fallback[c]) if tau is None else F.lit(None).cast("double"))
    filled = qrows.join(out, "qkey", "left").withColumns(fill)
    return df.where(complete).unionByName(filled.select(*df.columns))


# ---- L15/L30 kNN classifier ---------------------------------------------------------------

def knn_classify(train: DataFrame, val: DataFrame, k: int, id_col: str, vec_col: str, label: str = "label") -> DataFrame:
    """K nearest by Euclidean distance (sim 1/(1+d), ties by train id);
    majority vote, ties to the label met first in that order."""
    q = val.select(F.col(id_col).alias("qid"), vec_col)
    d = train.select(F.col(id_col).alias("did"), vec_col)
    nn = knn_topk(q, d, k, "qid", "did", [vec_col], metric="euclidean")
    lab = train.select(F.col(id_col).alias("did"), F.col(label).alias("nlabel"))
    j = nn.join(lab, "did")
    votes = j.groupBy("qid", "nlabel").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    pred = votes.groupBy("qid").agg(F.min_by("nlabel", F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("prediction"))
    return pred.join(val.select(F.col(id_col).alias("qid"), F.col(label)), "qid").withColumnRenamed("qid", id_col)


# ---- L21-L24 certain predictions over a repair space ----------------------------------------

def certain_predictions(repairs: DataFrame, val: DataFrame, k: int, id_col: str, vec_col: str,
                        label: str = "label") -> DataFrame:
    """For every (validation row, train row) the min and max similarity
    1/(1+d) over the train row's repairs; for each class c the best case for c
    (rows of class c at max, others at min), top-K by that similarity (ties by
    train id), majority vote (lowest label on ties).  A validation row is certain
    when exactly one class wins its own best case.

    repairs: (id, repair, vec, label) -- a complete row has one repair.  All repairs of a
    row lie in one block, so the task that compares them also takes their extremes, and only
    k candidates per (validation row, class, block) leave it."""
    classes = sorted(r[0] for r in repairs.select(label).distinct().collect())  # one row per class

    def block(q, r):
        cols = ["qid", "c", "rid", "rlabel", "s"]
        if not len(q) or not len(r):
            return pd.DataFrame({c: [] for c in cols}).astype({"s": "float64"})
        r = r.sort_values(id_col, kind="stable")
        rid, start = np.unique(r[id_col].to_numpy(), return_index=True)
        rl = r[label].to_numpy()[start]
        dm = np.stack(r[vec_col].apply(lambda a: np.asarray(a, dtype=float)).to_numpy())
        qm = np.stack(q[vec_col].apply(lambda a: np.asarray(a, dtype=float)).to_numpy())
        ids, out = q["qid"].to_numpy(), []
        for lo in range(0, len(q), AT_ONCE):
            part = qm[lo:lo + AT_ONCE]
            squares, slack = _squares(part, dm)
            near, far = np.minimum.reduceat(squares, start, axis=1), np.maximum.reduceat(squares, start, axis=1)
            i, j = np.nonzero(near <= _kth(far, k) + slack)  # only these can be among the k of a class
            some, at = np.unique(j, return_inverse=True)
            low, high = np.full((2, len(part), len(some)), -np.inf)
            low[i, at], high[i, at], *_ = repair_extremes(part, dm, start, i, j)
            for c in classes:
                bd, bi = _best(-np.where(rl[some] == c, high, low), some, k)
                out.append(pd.DataFrame({"qid": np.repeat(ids[lo:lo + AT_ONCE], bd.shape[1]), "c": c,
                                         "rid": rid[bi.reshape(-1)], "rlabel": rl[bi.reshape(-1)], "s": -bd.reshape(-1)}))
        return pd.concat(out)[cols]

    itype, ltype = dict(repairs.dtypes)[id_col], dict(repairs.dtypes)[label]
    qv = val.select(F.col(id_col).alias("qid"), vec_col)
    near = _meet(qv, repairs.select(id_col, vec_col, label), "qid", id_col).applyInPandas(
        block, f"qid {dict(val.dtypes)[id_col]}, c {ltype}, rid {itype}, rlabel {ltype}, s double")
    w = Window.partitionBy("qid", "c").orderBy(F.desc("s"), "rid")  # k candidates per block
    top = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    votes = top.groupBy("qid", "c", "rlabel").count()
    win = votes.groupBy("qid", "c").agg(F.min_by("rlabel", F.struct((-F.col("count")).alias("n"), F.col("rlabel"))).alias("pred"))
    res = win.groupBy("qid").agg(F.count_if(F.col("pred") == F.col("c")).alias("n_survive"),
                                 F.min(F.when(F.col("pred") == F.col("c"), F.col("c"))).alias("certain_label"))
    return res.select(F.col("qid").alias(id_col), (F.col("n_survive") == 1).alias("is_certain"),
                      F.when(F.col("n_survive") == 1, F.col("certain_label")).alias("certain_label"))


def certain_share(certain: DataFrame) -> DataFrame:
    """Share of validation rows whose prediction no repair can change."""
    return certain.agg(F.avg(F.col("is_certain").cast("double")).alias("certain_share"), F.count(F.lit(1)).alias("n"))
