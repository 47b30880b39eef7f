"""Seeded splits (T1-T6): exact sizes, partition-independent, same rows for the
same seed on clean and dirty copies (T2 holds because keys depend on row_id only).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_unit, kth_keys, sql_hash_key

TRAIN, TEST, VAL = "X_train_val", "X_test", "X_val"


def _check_fraction(share):
    if not 0 <= share <= 1:
        raise ValueError(f"cannot split off {share} of the rows: not a share")


def _cut(df: DataFrame, seed, salt: str, k: int, row_id: str, level1=None):
    keyed = df.withColumn("__sk", hash_key(seed, salt, row_id))
    if k <= 0:
        return keyed, F.lit(False)
    thr = kth_keys(keyed, "__sk", {"__all__": k}, level1=level1)["__all__"]
    return keyed, F.col("__sk") <= F.lit(thr)


def _level1(df: DataFrame, seed, salt: str, row_id: str):
    """First histogram level of the split keys; its total is the row count (one job for both)."""
    from ..functions.hashing import HEX_STEP
    rows = (df.select(F.substring(hash_key(seed, salt, row_id), 1, HEX_STEP).alias("p"))
            .groupBy("p").count().collect())
    hist = [(r["p"], r["count"]) for r in rows]
    return sum(c for _, c in hist), {"__all__": hist}


def train_test_split(df: DataFrame, seed: int, test_fraction: float, row_id: str = "row_id",
                     part_col: str = "part", n: int | None = None) -> DataFrame:
    """ceil(n * fraction) rows (the smallest split keys) go to X_test."""
    _check_fraction(test_fraction)
    total, hist = _level1(df, seed, "split", row_id)
    keyed, is_test = _cut(df, seed, "split", math.ceil(total * test_fraction), row_id, level1=hist)
    return keyed.withColumn(part_col, F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN))).drop("__sk")


def sql_train_test_split(base: str, seed: int, test_fraction: float, row_id: str = "row_id") -> str:
    key = sql_hash_key(seed, "split", row_id)
    return (f"SELECT * EXCLUDE (__rn, __n), CASE WHEN __rn <= CAST(ceil(__n * CAST({test_fraction!r} AS DOUBLE)) AS BIGINT) "
            f"THEN '{TEST}' ELSE '{TRAIN}' END AS part FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS __rn, "
            f"count(*) OVER () AS __n FROM ({base}))")


def capped_validation_size(n: int, cap: int = 1000, fraction: float = 0.2) -> int:
    """min(cap, fraction * n)."""
    return int(min(cap, fraction * n))


def three_way_split(df: DataFrame, seed: int, test_fraction: float, val_fraction: float,
                    row_id: str = "row_id", part_col: str = "part") -> DataFrame:
    """T4/T5: test = ceil(n*test) smallest keys; val = next ceil((n-test)*val') keys
    with a separate salt, the val fraction rescaled to the remaining rows."""
    _check_fraction(test_fraction)
    _check_fraction(val_fraction)
    n = df.count()
    n_test = math.ceil(n * test_fraction)
    keyed, is_test = _cut(df, seed, "split", n_test, row_id)
    keyed = keyed.withColumn("__t", is_test)
    rest = keyed.where(~F.col("__t")).withColumn("__vk", hash_key(seed + 1, "val", row_id))
    rescaled = val_fraction / (1.0 - test_fraction) if test_fraction < 1 else 0.0
    n_val = math.ceil((n - n_test) * min(rescaled, 1.0))
    thr = kth_keys(rest, "__vk", {"__all__": n_val}).get("__all__") if n_val > 0 else None
    vk = hash_key(seed + 1, "val", row_id)
    is_val = (vk <= F.lit(thr)) if thr is not None else F.lit(False)
    return (keyed.withColumn(part_col, F.when(F.col("__t"), F.lit(TEST))
                             .when(is_val, F.lit(VAL)).otherwise(F.lit(TRAIN)))
            .drop("__sk", "__t"))


def element_split(cells: DataFrame, seed: int, fraction: float, row_col="row_id", col_col="col_id",
                  flag="is_target") -> DataFrame:
    """Per-cell Bernoulli(fraction) split of a long (row, col, value) table."""
    key = hash_key(seed, "cell", F.concat_ws(":", F.col(row_col).cast("string"), F.col(col_col).cast("string")))
    return cells.withColumn(flag, hash_unit(key) < F.lit(fraction))


def kfold(df: DataFrame, seed: int, k: int = 3, row_id: str = "row_id", fold_col: str = "fold") -> DataFrame:
    """Fold id from the row hash (for CrossValidator(foldCol=...))."""
    from ..functions.hashing import hash_index
    return df.withColumn(fold_col, hash_index(hash_key(seed, "fold", row_id), k).cast("int"))


def capped_slices(df: DataFrame, seed: int, val_size: int, max_size: int | None = None, test_size: int | None = None,
                  row_id: str = "row_id", part_col: str = "part") -> DataFrame:
    """T5: rows in seeded hash order, capped at ``max_size`` where one is given; the first
    ``test_size`` (default int(0.3 * (N - val))) are X_test, the next ``val_size`` X_val, the
    rest X_train_val; rows past the cap are dropped (the cap is the operator's own)."""
    keyed = df.withColumn("__sk", hash_key(seed, "slices", row_id))
    n = df.count()
    n = min(n, max_size) if max_size is not None else n
    t = int(0.3 * (n - val_size)) if test_size is None else test_size
    cuts = {"t": t, "v": t + val_size, "n": n}
    thr = {name: (kth_keys(keyed, "__sk", {"__all__": k})["__all__"] if k > 0 else None) for name, k in cuts.items()}
    le = lambda name: F.col("__sk") <= F.lit(thr[name]) if thr[name] is not None else F.lit(False)
    return (keyed.where(le("n"))
            .withColumn(part_col, F.when(le("t"), F.lit(TEST)).when(le("v"), F.lit(VAL)).otherwise(F.lit(TRAIN)))
            .drop("__sk"))
