"""Null handling (P7-P23): masks, profiles, fills, integrity checks.

All of these are single aggregates or narrow projections; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_mask(df: DataFrame, columns, sentinel=None) -> DataFrame:
    """1 = observed per column (a sentinel value counts as missing)."""
    def obs(c):
        e = F.col(c).isNotNull()
        if sentinel is not None:
            e = e & (F.col(c) != F.lit(sentinel))
        return e.cast("int").alias(c)
    return df.select(*[obs(c) for c in columns])


def columns_with_nulls(df: DataFrame, numeric, categorical):
    """(numeric columns with nulls, categorical columns with nulls) -- one job."""
    cols = list(numeric) + list(categorical)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return ([c for c in numeric if row[c] > 0], [c for c in categorical if row[c] > 0])


def columns_by_null_count(df: DataFrame, columns) -> list:
    """Columns ordered by ascending null count (ties by name)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (row[c], c))


def null_profile(df: DataFrame, columns, by: str | None = None) -> DataFrame:
    """Per (group, column) null count, null share, share of incomplete
    rows, and rank of the column by null count.  One aggregate job."""
    keys = [by] if by else []
    anynull = None
    for c in columns:
        e = F.col(c).isNull()
        anynull = e if anynull is None else (anynull | e)
    agg = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(anynull).alias("n_incomplete"),
                                *[F.count_if(F.col(c).isNull()).alias(f"n__{c}") for c in columns])
    long = agg.select(*keys, "n_rows", "n_incomplete", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n__{c}").alias("n_nulls")) for c in columns])).alias("x"))
    w = Window.partitionBy(*keys).orderBy("x.n_nulls", "x.column_name") if keys else \
        Window.orderBy("x.n_nulls", "x.column_name")
    return long.select(*keys, "x.column_name", "x.n_nulls",
                       (F.col("x.n_nulls") / F.col("n_rows")).alias("null_share"),
                       (F.col("n_incomplete") / F.col("n_rows")).alias("incomplete_row_share"),
                       F.rank().over(w).cast("int").alias("null_order"))


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """P10."""
    return df.dropna(how="any", subset=columns)


def restrict_to(df: DataFrame, keep: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``df`` whose key survives in ``keep`` (semi join)."""
    return df.join(keep.select(key), key, "left_semi")


def integrity_violations(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys on one side only (empty = aligned)."""
    a = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    b = right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def combine_first(orig: DataFrame, filled: DataFrame, columns, key: str = "row_id") -> DataFrame:
    """Keep observed cells, take the others from ``filled`` (join on key)."""
    f = filled.select(key, *[F.col(c).alias(f"__f_{c}") for c in columns])
    j = orig.join(f, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__f_{c}")) for c in columns}).drop(
        *[f"__f_{c}" for c in columns])


def keep_observed(df: DataFrame, columns, mask_prefix: str, sample_prefix: str) -> DataFrame:
    """Value where the mask says observed, else the sample."""
    return df.withColumns({c: F.when(F.col(mask_prefix + c) == 1, F.col(c)).otherwise(F.col(sample_prefix + c))
                           for c in columns})


def fill_missing(df: DataFrame, numeric_fill=0.0, categorical_fill="", numeric=(), categorical=()) -> DataFrame:
    """P16."""
    out = df
    if numeric:
        out = out.fillna(numeric_fill, subset=list(numeric))
    if categorical:
        out = out.fillna(categorical_fill, subset=list(categorical))
    return out


def range_violations(df: DataFrame, bounds: dict, discrete=()) -> DataFrame:
    """Per column min/max outside [lower, upper], non-integral values of
    discrete columns, infinities, and columns with no observed value."""
    rows = []
    aggs = []
    for c, (lo, hi) in bounds.items():
        aggs += [F.min(c).alias(f"mn__{c}"), F.max(c).alias(f"mx__{c}"), F.count(c).alias(f"n__{c}"),
                 F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf__{c}"),
                 F.count_if(F.col(c) != F.floor(F.col(c))).alias(f"frac__{c}")]
    r = df.agg(*aggs).first()
    for c, (lo, hi) in bounds.items():
        rows.append((c, r[f"mn__{c}"], r[f"mx__{c}"], int(r[f"n__{c}"]), int(r[f"inf__{c}"]),
                     int(r[f"frac__{c}"]) if c in discrete else 0,
                     (lo is not None and r[f"mn__{c}"] is not None and r[f"mn__{c}"] < lo)
                     or (hi is not None and r[f"mx__{c}"] is not None and r[f"mx__{c}"] > hi),
                     "error" if c in discrete else "warning"))
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, max double, observed long, infinities long, non_integral long, "
              "out_of_range boolean, severity string")


def dedupe_names(names) -> list:
    """Repeated names get _2, _3 suffixes in order of appearance."""
    seen, out = {}, []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def restore_types(df: DataFrame, schema) -> DataFrame:
    """Cast back to the input schema (categoricals stay strings, NULL kept)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def overwrite_cells(df: DataFrame, updates: DataFrame, columns, key: str = "row_id", mask_prefix: str | None = None) -> DataFrame:
    """The cells that ``updates`` (key, col, value as string) names take its values; with
    ``mask_prefix`` the cell's mask column becomes 1 (observed).  Of updates that repeat a
    cell the largest value counts."""
    wide = updates.groupBy(key).pivot("col", list(columns)).agg(F.max("value"))
    named = wide.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__u_{c}") for c in columns])
    j = df.join(named, F.col(key) == F.col("__key"), "left")
    new = {c: F.coalesce(F.col(f"__u_{c}").cast(df.schema[c].dataType), F.col(c)) for c in columns}
    if mask_prefix is not None:
        new |= {mask_prefix + c: F.when(F.col(f"__u_{c}").isNotNull(), 1).otherwise(F.col(mask_prefix + c)) for c in columns}
    return j.withColumns(new).drop("__key", *[f"__u_{c}" for c in columns])


def mask_check(mask: DataFrame, columns) -> DataFrame:
    """One row: are all mask cells 0 or 1, and has the mask the declared columns."""
    known = [c for c in columns if c in mask.columns]
    ok = F.lit(True)
    for c in known:
        ok = ok & F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    return mask.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("only_0_and_1"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "right_width", F.lit(len(known) == len(list(columns)) == len(mask.columns)))
