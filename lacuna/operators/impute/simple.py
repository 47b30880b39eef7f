"""Statistic imputers (I1-I12): fit = one aggregate job over the train rows (medians and
percentiles: a few histogram jobs, exact at any size), transform = a narrow ``coalesce``
projection on any part.

Ties of "most frequent" pick the smallest value (as pandas / scipy do).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.quantiles import quantiles

APPROX_ACCURACY = 1_000_000  # relative rank error 1e-6 of the sketch, where it is asked for


@dataclass
class ImputerModel:
    stats: dict  # column -> fill value
    name: str = "simple"
    drop_incomplete_part: str | None = None  # deletion: train part loses incomplete rows
    features: list = field(default_factory=list)

    def transform(self, df: DataFrame, part_col: str = "part") -> DataFrame:
        if self.drop_incomplete_part is not None:
            complete = None
            for c in self.features:
                e = F.col(c).isNotNull()
                complete = e if complete is None else complete & e
            df = df.where((F.col(part_col) != F.lit(self.drop_incomplete_part)) | complete)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.stats.items()})

    def stats_frame(self, spark) -> DataFrame:
        rows = [(c, None if v is None else str(v)) for c, v in sorted(self.stats.items())]
        return spark.createDataFrame(rows, "column string, value string")


def _num_expr(c: str, how: str, p: float | None):
    col = F.col(c)
    if how == "median":
        return F.percentile_approx(col, 0.5, APPROX_ACCURACY)
    if how == "mean":
        return F.avg(col)
    if how == "zero":
        return F.lit(0.0)
    if how == "min":
        return F.min(col)
    if how == "max":
        return F.max(col)
    if how == "percentile":
        return F.percentile_approx(col, p / 100.0, APPROX_ACCURACY)
    if how == "grid":  # I11
        return F.min(col) + (F.max(col) - F.min(col)) * F.lit(p / 100.0)
    raise ValueError(f"unknown numeric strategy {how}")


def ranked_values(df: DataFrame, columns, rank: int = 1, value_type: str = "string") -> dict:
    """rank-th most frequent value per column (1 = mode), smallest value on ties.

    One job: unpivot -> partial-aggregated (column, value) counts -> top by column.
    """
    if not columns:
        return {}
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value"))
                                for c in columns])).alias("cv")
    counts = (df.select(stack).select("cv.column", "cv.value").where(F.col("value").isNotNull())
              .groupBy("column", "value").count())
    order = F.struct((-F.col("count")).alias("n"), F.col("value"))
    found: dict = {}
    for _ in range(rank):  # the best of what earlier rounds left; no column's values in one task
        left = counts
        for c, values in found.items():
            left = left.where((F.col("column") != c) | ~F.col("value").isin(values))
        best = {r["column"]: r["value"] for r in left.groupBy("column").agg(F.min_by("value", order).alias("value")).collect()}
        for c, v in best.items():
            found.setdefault(c, []).append(v)
    return best


class SimpleImputer:
    """num in {median, mean, zero, lower, min, max, percentile, grid, most_frequent};
    cat in {most_frequent, constant, rank}.  "lower" fills the declared lower bound of
    ``bounds`` {column: bound} (I7).  ``median_method``: "exact", or "approx" for a
    rank-error-bounded sketch of medians and percentiles in one job."""

    def __init__(self, num: str = "median", cat: str = "most_frequent", p: float | None = None,
                 fill_value: str = "missing", cat_rank: int = 1, median_method: str = "exact", name=None, bounds: dict | None = None):
        self.num, self.cat, self.p, self.fill_value, self.cat_rank = num, cat, p, fill_value, cat_rank
        self.median_method = median_method
        self.bounds = bounds
        self.name = name or f"{num}-{cat}"

    def fit(self, train: DataFrame, numeric, categorical) -> ImputerModel:
        numeric, categorical = list(numeric), list(categorical)
        stats = {}
        if numeric:
            if self.num == "lower":
                stats.update({c: float((self.bounds or {})[c]) for c in numeric})
            elif self.num == "most_frequent":
                stats.update({c: float(v) for c, v in ranked_values(train, numeric, 1, "double").items()})
            else:
                if self.num in ("median", "percentile") and self.median_method == "exact":
                    share = 0.5 if self.num == "median" else self.p / 100.0
                    stats.update(quantiles(train, {c: share for c in numeric}))
                else:
                    row = train.agg(*[_num_expr(c, self.num, self.p).alias(c) for c in numeric]).first()
                    stats.update({c: row[c] for c in numeric if row[c] is not None})
        if categorical:
            if self.cat == "constant":
                stats.update({c: self.fill_value for c in categorical})
            else:
                stats.update(ranked_values(train, categorical, self.cat_rank if self.cat == "rank" else 1))
        return ImputerModel(stats=stats, name=self.name, features=numeric + categorical)


class DeletionImputer:
    """Train loses incomplete rows; tests get median / mode of the surviving train rows."""
    name = "deletion"

    def __init__(self, train_part: str = "X_train_val"):
        self.train_part = train_part

    def fit(self, train: DataFrame, numeric, categorical) -> ImputerModel:
        feats = list(numeric) + list(categorical)
        complete = train.dropna(how="any", subset=feats)
        model = SimpleImputer("median", "most_frequent").fit(complete, numeric, categorical)
        return ImputerModel(stats=model.stats, name=self.name, drop_incomplete_part=self.train_part,
                            features=feats)


IMPUTERS = {
    "deletion": lambda: DeletionImputer(),
    "median-mode": lambda: SimpleImputer("median", "most_frequent", name="median-mode"),
    "median-dummy": lambda: SimpleImputer("median", "constant", name="median-dummy"),
    "mean-mode": lambda: SimpleImputer("mean", "most_frequent", name="mean-mode"),
    "mode-mode": lambda: SimpleImputer("most_frequent", "most_frequent", name="mode-mode"),
    "zero-dummy": lambda: SimpleImputer("zero", "constant", name="zero-dummy"),
    "min-mode": lambda bounds=None: SimpleImputer("lower", "most_frequent", name="min-mode", bounds=bounds),
}


def impute_by_type(df: DataFrame, variables: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The mean for real and count variables and the mode for categorical and ordinal
    ones, as the ``variables`` table (name, type: one row per column) says."""
    kinds = {r["name"]: r["type"] for r in variables.select("name", "type").collect()}
    num = [c for c, k in kinds.items() if k in ("continuous", "real", "count") and c in df.columns]
    cat = [c for c, k in kinds.items() if k not in ("continuous", "real", "count", "text") and c in df.columns]
    src = df if train is None else train
    stats = {**SimpleImputer("mean").fit(src, num, []).stats, **ranked_values(src, cat)}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in stats.items()})


def impute_targets_only(df: DataFrame, targets, imputer, numeric, categorical) -> DataFrame:
    """The declared target columns are hidden and imputed from what the imputer learns
    on the observed values; other columns keep their nulls."""
    model = imputer.fit(df, [c for c in numeric if c in targets], [c for c in categorical if c in targets])
    return df.withColumns({c: F.lit(model.stats[c]).cast(df.schema[c].dataType) for c in targets if c in model.stats})


# ---- SQL twins -----------------------------------------------------------------

def sql_num_stat(c: str, how: str, src: str, p: float | None = None) -> str:
    q = (p or 0) / 100.0
    f = {"median": f"median({c})", "mean": f"avg({c})", "zero": "any_value(CAST(0.0 AS DOUBLE))",
         "min": f"min({c})", "max": f"max({c})",
         "percentile": f"quantile_cont({c}, {q!r})",
         "grid": f"min({c}) + (max({c}) - min({c})) * CAST({q!r} AS DOUBLE)"}[how]
    return f"(SELECT {f} FROM ({src}))"


def sql_rank_value(c: str, src: str, rank: int = 1, cast: str | None = None) -> str:
    v = f"CAST({c} AS {cast})" if cast else c
    return (f"(SELECT v FROM (SELECT {v} AS v, count(*) AS n FROM ({src}) WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v ASC LIMIT 1 OFFSET {rank - 1})")


def sql_stats(imputer: str, numeric, categorical, train_src: str, bounds: dict | None = None) -> dict:
    """column -> scalar subquery computing the fill value on ``train_src``."""
    num, cat = {"deletion": ("median", "most_frequent"), "median-mode": ("median", "most_frequent"),
                "median-dummy": ("median", "constant"), "mean-mode": ("mean", "most_frequent"),
                "mode-mode": ("most_frequent", "most_frequent"), "zero-dummy": ("zero", "constant"),
                "min-mode": ("lower", "most_frequent")}[imputer]
    if imputer == "deletion":
        feats = list(numeric) + list(categorical)
        train_src = f"SELECT * FROM ({train_src}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in feats)
    out = {}
    for c in numeric:
        if num == "lower":
            out[c] = f"CAST({float(bounds[c])!r} AS DOUBLE)"
        else:
            out[c] = sql_rank_value(c, train_src, 1, "DOUBLE") if num == "most_frequent" else sql_num_stat(c, num, train_src)
    for c in categorical:
        out[c] = "'missing'" if cat == "constant" else sql_rank_value(c, train_src)
    return out
