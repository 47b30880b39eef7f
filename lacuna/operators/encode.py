"""Encoders and scalers (E1-E25): fitted on train statistics (one small aggregate),
applied by narrow projections to every part; inverses included.

Category codes follow the sorted category order (first-seen order is not
defined in Spark, E12); NULL stays NULL through encode and decode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---- E2-E8, E12, E23: ordinal codes ---------------------------------------------------

@dataclass
class OrdinalCodes:
    labels: dict  # column -> sorted list of categories

    @staticmethod
    def fit(df: DataFrame, columns, *others: DataFrame) -> "OrdinalCodes":
        """Sorted distinct non-null values per column over train (and any
        extra parts, for a shared domain).  One job; domains are category lists."""
        if not columns:
            return OrdinalCodes({})
        src = df.select(*columns)
        for o in others:
            src = src.unionByName(o.select(*columns))
        arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
        # distinct values meet one shuffle; only the category lists reach the driver
        rows = src.select(F.explode(arr).alias("x")).where("x.v IS NOT NULL").select("x.c", "x.v").distinct().collect()
        labels = {c: [] for c in columns if any(r["c"] == c for r in rows)}
        for r in rows:
            labels[r["c"]].append(r["v"])
        return OrdinalCodes({c: sorted(v) for c, v in labels.items()})

    def encode(self, df: DataFrame, castable: bool = False) -> DataFrame:
        """Category -> 0..n-1 (unseen -> NULL); castable=True casts digit codes directly."""
        out = {}
        for c, labels in self.labels.items():
            if castable:
                out[c] = F.col(c).cast("double")
            else:
                m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
                out[c] = m[F.col(c).cast("string")]
        return df.withColumns(out)

    def decode(self, df: DataFrame) -> DataFrame:
        """Round, clip to [0, n-1], map back to the label."""
        out = {}
        for c, labels in self.labels.items():
            arr = F.array(*[F.lit(v) for v in labels])
            idx = F.greatest(F.lit(0), F.least(F.lit(len(labels) - 1), F.rint(F.col(c)).cast("int")))
            out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("string")).otherwise(F.element_at(arr, idx + 1))
        return df.withColumns(out)


def sql_ordinal_encode(src: str, column: str, domain_src: str) -> str:
    """Twin of E2: code = rank of the value in the sorted distinct domain - 1."""
    return (f"SELECT s.* REPLACE (CAST(d.code AS DOUBLE) AS {column}) FROM ({src}) s LEFT JOIN "
            f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v "
            f"FROM ({domain_src}) WHERE {column} IS NOT NULL)) d ON CAST(s.{column} AS VARCHAR) = d.v")


# ---- E13-E16, E22: scalers with inverse ----------------------------------------------------

@dataclass
class ColumnScaler:
    """kind: 'zscore' (population std, 0 -> 1), 'minmax' (+eps), 'bounds' (declared)."""
    params: dict  # column -> (shift, scale)
    kind: str = "zscore"

    @staticmethod
    def fit(df: DataFrame, columns, kind: str = "zscore", eps: float = 0.0, bounds: dict | None = None):
        if kind == "bounds":
            return ColumnScaler({c: (lo, (hi - lo) or 1.0) for c, (lo, hi) in bounds.items()}, kind)
        if kind == "zscore":
            aggs = [x for c in columns for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
        else:
            aggs = [x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"s_{c}"))]
        r = df.agg(*aggs).first()
        params = {}
        for c in columns:
            a, s = r[f"a_{c}"], r[f"s_{c}"]
            if kind == "zscore":
                params[c] = (a, s if s else 1.0)
            else:
                params[c] = (a, (s - a) + eps if s is not None else 1.0)
        return ColumnScaler(params, kind)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(s) for c, (a, s) in self.params.items()})

    def inverse(self, df: DataFrame, clip: bool = False) -> DataFrame:
        out = {}
        for c, (a, s) in self.params.items():
            e = F.col(c) * F.lit(s) + F.lit(a)
            if clip and self.kind == "minmax":
                e = F.greatest(F.lit(a), F.least(F.lit(a + s), e))
            out[c] = e
        return df.withColumns(out)


def shift_counts(df: DataFrame, columns) -> DataFrame:
    """Add 1 to a count column whose minimum is 0."""
    r = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) + 1 for c in columns if r[c] == 0})


# ---- E1, E10: feature vectors --------------------------------------------------------------

@dataclass
class OneHotScaler:
    """Numerics as z-scores of the train part (population std, 0 -> 1), categoricals as one
    coordinate per train label: an unknown or null category is all zeros, a null number the
    mean.  ``drop_first`` leaves out each column's first label (E10)."""
    scaler: ColumnScaler
    codes: OrdinalCodes
    drop_first: bool = False

    @property
    def names(self) -> list[str]:
        """The coordinates in order."""
        return [*self.scaler.params, *[f"{c}={v}" for c, v in self._levels()]]

    def _levels(self):
        return [(c, v) for c, labels in self.codes.labels.items() for v in labels[self.drop_first:]]

    def columns(self) -> list:
        z = [F.coalesce((F.col(c).cast("double") - F.lit(a)) / F.lit(s), F.lit(0.0)) for c, (a, s) in self.scaler.params.items()]
        return z + [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)) for c, v in self._levels()]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, array_to_vector(F.array(*self.columns())))


@dataclass
class OneHotScale:
    numeric: tuple
    categorical: tuple
    drop_first: bool = False

    def fit(self, train: DataFrame) -> OneHotScaler:
        scaler = ColumnScaler.fit(train, list(self.numeric), "zscore") if self.numeric else ColumnScaler({})
        return OneHotScaler(scaler, OrdinalCodes.fit(train, list(self.categorical)), self.drop_first)


# ---- E9, E11, E18, E21: one-hot tables, masks, thermometer ---------------------------------

def one_hot_columns(df: DataFrame, column: str, levels, prefix: str | None = None) -> DataFrame:
    """Dummy columns for declared levels (no distinct job)."""
    p = prefix or column
    return df.withColumns({f"{p}_{v}": (F.col(column) == F.lit(v)).cast("int") for v in levels})


def one_hot_inverse(df: DataFrame, column: str, levels, prefix: str | None = None) -> DataFrame:
    """E9 inverse: argmax label (first level on ties)."""
    p = prefix or column
    best = F.greatest(*[F.col(f"{p}_{v}") for v in levels])
    e = None
    for v in levels:
        e = F.when(F.col(f"{p}_{v}") == best, F.lit(v)) if e is None else e.when(F.col(f"{p}_{v}") == best, F.lit(v))
    return df.withColumn(column, e)


def expand_mask(df: DataFrame, column: str, width: int, out: str | None = None) -> DataFrame:
    """Repeat a cell's observed flag over its one-hot width (array)."""
    return df.withColumn(out or f"{column}_mask", F.array_repeat(F.col(column).isNotNull().cast("int"), width))


def thermometer(df: DataFrame, column: str, levels: int, out: str | None = None) -> DataFrame:
    """Ordinal k -> [1]*(k+1) + [0]*(levels-k-1)."""
    return df.withColumn(out or f"{column}_thermo", F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: (i <= F.col(column)).cast("int")))


def thermometer_inverse(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """E21 inverse: sum - 1."""
    return df.withColumn(out or column.replace("_thermo", ""), F.aggregate(F.col(column), F.lit(0), lambda a, x: a + x) - 1)


def labels_pm1(df: DataFrame, label: str = "label", out: str = "y_pm1") -> DataFrame:
    """0/1 labels to -1/+1."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(1)).otherwise(F.lit(-1)))


# ---- E19/E20: type table and variable metadata -------------------------------------------

def infer_variables(df: DataFrame, columns, target: str | None = None) -> DataFrame:
    """One aggregate -> variables(name, type, lower, upper, n_distinct,
    always_observed, target).  Integral columns with max <= 1 are binary, other
    integral columns categorical, fractional ones continuous, strings categorical."""
    num = [c for c in columns if dict(df.dtypes)[c] not in ("string", "boolean")]
    aggs = [F.count_distinct(c).alias(f"nd__{c}") for c in columns]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nn__{c}") for c in columns]
    for c in num:
        aggs += [F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}"),
                 F.bool_and(F.col(c) == F.floor(F.col(c))).alias(f"int__{c}")]
    r = df.agg(*aggs).first()
    rows = []
    for c in columns:
        if c in num:
            lo, hi, integral = r[f"lo__{c}"], r[f"hi__{c}"], r[f"int__{c}"]
            kind = ("binary" if integral and lo is not None and lo >= 0 and hi <= 1 else
                    "categorical" if integral else "continuous")
            rows.append((c, kind, float(lo) if lo is not None else None, float(hi) if hi is not None else None))
        else:
            rows.append((c, "categorical", None, None))
    out = [(c, k, lo, hi, int(r[f"nd__{c}"]), r[f"nn__{c}"] == 0, c == target) for c, k, lo, hi in rows]
    return df.sparkSession.createDataFrame(
        out, "name string, type string, lower double, upper double, n_distinct long, "
             "always_observed boolean, target boolean")


def mixed_preprocess(train: DataFrame, numeric, categorical, *others: DataFrame):
    """Numerics mean-imputed then min-max scaled (train statistics);
    categoricals filled with 'missing' and one-hot encoded over the domain of
    train and the other parts; returns a function applying it to any part."""
    means = train.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    filled = train.fillna(means).fillna("missing", subset=list(categorical))
    scaler = ColumnScaler.fit(filled, list(numeric), "minmax")
    dom_src = [o.fillna("missing", subset=list(categorical)) for o in others]
    domain = OrdinalCodes.fit(filled, list(categorical), *dom_src).labels

    def apply(df: DataFrame) -> DataFrame:
        out = scaler.transform(df.fillna(means).fillna("missing", subset=list(categorical)))
        for c in categorical:
            out = one_hot_columns(out, c, domain[c]).drop(c)
        return out
    return apply
