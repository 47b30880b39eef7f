"""File sources and sinks (S11-S24): CSV/JSON loaders with masks, triplets,
predefined splits, flattening of nested configs, CSV writers.

All reads take an explicit schema where one is known; row order in files is not
defined in Spark, so "last duplicate wins" needs an explicit sequence column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv_with_mask(spark: SparkSession, path: str, schema: StructType, max_rows: int | None = None, order_by=None):
    """Header-less CSV -> (data with empty strings as NULL, 0/1 observed mask).  The
    loader's own row cap takes the first rows in the order of ``order_by``."""
    df = spark.read.csv(path, header=False, schema=schema, emptyValue=None, nullValue="")
    if max_rows is not None:
        if order_by is None:
            raise ValueError("a row cap needs an order: name the columns to order by")
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(max_rows)
    mask = df.select(*[F.col(f.name).isNotNull().cast("int").alias(f.name) for f in schema.fields])
    return df, mask


def csv_from_strings(df: DataFrame, col: str, schema_ddl: str) -> DataFrame:
    """Parse a column of CSV lines."""
    return df.select(F.from_csv(F.col(col), schema_ddl).alias("r")).select("r.*")


def triplets_last_wins(df: DataFrame, row="row_id", col="col_id", value="value", seq="seq") -> DataFrame:
    """One value per (row, col) -- the one with the highest sequence number."""
    return df.groupBy(row, col).agg(F.max_by(value, seq).alias(value))


def rows_as_maps(df: DataFrame, row="row_id", col="col_id", value="value", used: DataFrame | None = None) -> DataFrame:
    """{col: value} per row, restricted to used columns (semi join)."""
    if used is not None:
        df = df.join(used.select(col), col, "left_semi")
    return df.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, value)))).alias("cells"))


def drop_unobserved(df: DataFrame, row="row_id", col="col_id", value="value"):
    """Keep observed cells; dense ids of the used rows / columns."""
    from ..operators.graphprep import dense_index
    obs = df.where(F.col(value).isNotNull())
    rows = dense_index(obs, row, "row_idx")
    cols = dense_index(obs, col, "col_idx")
    return obs.join(rows, row).join(cols, col), rows, cols


def assert_observed_in_train(train: DataFrame, features, col="col_id", value="value"):
    """Fail when a feature has no observed value in train."""
    # only the features asked for are looked up; at most that many names reach the driver
    wanted = train.sparkSession.createDataFrame([(f,) for f in features], f"{col} {dict(train.dtypes)[col]}")
    missing = sorted(r[0] for r in wanted.join(train.where(F.col(value).isNotNull()), col, "left_anti").collect())
    if missing:
        raise ValueError(f"features without an observed train value: {missing}")


def load_predefined_splits(spark: SparkSession, paths: dict, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Train / val / test files -> one long table with a part column (val optional)."""
    frames = []
    for part, path in paths.items():
        if path is None:
            continue
        frames.append(spark.read.format(fmt).schema(schema).option("header", False).load(path)
                      .withColumn("part", F.lit(part)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def clean_categoricals(df: DataFrame, categorical, drop=()) -> DataFrame:
    """Categoricals as strings with 'nan' -> NULL; drop variables."""
    return df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("nan")) for c in categorical}).drop(*drop)


def paired_clean_dirty(clean: DataFrame, dirty: DataFrame, features, key="row_id") -> DataFrame:
    """Join clean and dirty copies; indicator = dirty cell IS NULL."""
    d = dirty.select(key, *[F.col(c).alias(f"dirty_{c}") for c in features])
    j = clean.join(d, key)
    return j.withColumns({f"missing_{c}": F.col(f"dirty_{c}").isNull() for c in features})


def apply_missing_positions(df: DataFrame, positions: DataFrame, features, row="row_id") -> DataFrame:
    """(1-based row, 1-based col) missing positions applied as a mask."""
    names = F.array(*[F.lit(c) for c in features])
    pos = positions.select(F.col("row").alias(row), F.element_at(names, F.col("col")).alias("__c"))
    agg = pos.groupBy(row).agg(F.collect_set("__c").alias("__miss"))
    j = df.join(agg, row, "left")
    return j.withColumns({c: F.when(F.array_contains(F.coalesce("__miss", F.array().cast("array<string>")), c),
                                    F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
                          for c in features}).drop("__miss")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Recursively flatten struct columns to dotted names."""
    def walk(schema, prefix):
        out = []
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, name + ".")
            else:
                out.append(F.col("`" + "`.`".join(name.split(".")) + "`").alias(name.replace(".", sep)))
        return out
    return df.select(*walk(df.schema, ""))


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Dotted names back to nested structs (one level per separator)."""
    tree: dict = {}
    for c in df.columns:
        node = tree
        parts = c.split(sep)
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = c

    def build(node):
        return F.struct(*[(build(v) if isinstance(v, dict) else F.col(f"`{v}`")).alias(k) for k, v in node.items()])
    return df.select(*[(build(v) if isinstance(v, dict) else F.col(f"`{v}`")).alias(k) for k, v in tree.items()])


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """Per-run JSON documents -> one flat table."""
    return flatten(spark.read.option("multiLine", True).json(path))


def write_csv(df: DataFrame, path: str, header: bool = True):
    """Table -> CSV folder."""
    df.write.mode("overwrite").option("header", header).csv(path)
