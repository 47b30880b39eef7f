"""Dataset registry (S1-S4): a named table with an explicit row id, its numeric,
categorical, sensitive and target columns, built lazily from the parquet tables.

Every dataset also has a SQL twin (``base_sql``) that builds the same rows in
DuckDB; the oracle queries start from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import first_k, hash_key, sql_hash_key

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class TableSpec:
    name: str
    df: DataFrame
    row_id: str = "row_id"
    target: str | None = "label"
    numeric: tuple = ()
    categorical: tuple = ()
    # attr -> disadvantaged value(s); "A & B" -> intersection (value None)
    sensitive: dict = field(default_factory=dict)
    # numeric column -> declared lower bound
    lower_bounds: dict = field(default_factory=dict)
    test_fraction: float = 0.2

    @property
    def features(self) -> list[str]:
        return list(self.numeric) + list(self.categorical)

    @property
    def sensitive_attrs(self) -> list[str]:
        return [a for a in self.sensitive if "&" not in a]

    def with_df(self, df: DataFrame) -> "TableSpec":
        return replace(self, df=df)

    def kind(self, column: str) -> str:
        return "numerical" if column in self.numeric else "categorical"


# ---------------------------------------------------------------------------
# The stand-in datasets and their protected groups.
# ---------------------------------------------------------------------------
DATASETS = {
    "orders": dict(
        numeric=("o_totalprice", "c_acctbal"),
        categorical=("o_orderpriority", "c_nation"),
        sensitive={"c_mktsegment": "BUILDING", "n_regionkey": ["0", "1"],
                   "c_mktsegment & n_regionkey": None},
        lower_bounds={"o_totalprice": 0.0, "c_acctbal": -1000.0},
        test_fraction=0.2,
    ),
    "lineitem": dict(
        numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        categorical=("l_linenumber_s",),
        sensitive={"l_linestatus": "O"},
        lower_bounds={"l_quantity": 1.0, "l_extendedprice": 0.0, "l_discount": 0.0, "l_tax": 0.0},
        test_fraction=0.2,
    ),
}


def _nan_to_null(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def _orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    df = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey)
          .select(o.o_orderkey.alias("row_id"),
                  o.o_totalprice.cast("double").alias("o_totalprice"),
                  c.c_acctbal.cast("double").alias("c_acctbal"),
                  o.o_orderpriority,
                  c.c_nationkey.cast("string").alias("c_nation"),
                  c.c_mktsegment,
                  n.n_regionkey.cast("string").alias("n_regionkey"),
                  F.when(o.o_orderstatus == "F", 1).otherwise(0).alias("label")))
    return _nan_to_null(df, DATASETS["orders"]["numeric"])


def _lineitem(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    # the integer keys repeat; with the four measures (as fixed-scale decimals, whose
    # text form is the same in every engine) every row is distinct
    rid = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in
                                   ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                            *[F.col(c).cast("decimal(18,4)").cast("string") for c in
                              ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
    df = li.select(rid.alias("row_id"),
                   *[F.col(c).cast("double").alias(c) for c in DATASETS["lineitem"]["numeric"]],
                   F.col("l_linenumber").cast("string").alias("l_linenumber_s"),
                   "l_linestatus",
                   F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return _nan_to_null(df, DATASETS["lineitem"]["numeric"])


_BUILDERS = {"orders": _orders, "lineitem": _lineitem}

BASE_SQL = {
    "orders": (
        "SELECT o.o_orderkey AS row_id, CAST(o.o_totalprice AS DOUBLE) AS o_totalprice, "
        "CAST(c.c_acctbal AS DOUBLE) AS c_acctbal, o.o_orderpriority, "
        "CAST(c.c_nationkey AS VARCHAR) AS c_nation, c.c_mktsegment, "
        "CAST(n.n_regionkey AS VARCHAR) AS n_regionkey, "
        "CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS label "
        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    "lineitem": (
        "SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
        "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR), "
        "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(l_discount AS DECIMAL(18,4)) AS VARCHAR), "
        "CAST(CAST(l_tax AS DECIMAL(18,4)) AS VARCHAR))) AS row_id, "
        "CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, "
        "CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, "
        "CAST(l_linenumber AS VARCHAR) AS l_linenumber_s, l_linestatus, "
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"),
}


def load(spark: SparkSession, sf_dir: str, name: str, where=None, subsample: int | None = None,
         seed: int = 42) -> TableSpec:
    """S1 registry lookup; S2 ``where``, applied to the joined rows after NaN counts as null; S3
    exact-k subsample."""
    if name not in _BUILDERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_BUILDERS)}")
    df = _BUILDERS[name](spark, sf_dir)
    if where is not None:
        df = df.where(where)
    if subsample is not None:
        keyed = df.withColumn("__k", hash_key(seed, "subsample", "row_id"))
        df = keyed.where(first_k(keyed, "__k", subsample)).drop("__k")
    return TableSpec(name=name, df=df, **DATASETS[name])


def base_sql(name: str, subsample: int | None = None, seed: int = 42) -> str:
    sql = BASE_SQL[name]
    if subsample is not None:
        sql = (f"SELECT * EXCLUDE (__rn) FROM (SELECT *, row_number() OVER "
               f"(ORDER BY {sql_hash_key(seed, 'subsample', 'row_id')}) AS __rn FROM ({sql})) "
               f"WHERE __rn <= {subsample}")
    return sql
