"""Registered queries: name -> (Spark builder, DuckDB twin, double columns).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables; each twin is SQL over the same tables.  Doubles are rounded to 9
decimals on both sides (summation order differs between engines after ~1e-13).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 9


@dataclass
class Query:
    name: str
    build: Callable
    sql: str | None
    doubles: tuple = ()
    note: str = ""


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
                           if isinstance(f.dataType, (DoubleType, FloatType))})


def sql_rounded(sql: str, doubles, digits: int = DIGITS) -> str:
    if not doubles:
        return sql
    repl = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({sql})"


def register(name: str, sql: str | None = None, doubles=(), note: str = ""):
    def deco(fn):
        def build(spark, sf_dir):
            return rounded(fn(spark, sf_dir))
        REGISTRY[name] = Query(name, build, sql_rounded(sql, doubles) if sql else None, tuple(doubles), note)
        return fn
    return deco


def queries() -> dict:
    _load_all()
    return {n: q.build for n, q in REGISTRY.items()}


def oracle_sql() -> dict:
    _load_all()
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}


def reset():
    """A cold start: forget shared experiments and cached tables (the bench calls it before
    every query)."""
    from . import q_models, q_reports
    q_models.reset()
    q_reports.reset()


_LOADED = False


def _load_all():
    global _LOADED
    if _LOADED:
        return
    from . import (q_chained, q_cleaning, q_experiment, q_graph, q_imputers, q_models, q_more,  # noqa: F401
                   q_neighbours, q_operators, q_reports, q_runner, q_steps, q_tables)
    _LOADED = True
