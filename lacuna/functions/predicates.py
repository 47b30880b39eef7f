"""Condition values -> Column predicates (scalar, list, range dict), with SQL twins.

A NULL cell never satisfies a condition (pandas NaN comparisons are False too).
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Range:
    """An interval with at most one bound on either side; a bound is (value, closed)."""

    low: tuple | None = None
    high: tuple | None = None

    @classmethod
    def of(cls, spec: dict) -> "Range":
        ends = {"ge": ("low", True), "gt": ("low", False), "le": ("high", True), "lt": ("high", False)}
        bounds = {}
        for key, value in spec.items():
            side, closed = ends.get(key, (None, None))
            if side is None:
                raise ValueError(f"unknown range key {key!r}; a range is written with {', '.join(ends)}")
            if side in bounds:
                raise ValueError(f"the range {spec} has two {side} bounds")
            bounds[side] = (value, closed)
        if not bounds:
            raise ValueError("a range needs a bound")
        return cls(**bounds)

    def terms(self):
        """(operator, value) of each bound, the lower one first."""
        if self.low is not None:
            yield (">=" if self.low[1] else ">"), self.low[0]
        if self.high is not None:
            yield ("<=" if self.high[1] else "<"), self.high[0]


_COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}


def condition(column: str, value, include: bool = True) -> Column:
    c = F.col(column)
    if isinstance(value, dict):
        pred = functools.reduce(operator.and_, (_COMPARE[op](c, v) for op, v in Range.of(value).terms()))
    elif isinstance(value, (list, tuple)):
        pred = c.isin(list(value))
    else:
        pred = c == F.lit(value)
    if not include:
        pred = ~pred
    # NULL -> False, so a nulled cell is never part of a condition subset
    return F.coalesce(pred, F.lit(False))


def sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def sql_condition(column: str, value, include: bool = True) -> str:
    if isinstance(value, (list, tuple)):
        pred = f"{column} IN ({', '.join(sql_literal(v) for v in value)})"
    elif isinstance(value, dict):
        pred = " AND ".join(f"{column} {op} {sql_literal(v)}" for op, v in Range.of(value).terms())
    else:
        pred = f"{column} = {sql_literal(value)}"
    if not include:
        pred = f"NOT ({pred})"
    return f"COALESCE(({pred}), FALSE)"
