"""Protected subgroups (M1, A32): 'overall', '<attr>_priv', '<attr>_dis' and
intersections '<A&B>_priv/_dis' (dis on both / priv on both; mixed rows in neither).
A row with a NULL attribute is in neither group of that attribute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.predicates import condition, sql_condition


def _flags(sensitive: dict):
    dis, priv = {}, {}
    for attr, val in sensitive.items():
        if "&" in attr:
            continue
        dis[attr] = condition(attr, val)
        priv[attr] = F.col(attr).isNotNull() & ~condition(attr, val)
    return dis, priv


def group_name(attr: str) -> str:
    return attr.replace(" ", "")


def membership(sensitive: dict) -> Column:
    """array<string> of the subgroups a row belongs to (always 'overall')."""
    dis, priv = _flags(sensitive)
    items = [F.lit("overall")]
    for attr in sensitive:
        if "&" in attr:
            parts = [a.strip() for a in attr.split("&")]
            d = p = F.lit(True)
            for a in parts:
                d, p = d & dis[a], p & priv[a]
        else:
            d, p = dis[attr], priv[attr]
        g = group_name(attr)
        items.append(F.when(d, F.lit(f"{g}_dis")).when(p, F.lit(f"{g}_priv")))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def sql_membership(sensitive: dict) -> str:
    dis = {a: sql_condition(a, v) for a, v in sensitive.items() if "&" not in a}
    priv = {a: f"({a} IS NOT NULL AND NOT {sql_condition(a, v)})" for a, v in sensitive.items() if "&" not in a}
    items = ["'overall'"]
    for attr in sensitive:
        if "&" in attr:
            parts = [a.strip() for a in attr.split("&")]
            d = " AND ".join(dis[a] for a in parts)
            p = " AND ".join(priv[a] for a in parts)
        else:
            d, p = dis[attr], priv[attr]
        g = group_name(attr)
        items.append(f"CASE WHEN {d} THEN '{g}_dis' WHEN {p} THEN '{g}_priv' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
