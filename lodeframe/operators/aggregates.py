"""Aggregates with the dialect's result types. Catalyst plans them as partial and final with spilling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import SPARK

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregate(name: str, x: tuple[Column, str] | None, distinct: bool = False) -> tuple[Column, str]:
    """COUNT(*) for no argument; NULLs are skipped, integer sums are BIGINT with NULL on overflow, AVG is DOUBLE.

    Sums of FLOAT run in double and come back as FLOAT.
    """
    if x is None:
        return F.count(F.lit(1)), "BIGINT"
    col, kind = x
    if name == "COUNT":
        return (F.count_distinct(col) if distinct else F.count(col)), "BIGINT"
    if name in ("MIN", "MAX"):
        return (F.min if name == "MIN" else F.max)(col), kind
    number = col.cast("int") if kind == "BOOL" else col.cast("double") if kind in ("FLOAT", "NULL") else col
    if name == "AVG":
        return (F.call_function("avg", number) if not distinct else _distinct("avg", number)), "DOUBLE"
    out = "BIGINT" if kind in ("BOOL", "INT", "BIGINT") else kind if kind in ("FLOAT", "DOUBLE") else "DOUBLE"
    return (_distinct("sum", number) if distinct else F.try_sum(number)).cast(SPARK[out]), out


def _distinct(name: str, col: Column) -> Column:
    """AVG over a set is the sum over the set by its size."""
    if name == "sum":
        return F.sum_distinct(col)
    return F.sum_distinct(col.cast("double")) / F.nullif(F.count_distinct(col), F.lit(0))


def group(df: DataFrame, keys: list[Column], aggs: list[Column]) -> DataFrame:
    """Grouped, or one row over everything; groups without aggregates are the distinct keys."""
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
