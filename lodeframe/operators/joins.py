"""Joins. Hash, merge and nested-loop strategies, build sides, spilling and skew splits are Catalyst's and AQE's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, how: str, on: Column | None) -> DataFrame:
    """INNER and LEFT joins with any condition (keys with NULL never match), and CROSS."""
    if how == "CROSS":
        return left.crossJoin(right)
    return left.join(right, on, {"INNER": "inner", "LEFT": "left"}[how])


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def count(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Number of joined rows; column pruning leaves the keys only."""
    return left.join(right, on, how).agg(F.count(F.lit(1)).alias("n"))
