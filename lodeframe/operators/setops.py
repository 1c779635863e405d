"""Unions: columns meet by position, names come from the left."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(left: DataFrame, right: DataFrame, all_rows: bool) -> DataFrame:
    both = left.union(right)
    return both if all_rows else both.distinct()
