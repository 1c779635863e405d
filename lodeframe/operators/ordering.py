"""Sorting with explicit NULL places (last for ASC, first for DESC unless stated), limits and distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def sort_key(col: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    first = descending if nulls_first is None else nulls_first
    if descending:
        return col.desc_nulls_first() if first else col.desc_nulls_last()
    return col.asc_nulls_first() if first else col.asc_nulls_last()


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """OFFSET then LIMIT; a negative limit is none, a negative offset is 0. With a sort below this is a top-N."""
    if offset and offset > 0:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None and limit >= 0 else df


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
