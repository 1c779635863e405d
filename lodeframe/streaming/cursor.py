"""Cursors and row output: rows are pulled a partition at a time, never collected whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, Row


class Cursor:
    def __init__(self, df: DataFrame):
        self.df, self._rows = df, None

    def fetch(self, n: int) -> list[Row]:
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        return list(islice(self._rows, max(0, n)))

    def close(self) -> None:
        self._rows = iter(())


def cell(value) -> str:
    """A value as text output shows it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, float):
        return f"{value:f}"
    if hasattr(value, "strftime"):
        text = value.strftime("%Y-%m-%d %H:%M:%S")
        return f"{text}.{value.microsecond:06d}".rstrip("0") if value.microsecond else text
    return str(value)


def lines(df: DataFrame, max_rows: int | None = None) -> Iterator[str]:
    """Header and rows, separated by pipes. More than ``max_rows`` rows are an error, found on the row after."""
    yield "|".join(df.columns)
    for k, row in enumerate((df if max_rows is None else df.limit(max_rows + 1)).toLocalIterator()):
        if max_rows is not None and k >= max_rows:
            raise ValueError(f"result has more than {max_rows} rows")
        yield "|".join(map(cell, row))


#: Rows that the column widths of a table are taken from; wider cells later stick out.
SAMPLE = 200


def table_lines(df: DataFrame, max_rows: int | None = None) -> Iterator[str]:
    """An aligned table: header, rule and padded rows, numbers to the right. Only the first SAMPLE rows are held."""
    right = [t in ("tinyint", "smallint", "int", "bigint", "float", "double") for _, t in df.dtypes]
    rows = (list(map(cell, r)) for r in (df if max_rows is None else df.limit(max_rows + 1)).toLocalIterator())
    first = list(islice(rows, SAMPLE))
    width = [max(map(len, [c, *(r[k] for r in first)])) for k, c in enumerate(df.columns)]
    line = lambda r: " | ".join(x.rjust(w) if n else x.ljust(w) for x, w, n in zip(r, width, right)).rstrip()
    yield line(df.columns)
    yield "-+-".join("-" * w for w in width)
    for k, r in enumerate(chain(first, rows)):
        if max_rows is not None and k >= max_rows:
            raise ValueError(f"result has more than {max_rows} rows")
        yield line(r)
