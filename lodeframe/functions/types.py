"""The dialect's value types, their names and promotion."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK = {
    "BOOL": T.BooleanType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "NULL": T.NullType(),
}
#: SQL spellings; anything else is text.
NAMES = {
    "BOOL": "BOOL", "BOOLEAN": "BOOL", "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "INT64": "BIGINT",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "DECIMAL": "DOUBLE", "NUMERIC": "DOUBLE",
    "VARCHAR": "VARCHAR", "TEXT": "VARCHAR", "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP",
}
NUMERIC = ("INT", "BIGINT", "FLOAT", "DOUBLE")
_RANK = {"NULL": -1, "BOOL": 0, "INT": 1, "BIGINT": 2, "FLOAT": 3, "DOUBLE": 4}


def named(sql_name: str) -> str:
    return NAMES.get(sql_name.upper(), "VARCHAR")


def of_spark(kind: T.DataType) -> str:
    """The dialect type of a Spark type; those without a counterpart are carried as they are."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    if isinstance(kind, T.DecimalType):
        return "DOUBLE"
    return next((k for k, v in SPARK.items() if type(v) is type(kind)), "OTHER")


def promote(a: str, b: str) -> str:
    """Result type of arithmetic: Double > Float > BigInt > Int; Bool and Null count as Int."""
    return max((a, b, "INT"), key=lambda t: _RANK.get(t, 1))


def common(a: str, b: str) -> str:
    """Type of a value that may come from either side (CASE, COALESCE, UNION)."""
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if a in _RANK and b in _RANK:
        return max((a, b), key=_RANK.get)
    return "TIMESTAMP" if "TIMESTAMP" in (a, b) else "VARCHAR"
