"""Scalar semantics as Columns: NULL instead of errors on overflow, zero divisors and bad casts.

Every function takes Columns with their dialect types and returns a (Column, type) pair, so the frontend and hand-written
DataFrame code share one meaning. All are built-in expressions that stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import SPARK, common, promote

Typed = tuple[Column, str]
_MIN = {"INT": -(2**31), "BIGINT": -(2**63)}
#: Dates and times are written in full; Spark's own cast would take shorter forms.
STAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"


def null(kind: str) -> Column:
    return F.lit(None).cast(SPARK.get(kind, SPARK["VARCHAR"]))


def _as(x: Typed, kind: str) -> Column:
    return x[0] if x[1] == kind else x[0].cast(SPARK[kind])


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """``+ - *``: promoted, NULL on integer overflow."""
    kind = promote(a[1], b[1])
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return f(_as(a, kind), _as(b, kind)).cast(SPARK[kind]), kind


def divide(a: Typed, b: Typed) -> Typed:
    """Integers: truncating, NULL for a zero divisor or the one overflow. Floats: infinities and NaN."""
    kind = promote(a[1], b[1])
    x, y = _as(a, kind), _as(b, kind)
    if kind in _MIN:
        bad = (y == 0) | ((x == F.lit(_MIN[kind])) & (y == -1))
        return F.when(bad, null(kind)).otherwise(F.call_function("div", x, F.when(bad, F.lit(1)).otherwise(y)).cast(SPARK[kind])), kind
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, at_zero).otherwise(x / F.when(y == 0, F.lit(1)).otherwise(y)).cast(SPARK[kind]), kind


def modulo(a: Typed, b: Typed) -> Typed:
    """Of two equal integer types, with the dividend's sign; NULL for zero and any other mix."""
    if a[1] != b[1] or a[1] not in _MIN:
        return null(promote(a[1], b[1])), promote(a[1], b[1])
    return F.try_mod(a[0], b[0]), a[1]


def negate(a: Typed) -> Typed:
    """Unary minus; the least integer has no opposite and gives NULL."""
    kind = promote(a[1], "INT")
    if kind in _MIN:
        return F.try_subtract(F.lit(0).cast(SPARK[kind]), _as(a, kind)), kind
    return -a[0], kind


def compare(op: str, a: Typed, b: Typed) -> Typed:
    """Comparisons propagate NULL; BOOL meets numbers as 0 and 1, text meets timestamps by strict conversion.

    Otherwise unlike types are never equal and order by their type.
    """
    order = ("BOOL", "INT", "BIGINT", "FLOAT", "DOUBLE", "VARCHAR", "TIMESTAMP")
    (x, s), (y, t) = a, b
    if s != t and "NULL" not in (s, t):
        if "TIMESTAMP" in (s, t):
            x, y = cast(a, "TIMESTAMP")[0], cast(b, "TIMESTAMP")[0]
        elif "VARCHAR" in (s, t) and s in order and t in order:
            rank = order.index(s) - order.index(t)
            truth = {"=": False, "!=": True, "<": rank < 0, "<=": rank < 0, ">": rank > 0, ">=": rank > 0}[op]
            return F.when(x.isNotNull() & y.isNotNull(), F.lit(truth)), "BOOL"
        else:
            x, y = (c.cast("int") if k == "BOOL" else c for c, k in (a, b))
    out = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return out, "BOOL"


def like(a: Column, pattern: str) -> Column:
    """``%`` and ``_`` only: a backslash is an ordinary character."""
    return a.like(pattern.replace("\\", "\\\\"))


def nullif(a: Typed, b: Typed) -> Typed:
    """NULL when equal, and also when either side is NULL."""
    return F.when(a[0].isNull() | b[0].isNull() | compare("=", a, b)[0], null(a[1])).otherwise(a[0]), a[1]


def coalesce(*xs: Typed) -> Typed:
    kind = xs[0][1]
    for x in xs[1:]:
        kind = common(kind, x[1])
    return F.coalesce(*[cast(x, kind)[0] if x[1] != kind else x[0] for x in xs]), kind


def length(a: Column) -> Typed:
    """Length in bytes."""
    return F.octet_length(a), "INT"


def cast(a: Typed, kind: str) -> Typed:
    """Conversion that gives NULL where it fails."""
    x, of = a
    if of == kind:
        return a
    if of == "NULL":
        return null(kind), kind
    if kind == "VARCHAR":
        if of == "BOOL":
            return F.when(x, F.lit("1")).when(~x, F.lit("0")), kind
        if of in ("FLOAT", "DOUBLE"):
            return F.when(x.isNotNull(), F.format_string("%f", x.cast("double"))), kind
        return x.cast("string"), kind
    if of == "VARCHAR":
        if kind in _MIN:
            return F.when(x.rlike(r"^\s*[+-]?\d+$"), F.ltrim(x)).try_cast(SPARK[kind]), kind
        if kind in ("FLOAT", "DOUBLE"):
            head = F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
            return F.when(head != "", head).try_cast(SPARK[kind]), kind
        if kind == "BOOL":
            return F.when(x.isin("true", "1", "t", "TRUE"), F.lit(True)).when(x.isin("false", "0", "f", "FALSE"), F.lit(False)), kind
        return F.when(x.rlike(STAMP), x).try_cast(SPARK[kind]), kind
    if kind in _MIN and of in ("FLOAT", "DOUBLE"):
        lo, hi = float(_MIN[kind]), float(-_MIN[kind])
        whole = F.when((x > lo - 1) & (x < hi) if kind == "INT" else (x >= lo) & (x < hi), x)
        return whole.try_cast(SPARK[kind]), kind
    if kind == "BOOL":
        return (x != 0), kind
    if kind == "TIMESTAMP" or of == "TIMESTAMP":
        return null(kind), kind
    return x.try_cast(SPARK[kind]), kind
