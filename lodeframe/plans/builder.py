"""Syntax tree to DataFrame. Only the logical plan is stated; Catalyst optimizes and executes it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, is_dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import scalar as S
from ..functions.types import NUMERIC, SPARK, common, of_spark
from ..operators.aggregates import aggregate, group
from ..operators.joins import join
from ..operators.ordering import page, sort_key
from ..operators.setops import union
from .tree import Agg, Binary, Call, Case, Cast, InList, InQuery, Like, Literal, Name, Param, Query, Scalar, Select, Source, Star, Unary


@dataclass(frozen=True)
class Field:
    """A column in scope: how it is addressed, and its unique name in the DataFrame."""

    table: str | None
    name: str
    inner: str
    kind: str


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]


def walk(node, stop=()):
    """Every tree node below and including this one; nothing below nodes of the kinds in ``stop``."""
    yield node
    if isinstance(node, stop):
        return
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x, stop)
    elif is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name), stop)


def aggregates_in(*nodes) -> list[Agg]:
    """Distinct aggregates in order of appearance; those of subqueries are their own."""
    return list(dict.fromkeys(x for n in nodes for x in walk(n, (Query,)) if isinstance(x, Agg)))


class Scope:
    def __init__(self, fields: Sequence[Field], bound: dict | None = None, grouped: bool = False):
        self.fields, self.bound, self.grouped = fields, bound or {}, grouped

    def find(self, name: Name) -> Field:
        hits = [f for f in self.fields if f.name == name.column and name.table in (None, f.table)]
        said = f"{name.table}.{name.column}" if name.table else name.column
        if not hits:
            raise AnalysisError(f"column '{said}' not found")
        if len(hits) > 1:
            raise AnalysisError(f"column '{said}' is ambiguous")
        return hits[0]


class Builder:
    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], params: Sequence = (), strict: bool = True):
        self.spark, self.table, self.params, self.strict, self._ids = spark, table, params, strict, count()

    # -- relations
    def run(self, query: Query) -> DataFrame:
        """The query's result under its output names."""
        out = self.query(query)
        return out.df.toDF(*[f.name for f in out.fields])

    def relation(self, df: DataFrame, alias: str | None, names: Sequence[str], kinds: Sequence[str] | None = None) -> Relation:
        inner = [f"{n}#{next(self._ids)}" for n in names]
        kinds = kinds or [of_spark(f.dataType) for f in df.schema.fields]
        return Relation(df.toDF(*inner), [Field(alias, n, i, k) for n, i, k in zip(names, inner, kinds)])

    def source(self, s: Source) -> Relation:
        if s.query is not None:
            sub = self.query(s.query)
            return self.relation(sub.df, s.alias, [f.name for f in sub.fields], [f.kind for f in sub.fields])
        df = self.table(s.table)
        return self.relation(df, s.alias or s.table, df.columns)

    def query(self, q: Query) -> Relation:
        if isinstance(q.body, Select):
            return self.select(q.body, q.order, q.limit, q.offset)
        rel = self.union(q.body)
        if q.order:
            keys = []
            for o in q.order:
                col = self.positional(o.expr, rel)
                keys.append(sort_key(col if col is not None else self.expr(o.expr, Scope(rel.fields))[0], o.descending, o.nulls_first))
            rel = Relation(rel.df.orderBy(*keys), rel.fields)
        return Relation(page(rel.df, q.limit, q.offset), rel.fields)

    def union(self, u) -> Relation:
        if isinstance(u, Select):
            return self.select(u)
        left, right = self.union(u.left), self.union(u.right)
        if len(left.fields) != len(right.fields):
            raise AnalysisError("the branches of a UNION have different numbers of columns")
        kinds = [common(a.kind, b.kind) for a, b in zip(left.fields, right.fields)]
        sides = []
        for rel in (left, right):
            sides.append(rel.df.select(*[S.cast((self.inner(f), f.kind), k)[0].alias(f.inner) for f, k in zip(rel.fields, kinds)]))
        df = union(*sides, u.all_rows)
        return Relation(df, [Field(None, f.name, f.inner, k) for f, k in zip(left.fields, kinds)])

    @staticmethod
    def inner(f: Field) -> Column:
        return F.col(f"`{f.inner}`")

    def positional(self, expr, rel: Relation) -> Column | None:
        if isinstance(expr, Literal) and expr.kind == "INT":
            if not 1 <= expr.value <= len(rel.fields):
                raise AnalysisError(f"ORDER BY position {expr.value} is not in the select list")
            return self.inner(rel.fields[expr.value - 1])
        return None

    def select(self, s: Select, order: Sequence = (), limit: int | None = None, offset: int | None = None) -> Relation:
        rel = self.source(s.source) if s.source else Relation(self.spark.range(1).select(), [])
        for j in s.joins:
            right = self.source(j.right)
            both = rel.fields + right.fields
            on = self.condition(j.on, Scope(both), "ON") if j.on is not None else None
            rel = Relation(join(rel.df, right.df, j.how, on), both)
        if s.where is not None:
            if aggregates_in(s.where):
                raise AnalysisError("aggregates are not allowed in WHERE")
            rel = Relation(rel.df.where(self.condition(s.where, Scope(rel.fields), "WHERE")), rel.fields)
        scope = Scope(rel.fields)
        items = [i for item in s.items for i in self.expand(item, rel)]
        aggs = aggregates_in(tuple(i for i, _, _ in items), s.having, tuple(o.expr for o in order))
        df = rel.df
        if aggs or s.group:
            df, scope = self.grouping(s, rel, aggs)
        if s.having is not None:
            df = df.where(self.condition(s.having, scope, "HAVING"))
        out, outputs = [], []
        for k, (expr, alias, field) in enumerate(items):
            col, kind = self.expr(expr, scope)
            name = alias or (field.name if field else expr.column if isinstance(expr, Name) else f"agg_{aggs.index(expr)}" if isinstance(expr, Agg) else f"expr_{k}")
            outputs.append(Field(None, name, f"{name}#{next(self._ids)}", kind))
            out.append(col.alias(outputs[-1].inner))
        rel = Relation(df, outputs)
        keys, hidden = [], []
        for o in order:
            named = [f for f in outputs if isinstance(o.expr, Name) and o.expr.table is None and f.name == o.expr.column]
            same = [f for f, (e, _, _) in zip(outputs, items) if e == o.expr]
            key = self.positional(o.expr, rel)
            if key is None and (named or same):
                key = self.inner((named or same)[0])
            elif key is None:
                if s.distinct:
                    raise AnalysisError("with DISTINCT, ORDER BY takes what is selected")
                own = f"order#{next(self._ids)}"
                hidden.append(self.expr(o.expr, scope)[0].alias(own))
                key = F.col(f"`{own}`")
            keys.append(sort_key(key, o.descending, o.nulls_first))
        df = df.select(*out, *hidden)
        if s.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*keys)
        df = page(df, limit, offset)
        return Relation(df.select(*[self.inner(f) for f in outputs]) if hidden else df, outputs)

    def expand(self, item, rel: Relation):
        """(expression, alias, field) of each output that a select item stands for."""
        if not isinstance(item.expr, Star):
            return [(item.expr, item.alias, None)]
        fields = [f for f in rel.fields if item.expr.table in (None, f.table)]
        if not fields:
            raise AnalysisError("nothing for * to stand for")
        return [(f, None, f) for f in fields]

    def grouping(self, s: Select, rel: Relation, aggs: list[Agg]) -> tuple[DataFrame, Scope]:
        scope, bound, keys, cols = Scope(rel.fields), {}, [], []
        for k, e in enumerate(s.group):
            if aggregates_in(e):
                raise AnalysisError("aggregates are not allowed in GROUP BY")
            col, kind = self.expr(e, scope)
            keys.append(col.alias(f"group#{k}"))
            bound[scope.find(e) if isinstance(e, Name) else e] = F.col(f"`group#{k}`"), kind
        for k, a in enumerate(aggs):
            if a.arg is not None and aggregates_in(a.arg):
                raise AnalysisError("aggregates cannot be nested")
            arg = None if a.arg is None else self.expr(a.arg, scope)
            if arg and a.name in ("SUM", "AVG") and arg[1] not in (*NUMERIC, "BOOL", "NULL"):
                raise AnalysisError(f"{a.name} needs numbers")
            col, kind = aggregate(a.name, arg, a.distinct)
            cols.append(col.alias(f"agg#{k}"))
            bound[a] = F.col(f"`agg#{k}`"), kind
        return group(rel.df, keys, cols), Scope(rel.fields, bound, grouped=True)

    # -- expressions
    def condition(self, expr, scope: Scope, where: str) -> Column:
        return self.boolean(self.expr(expr, scope), where)

    def boolean(self, typed: S.Typed, where: str) -> Column:
        col, kind = typed
        if kind == "NULL":
            return col.cast("boolean")
        if kind != "BOOL":
            if not self.strict and kind in NUMERIC:
                return col != 0
            raise AnalysisError(f"{where} needs a boolean, not {kind}")
        return col

    def expr(self, e, scope: Scope) -> S.Typed:
        if e in scope.bound:
            return scope.bound[e]
        if isinstance(e, (Name, Field)):
            f = e if isinstance(e, Field) else scope.find(e)
            if scope.grouped:
                if f not in scope.bound:
                    raise AnalysisError(f"column '{f.name}' must be in GROUP BY or in an aggregate")
                return scope.bound[f]
            return self.inner(f), f.kind
        return getattr(self, f"on_{type(e).__name__.lower()}")(e, scope)

    def on_literal(self, e: Literal, scope) -> S.Typed:
        if e.kind == "NULL":
            return F.lit(None), "NULL"
        return F.lit(e.value).cast(SPARK[e.kind]), e.kind

    def on_param(self, e: Param, scope) -> S.Typed:
        if e.index >= len(self.params):
            raise AnalysisError(f"parameter {e.index + 1} has no value")
        value = self.params[e.index]
        if isinstance(value, Literal):
            return self.on_literal(value, scope)
        kind = "NULL" if value is None else "BOOL" if isinstance(value, bool) else ("INT" if -(2**31) <= value < 2**31 else "BIGINT") if isinstance(value, int) else "DOUBLE" if isinstance(value, float) else "VARCHAR"
        return self.on_literal(Literal(value, kind), scope)

    def on_agg(self, e: Agg, scope):
        raise AnalysisError(f"{e.name} is not allowed here")

    def on_star(self, e: Star, scope):
        raise AnalysisError("* is not allowed here")

    def on_unary(self, e: Unary, scope) -> S.Typed:
        x = self.expr(e.arg, scope)
        if e.op == "NOT":
            return ~self.boolean(x, "NOT"), "BOOL"
        if e.op == "ISNULL":
            return x[0].isNull(), "BOOL"
        if e.op == "NOTNULL":
            return x[0].isNotNull(), "BOOL"
        self.numeric(x, "-")
        return S.negate(x)

    def numeric(self, x: S.Typed, op: str) -> None:
        if x[1] not in (*NUMERIC, "NULL"):
            raise AnalysisError(f"{op} needs numbers, not {x[1]}")

    def on_binary(self, e: Binary, scope) -> S.Typed:
        a, b = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("AND", "OR"):
            x, y = self.boolean(a, e.op), self.boolean(b, e.op)
            return (x & y if e.op == "AND" else x | y), "BOOL"
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return S.compare(e.op, a, b)
        if e.op == "+" and not self.strict and "VARCHAR" in (a[1], b[1]):
            return F.concat(S.cast(a, "VARCHAR")[0], S.cast(b, "VARCHAR")[0]), "VARCHAR"
        for x in (a, b):
            self.numeric(x, e.op)
        if e.op == "/":
            return S.divide(a, b)
        return S.modulo(a, b) if e.op == "%" else S.arithmetic(e.op, a, b)

    def on_like(self, e: Like, scope) -> S.Typed:
        x, p = self.expr(e.arg, scope), e.pattern
        if isinstance(p, Param):
            p = Literal(self.params[p.index], "VARCHAR")
        if not isinstance(p, Literal):
            # a pattern from data: escape the escape character row by row
            col = F.call_function("like", x[0], F.replace(self.expr(p, scope)[0], F.lit("\\"), F.lit("\\\\")))
        elif p.value is None:
            col = F.lit(None).cast("boolean")
        else:
            col = S.like(S.cast(x, "VARCHAR")[0], str(p.value))
        return (~col if e.negated else col), "BOOL"

    def on_inlist(self, e: InList, scope) -> S.Typed:
        x, out = self.expr(e.arg, scope), None
        for item in e.items:
            one = S.compare("=", x, self.expr(item, scope))[0]
            out = one if out is None else out | one
        return (~out if e.negated else out), "BOOL"

    def on_inquery(self, e: InQuery, scope) -> S.Typed:
        x, sub = self.expr(e.arg, scope), self.query(e.query)
        f = sub.fields[0]
        kind = common(x[1], f.kind)
        rows = sub.df.select(S.cast((self.inner(f), f.kind), kind)[0].alias("value"))
        col = S.cast(x, kind)[0].isin(rows)
        return (~col if e.negated else col), "BOOL"

    def on_scalar(self, e: Scalar, scope) -> S.Typed:
        sub = self.query(e.query)
        return sub.df.select(self.inner(sub.fields[0])).scalar(), sub.fields[0].kind

    def on_case(self, e: Case, scope) -> S.Typed:
        values = [self.expr(v, scope) for _, v in e.branches] + [self.expr(e.otherwise, scope) if e.otherwise is not None else (F.lit(None), "NULL")]
        kind = values[0][1]
        for v in values[1:]:
            kind = common(kind, v[1])
        out = F
        for (w, _), v in zip(e.branches, values):
            out = out.when(self.condition(w, scope, "CASE WHEN"), S.cast(v, kind)[0])
        return out.otherwise(S.cast(values[-1], kind)[0]), kind

    def on_cast(self, e: Cast, scope) -> S.Typed:
        return S.cast(self.expr(e.arg, scope), e.kind)

    def on_call(self, e: Call, scope) -> S.Typed:
        args = [self.expr(a, scope) for a in e.args]
        if e.name == "LENGTH":
            if args[0][1] not in ("VARCHAR", "NULL"):
                raise AnalysisError("LENGTH needs text")
            return S.length(args[0][0].cast("string"))
        return S.nullif(*args) if e.name == "NULLIF" else S.coalesce(*args)
