"""Syntax tree of statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Param:
    index: int


@dataclass(frozen=True)
class Unary:
    op: str  # - NOT ISNULL NOTNULL
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str  # OR AND = != < <= > >= + - * / %
    left: Any
    right: Any


@dataclass(frozen=True)
class Like:
    arg: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: "Query"
    negated: bool


@dataclass(frozen=True)
class Case:
    branches: tuple
    otherwise: Any


@dataclass(frozen=True)
class Cast:
    arg: Any
    kind: str


@dataclass(frozen=True)
class Call:
    name: str  # COALESCE NULLIF LENGTH
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any  # None: COUNT(*)
    distinct: bool = False


@dataclass(frozen=True)
class Scalar:
    query: "Query"


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str | None
    query: "Query | None"
    alias: str | None


@dataclass(frozen=True)
class Join:
    how: str
    right: Source
    on: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool
    nulls_first: bool | None


@dataclass(frozen=True)
class Select:
    items: tuple
    distinct: bool = False
    source: Source | None = None
    joins: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any
    all_rows: bool


@dataclass(frozen=True)
class Query:
    body: Any  # Select or Union
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None


@dataclass
class ColumnDef:
    name: str
    kind: str
    varchar_length: int | None = None
    not_null: bool = False
    primary: bool = False
    unique: bool = False
    default: Any = None
    check: str | None = None


@dataclass
class Statement:
    """Anything but a query: ``verb`` and its parts by name."""

    verb: str
    parts: dict = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return self.parts.get(key)
