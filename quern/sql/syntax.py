"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Name(Expr):
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Literal(Expr):
    """``kind`` is int, float, text, null or bool."""

    kind: str
    value: str


@dataclass(frozen=True)
class Prefix(Expr):
    """``-`` or NOT."""

    op: str
    arg: Expr


@dataclass(frozen=True)
class Infix(Expr):
    """Arithmetic, comparison, LIKE, AND and OR."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    arg: Expr
    query: "Query"
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: "Query"


@dataclass(frozen=True)
class Quantified(Expr):
    """``left op ANY (query)`` or ``ALL``."""

    op: str
    left: Expr
    quantifier: str
    query: "Query"


@dataclass(frozen=True)
class Scalar(Expr):
    query: "Query"


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr
    distinct: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    kind: str


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Item:
    """An entry of a select list."""

    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Source:
    """Anything in FROM."""


@dataclass(frozen=True)
class TableRef(Source):
    name: str
    alias: str


@dataclass(frozen=True)
class Derived(Source):
    query: "Query"
    alias: str


@dataclass(frozen=True)
class Join(Source):
    """``kind`` is inner, left, right or full."""

    kind: str
    left: Source
    right: Source
    on: Expr


@dataclass(frozen=True)
class Block:
    """One SELECT."""

    items: tuple[Item, ...]
    sources: tuple[Source, ...]
    where: Expr | None = None
    groups: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()
    distinct: bool = False
    top: int | None = None


@dataclass(frozen=True)
class SetOp:
    """``op`` is UNION, UNION ALL, INTERSECT or EXCEPT; chains lean left."""

    op: str
    left: "Body"
    right: "Body"


Body = Block | SetOp


@dataclass(frozen=True)
class Query:
    body: Body
    ctes: tuple[tuple[str, "Query"], ...] = ()


@dataclass(frozen=True)
class CatalogTable:
    name: str
    options: tuple[tuple[str, str | int], ...] = field(default=())


@dataclass(frozen=True)
class DescribeTable:
    name: str


@dataclass(frozen=True)
class SetOption:
    name: str
    value: str | int


Statement = CatalogTable | DescribeTable | SetOption | Query
