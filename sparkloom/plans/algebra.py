"""Logical algebra: frozen nodes, compared by value."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Attr:
    name: str  # column, or alias.column


@dataclass(frozen=True)
class Const:
    value: int | float | str | date | tuple


@dataclass(frozen=True)
class Compare:
    """``op`` is one of EQ NEQ LT LE GT GE LIKE IN."""

    op: str
    left: Attr | Const
    right: Attr | Const
    selectivity: float | None = None


@dataclass(frozen=True)
class Logic:
    op: str  # AND OR NOT
    args: tuple


@dataclass(frozen=True)
class Get:
    table: str
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    child: object
    predicate: object


@dataclass(frozen=True)
class Project:
    child: object
    columns: tuple[str, ...]


@dataclass(frozen=True)
class EquiJoin:
    left: object
    right: object
    left_keys: tuple[str, ...] = ()
    right_keys: tuple[str, ...] = ()
    strategy: str | None = None


@dataclass(frozen=True)
class Distinct:
    child: object


@dataclass(frozen=True)
class Agg:
    function: str  # SUM AVG MIN MAX COUNT
    column: str | tuple[str, ...] | None  # several columns are added up by row
    name: str


@dataclass(frozen=True)
class Aggregate:
    child: object
    groups: tuple[str, ...]
    aggregates: tuple[Agg, ...]

    def __post_init__(self):
        if not self.aggregates:
            raise ValueError("an aggregation has at least one aggregate")
        if any(a.column is None and a.function != "COUNT" for a in self.aggregates):
            raise ValueError("only COUNT goes without a column")


@dataclass(frozen=True)
class OrderBy:
    child: object
    keys: tuple[tuple[str, bool], ...]  # column, ascending


def inputs(aggregate: Agg) -> tuple[str, ...]:
    """Columns that an aggregate reads."""
    column = aggregate.column
    return column if isinstance(column, tuple) else (column,) if column else ()


def children(node) -> list:
    if isinstance(node, EquiJoin):
        return [node.left, node.right]
    return [] if isinstance(node, Get) else [node.child]


def columns_of(predicate) -> set[str]:
    if isinstance(predicate, Logic):
        return set().union(*map(columns_of, predicate.args))
    return {x.name for x in (predicate.left, predicate.right) if isinstance(x, Attr)}
