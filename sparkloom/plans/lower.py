"""Algebra to DataFrames. Catalyst does the rest: pushdown, pruning, join order and strategy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import equi_join, semi_join
from sparkloom.plans.algebra import Aggregate, Attr, Compare, Distinct, EquiJoin, Get, Logic, OrderBy, Project, Select, inputs


def operand(x) -> Column:
    return F.col(x.name) if isinstance(x, Attr) else F.lit(x.value)


def predicate(p) -> Column:
    if isinstance(p, Logic):
        args = [predicate(a) for a in p.args]
        if p.op == "NOT":
            return ~args[0]
        return reduce((lambda a, b: a & b) if p.op == "AND" else (lambda a, b: a | b), args)
    if p.op == "IN":
        values = p.right.value if isinstance(p.right.value, tuple) else (p.right.value,)
        return operand(p.left).isin(*values)
    left = operand(p.left)
    if p.op == "LIKE":
        return left.like(p.right.value)
    right = operand(p.right)
    return {"EQ": left == right, "NEQ": left != right, "LT": left < right, "LE": left <= right, "GT": left > right, "GE": left >= right}[p.op]


def _short(name: str) -> str:
    return name.split(".")[-1]


def _grouped(node) -> bool:
    """Whether columns come from an aggregation, which gives them short names."""
    return isinstance(node, Aggregate) or (isinstance(node, Select | Project | Distinct | OrderBy) and _grouped(node.child))


def lower(node, table: Callable[[str], DataFrame]) -> DataFrame:
    """DataFrame of ``node``; ``table`` gives stored tables by name."""
    if isinstance(node, Get):
        df = table(node.table)
        return df.alias(node.alias) if node.alias else df
    if isinstance(node, Select):
        return lower(node.child, table).where(predicate(node.predicate))
    if isinstance(node, Project):
        return lower(node.child, table).select(*map(_short, node.columns) if _grouped(node.child) else node.columns)
    if isinstance(node, Distinct):
        return lower(node.child, table).distinct()
    if isinstance(node, OrderBy):
        named = _short if _grouped(node.child) else str
        return lower(node.child, table).orderBy(*(F.col(named(c)).asc_nulls_first() if up else F.col(named(c)).desc_nulls_last() for c, up in node.keys))
    if isinstance(node, EquiJoin):
        left, right = lower(node.left, table), lower(node.right, table)
        if not node.left_keys:
            return left.crossJoin(right)
        pairs = list(zip(node.left_keys, node.right_keys, strict=True))
        return semi_join(left, right, pairs) if node.strategy == "semi" else equi_join(left, right, pairs, node.strategy)
    if isinstance(node, Aggregate):
        functions = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
        value = lambda a: reduce(lambda x, y: x + y, map(F.col, inputs(a))) if a.column else F.lit(1)
        aggs = [functions[a.function](value(a)).alias(a.name) for a in node.aggregates]
        return lower(node.child, table).groupBy(*(F.col(g).alias(_short(g)) for g in node.groups)).agg(*aggs)
    if isinstance(node, Compare):
        raise TypeError("a predicate is no relation")
    raise TypeError(f"no relation: {node!r}")
