"""Equi-joins under a chosen strategy; all give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strategies by name, and the hint that asks for each. ``index`` broadcasts the left side, whose rows
#: would look up the right one's; ``built`` and ``sorted``, which the plan search chooses, ask for a hash table
#: (broadcast where it is small) and for sorting (where neither side is small); ``bitmap`` has no hint.
HINTS = {"nested_loops": "shuffle_replicate_nl", "merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast"}
#: A side is broadcast, or a partition of it built into a hash table, only if it is at most so large.
BROADCAST_BYTES = 64 << 20
#: Largest product of both sides' sizes that nested loops take.
LOOPS_BYTES = 1 << 40


def hinted(left: DataFrame, right: DataFrame, strategy: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the strategy's hint, by the optimizer's sizes: a side that a strategy can't take
    at its size is sorted and merged instead."""
    if strategy == "index":
        return (left.hint("broadcast") if size_of(left) <= BROADCAST_BYTES else left), right
    if strategy == "built":
        strategy = "broadcast" if size_of(right) <= BROADCAST_BYTES else "hash"
    elif strategy == "sorted":
        strategy = "merge" if min(size_of(left), size_of(right)) > BROADCAST_BYTES else None
    if strategy not in HINTS:
        return left, right
    if strategy == "broadcast" and size_of(right) > BROADCAST_BYTES:
        strategy = "merge"
    elif strategy == "hash" and size_of(right) > BROADCAST_BYTES * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        strategy = "merge"
    elif strategy == "nested_loops" and size_of(left) * size_of(right) > LOOPS_BYTES:
        strategy = "merge"
    return left, right.hint(HINTS[strategy])


def equi_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], strategy: str | None = None) -> DataFrame:
    """Inner join on column pairs, in a chosen way where sizes allow it (see ``hinted``)."""
    left, right = hinted(left, right, strategy)
    return left.join(right, _all_equal(pairs), "inner")


def semi_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` with a partner: what a join bitmap over a selected, keyed right side gives."""
    return left.join(right, _all_equal(pairs), "left_semi")


def _all_equal(pairs: list[tuple[str, str]]):
    return reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in pairs))


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
