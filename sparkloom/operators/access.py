"""Keyed and ordered access, and data changes as functions from a table to a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.joins import size_of
from sparkloom.sources.shared import stored


def lookup(df: DataFrame, **key) -> DataFrame:
    """Rows with the given key values; comparisons reach the Parquet reader as pushed filters."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def range_from(df: DataFrame, column: str, low, high=None) -> DataFrame:
    out = df.where(F.col(column) >= F.lit(low))
    return out if high is None else out.where(F.col(column) <= F.lit(high))


def members(df: DataFrame, column: str, probe: DataFrame, probe_column: str) -> DataFrame:
    """Rows of ``probe`` whose value is in the set of ``column``'s values."""
    inside = unused(probe, "in")
    return probe.join(df.select(F.col(column).alias(inside)), F.col(probe_column) == F.col(inside), "left_semi")


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once: what a unique index would refuse."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with ``rows``; columns that ``rows`` lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def update(df: DataFrame, where: Column, **to: Column) -> DataFrame:
    """``df`` with new values where the condition is true; all new values see the old row."""
    return df.select(*(F.when(where, to[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in to else F.col(c) for c in df.columns))


def update_in(df: DataFrame, column: str, keys: DataFrame, key: str, **to: Column) -> DataFrame:
    """``update`` of the rows whose ``column`` is among ``keys``."""
    wanted, hit = unused(df, "key"), unused(df, "hit")
    flag = keys.select(F.col(key).alias(wanted)).distinct().withColumn(hit, F.lit(True))
    marked = df.join(flag, F.col(column) == F.col(wanted), "left")
    return update(marked, F.col(hit), **to).select(*df.columns)


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true (false or unknown)."""
    return df.where(~F.coalesce(where, F.lit(False)))


#: Bytes of a partition that is sorted by one task, at about.
SORT_BYTES = 64 << 20


def ranked(df: DataFrame, keys: list[tuple[str, bool]], out: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in the order of ``keys`` (column, ascending). Nulls come
    first where a key rises and last where it falls; rows alike in all keys keep the order they had.

    Rows are dealt by ranges of all keys and, within rows alike in these, by an ordinal, so that a
    frequent value is many partitions; each is sorted and written by its task, and its rows' numbers
    follow from the sizes of the partitions before it. Only these sizes are gathered.
    """
    spark = df.sparkSession
    if partitions is None:
        size, cores = size_of(df), spark.sparkContext.defaultParallelism
        known = size < 1 << 60  # else the optimizer has no idea
        partitions = max(1, -(-size // SORT_BYTES), min(cores, -(-size // (1 << 20)))) if known else int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, at, n, start = (unused(df, k) for k in ("tie", "at", "n", "start"))
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys] + [F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # The number of a row within its partition is in the lower 33 bits.
    rows = stored(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranked")
    sizes = rows.groupBy(F.shiftright(at, 33).alias(n)).agg(F.count("*").alias(start))
    before = sizes.select(n, F.coalesce(F.sum(start).over(Window.orderBy(n).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    placed = rows.withColumn(n, F.shiftright(at, 33)).join(F.broadcast(before), n)
    return placed.withColumn(out, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, out)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name
