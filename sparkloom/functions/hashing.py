"""Hashes of tuples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_hash(*columns: Column) -> Column:
    """64-bit hash of the columns' values in order. Equal tuples of the same types have equal hashes; a
    null leaves the hash of those before it as it is, so it is marked."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return F.xxhash64(*parts)
