"""Tables stored by the hash of a key, so that a lookup reads one bucket's files only.

Buckets are folders that the reader prunes by their number. Three ways to number them: ``static``, a
fixed count; ``extendible``, by as many low bits of the hash as a bucket needs so as to keep to its
capacity, looked up in a directory; ``linear``, a count that follows the rows one bucket at a time,
where those before the split pointer have one bit more. Rows alike in the key are in one bucket, which
may then be over its capacity.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.hashing import tuple_hash
from sparkloom.operators.access import unused

KINDS = ("static", "extendible", "linear")
#: Most bits of an extendible directory: its size is bounded, and so is what is counted for it.
DEPTH = 12


@dataclass(frozen=True)
class HashFile:
    """A stored table and what is needed to find a key's bucket."""

    path: str
    key: tuple[str, ...]
    kind: str
    buckets: int
    #: Bucket of each value of the low bits (extendible).
    directory: tuple[int, ...] = ()

    def address(self, values: list[Column]) -> Column:
        h = tuple_hash(*values)
        if self.kind == "static":
            return F.pmod(h, F.lit(self.buckets)).cast("int")
        if self.kind == "extendible":
            return F.element_at(F.array(*map(F.lit, self.directory)), F.pmod(h, F.lit(len(self.directory))).cast("int") + 1)
        level = 1 << (self.buckets.bit_length() - 1)
        low = F.pmod(h, F.lit(level))
        return F.when(low < self.buckets - level, F.pmod(h, F.lit(2 * level))).otherwise(low).cast("int")

    def scan(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket__")

    def lookup(self, spark: SparkSession, *values) -> DataFrame:
        """Rows with the key: the bucket's number is a constant, so other buckets' files are not opened."""
        df = spark.read.parquet(self.path)
        typed = [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(self.key, values, strict=True)]
        found = df.where(F.col("bucket__") == self.address(typed))
        for k, v in zip(self.key, typed, strict=True):
            found = found.where(F.col(k) == v)
        return found.drop("bucket__")

    def save(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(f"{self.path}-directory")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashFile:
        plain = json.loads(spark.read.text(f"{path}-directory").first().value)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in plain.items()})


def store(df: DataFrame, path: str, key: list[str], kind: str = "static", buckets: int = 16, capacity: int = 1_000_000) -> HashFile:
    """Write ``df`` by the hash of ``key``. ``buckets`` counts for static files, ``capacity`` (rows of a
    bucket) for the others."""
    if kind not in KINDS:
        raise ValueError(f"no kind of hash file {kind}")
    if kind == "linear":
        out = HashFile(path, tuple(key), kind, max(1, -(-df.count() // capacity)))
    elif kind == "extendible":
        directory = _directory(df, key, capacity)
        out = HashFile(path, tuple(key), kind, len(set(directory)), directory)
    else:
        out = HashFile(path, tuple(key), kind, buckets)
    if "bucket__" in {c.lower() for c in df.columns}:
        raise ValueError("a column is named bucket__")
    placed = df.withColumn("bucket__", out.address([F.col(k) for k in key]))
    # One task a bucket; a large bucket is several files where rows of it are too many for one.
    placed.repartition(min(out.buckets, 2000), "bucket__").write.option("maxRecordsPerFile", 10_000_000).partitionBy("bucket__").parquet(path)
    out.save(df.sparkSession)
    return out


def _directory(df: DataFrame, key: list[str], capacity: int) -> tuple[int, ...]:
    """Buckets are halved by one more bit while they are over capacity; the directory has as many
    entries as the deepest bucket needs."""
    low = unused(df, "low")
    counted = df.select(F.pmod(tuple_hash(*map(F.col, key)), F.lit(1 << DEPTH)).cast("int").alias(low)).groupBy(low).count()
    rows = {r[0]: r[1] for r in counted.collect()}  # at most 2^DEPTH
    found: list[tuple[int, int]] = []  # low bits, how many
    open_ = [(0, 0)]
    while open_:
        bits, depth = open_.pop()
        held = sum(rows.get(k, 0) for k in range(bits, 1 << DEPTH, 1 << depth))
        if held > capacity and depth < DEPTH:
            open_ += [(bits, depth + 1), (bits | 1 << depth, depth + 1)]
        else:
            found.append((bits, depth))
    deepest = max(d for _, d in found)
    out = [0] * (1 << deepest)
    for number, (bits, depth) in enumerate(sorted(found)):
        for k in range(bits, 1 << deepest, 1 << depth):
            out[k] = number
    return tuple(out)
