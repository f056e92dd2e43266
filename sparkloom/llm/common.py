"""Shared helpers of the training-data operators: reading, materialising, Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.access import unused
from sparkloom.sources.shared import discard, fresh_path, scratch, shared_dir, stored

__all__ = ["arrow_types", "discard", "documents", "fresh_path", "in_arrow", "map_arrow", "scratch", "shared_dir", "small_batches", "stored", "text_or_empty", "unused"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch at most: texts are long, and the JVM holds some batches outside of its heap.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches, which this sets for the session if it has larger ones. A worker
    gives the memory that it no longer uses back to the system after each task, before it waits for the next."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, names: list[str], rows: int = 512) -> DataFrame:
    """Apply ``fn`` to blocks of at most ``rows`` rows, given and returned as columns of Python lists.

    Blocks are small so that a few very long texts don't pile up in a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in types], names=[k for k, _ in types])

    types = arrow_types(schema)
    return in_arrow(df.select(*names), run, schema)


ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    """``"a long, b string"`` as pairs of name and Arrow type."""
    return [(n, ARROW[t]) for n, t in (part.split() for part in schema.split(","))]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
