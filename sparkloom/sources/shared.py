"""Materialising in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine
    (local mode, tests) a temporary folder is taken, which is then also set as checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "sparkloom-shared"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that ``stored`` has written in this process and that are not removed yet.
_written: dict[str, None] = {}


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and every
    executor can read the files, also after another one is lost. ``options`` are the writer's."""
    path = fresh_path(df.sparkSession, name)
    _written[path] = None
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``stored`` that nothing reads any more."""
    for table in tables:
        _written.pop(table.stored_at, None)
        delete(table.sparkSession, table.stored_at)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Tables stored inside go at the end, but for those that are in ``keep`` by then. To be left only
    when what was built from them is stored itself."""
    before = set(_written)
    yield
    kept = {k.stored_at for k in keep}
    for path in [p for p in _written if p not in before and p not in kept]:
        del _written[path]
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder of any file system that Spark reaches; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
