"""Tables as Parquet: reading, bulk loading, named and temporary tables, stored statistics."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from sparkloom.catalog import Catalog, ForeignKey
from sparkloom.sources.shared import delete, fresh_path, shared_dir

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Keys that hold in these tables, and references between them. Lineitem has no key.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",)}
FOREIGN = {
    "nation": (ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),),
    "customer": (ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
    "supplier": (ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
    "orders": (ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
    "lineitem": (ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "part", ("p_partkey",)), ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def bulk_load(df: DataFrame, path: str) -> int:
    """Write all rows; the number of rows written is read from the files' footers."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


class Files:
    """Named and temporary tables in a folder: created from a DataFrame, opened by name, dropped.

    A temporary table has no name; it goes when it is dropped or with its session's ``close``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or fresh_path(spark, "tables")
        self.temporary: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def create(self, name: str, rows: DataFrame) -> DataFrame:
        """A name that is taken is an error, as is a reader of a half-written table: files appear on success only."""
        rows.write.mode("errorifexists").parquet(self.path(name))
        return self.open(name)

    def open(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def temp(self, rows: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "temporary")
        rows.write.parquet(path)
        self.temporary.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, name: str) -> None:
        if not delete(self.spark, self.path(name)):
            raise ValueError(f"no table {name}")

    def close(self) -> None:
        while self.temporary:
            delete(self.spark, self.temporary.pop())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files; changes with its contents."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in [fs.getFileStatus(where), *(fs.listStatus(where) if fs.getFileStatus(where).isDirectory() else [])])
    return sha256(repr(files).encode()).hexdigest()


#: Stored statistics that this process has read or written, by their place.
_read: dict[str, dict] = {}


def analyze(spark: SparkSession, sf_dir: str, name: str) -> Catalog:
    """Statistics and checked keys of a table, stored under its files' fingerprint: computed once for
    these files, and read back by every later plan."""
    at = f"{shared_dir(spark)}/statistics/{name}-{fingerprint(spark, f'{sf_dir}/{name}.parquet')}"
    if at in _read:
        return Catalog.from_plain(_read[at])
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")  # there once all is written
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        _read[at] = json.loads("\n".join(r.value for r in spark.read.text(at, wholetext=True).collect()))
        return Catalog.from_plain(_read[at])
    found = Catalog()
    found.describe(name, table(spark, sf_dir, name), (KEYS[name],) if name in KEYS else (), FOREIGN.get(name, ()))
    text = json.dumps(found.to_plain())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("ignore").text(at)
    _read[at] = json.loads(text)
    return found


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    out = Catalog()
    for name in names or NAMES:
        out.tables |= analyze(spark, sf_dir, name).tables
    return out
