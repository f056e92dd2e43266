"""Sharding by fixed virtual slots, with column expressions and SQL only (operator 3).

Records are hashed into ``SLOTS`` slots whose number never changes. Rows and bytes are summed by
slot; a map assigns slots to shards. A first map deals slots out in turn. Rebalancing edits it, heaviest
slots first: a slot stays where it is as long as its shard keeps within the mean; those that do not
fit then move to the shard that has the least so far. Maps are stored as Parquet, one folder a version, so that readers of
an older version stay consistent.

Slots are hashed from ``doc_id``. Rows without one, and all rows of a crowded slot (several rows of
together over 1/1024 of all bytes: an id that is very often repeated), are hashed from an ordinal of
their own, so that no key's rows are stuck to one shard. Ordinals are stored with the rows before any
of this is decided.

A row's place in its shard is the number of rows in the shard's earlier parts of slots plus its place
in its part, so that no task has to sort a shard or a slot.

Defined results: a null text has size 1; rows with a null or repeated ``doc_id`` have slots and places
of their own, as have repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import documents, fresh_path, stored, text_or_empty, unused

SLOTS, SHARDS = 4096, 16
#: A slot of several rows over this share of all bytes is crowded; so there are fewer of them than this.
CROWDED = 1024
#: Parts of a slot in which rows are numbered.
PARTS = 16
MAP = "version int, virtual_slot int, shard int, n_rows long, n_bytes long"


def slot_of(key: Column, otherwise: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.lit("ordinal"), otherwise)).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def slotted(rows: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``rows`` (narrow ones, with ``size``), written with an ``ordinal`` each, and their ``virtual_slot``."""
    rows = stored(rows.withColumn("ordinal", F.monotonically_increasing_id()), "op3-rows")
    rows = rows.withColumn("virtual_slot", slot_of(F.col(key), F.col("ordinal"), slots))
    loads = stored(slot_loads(rows), "op3-loads")
    total = loads.agg(F.sum("n_bytes")).first()[0] or 0
    crowded = loads.where((F.col("n_rows") > 1) & (F.col("n_bytes") * CROWDED > total)).select("virtual_slot", F.lit(True).alias("crowded"))
    spread = F.when(F.col("crowded"), slot_of(F.lit(None), F.col("ordinal"), slots)).otherwise(F.col("virtual_slot"))
    return rows.join(F.broadcast(crowded), "virtual_slot", "left").withColumn("virtual_slot", spread).drop("crowded")


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots are dealt out in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(0).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_bytes"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for ``loads`` (``virtual_slot, n_rows, n_bytes``).

    The slots, of a fixed number, are folded in one row; shards may have become more or fewer: slots
    of a shard that is gone always move.
    """
    rows = old.select("version", "virtual_slot", "shard").join(F.broadcast(loads), "virtual_slot", "left").na.fill(0, ["n_rows", "n_bytes"])
    entry = F.struct(F.col("n_bytes"), F.col("virtual_slot"), F.col("shard"), F.col("n_rows"))
    folded = rows.agg(F.sort_array(F.collect_list(entry), asc=False).alias("slots"), F.sum("n_bytes").alias("total"), F.max("version").alias("version"))
    mean = F.col("total") / shards
    added = lambda loads, at, n: F.transform(loads, lambda x, i: F.when(i == at, x + n).otherwise(x))
    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def stay(acc: Column, x: Column) -> Column:
        """First the slots that stay, so that no slot that comes takes their place."""
        fits = (x.shard < shards) & (F.get(acc.loads, x.shard) + x.n_bytes <= mean)
        to = F.when(fits, x.shard).otherwise(F.lit(-1))
        return F.struct(added(acc.loads, to, x.n_bytes).alias("loads"), F.concat(acc.to, F.array(to)).alias("to"))

    def move(acc: Column, x: Column) -> Column:
        least = (F.array_position(acc.loads, F.array_min(acc.loads)) - 1).cast("int")
        to = F.when(x.to >= 0, x.to).otherwise(least)
        return F.struct(F.when(x.to >= 0, acc.loads).otherwise(added(acc.loads, to, x.n_bytes)).alias("loads"), F.concat(acc.to, F.array(to)).alias("to"))

    stayed = folded.select("version", "slots", F.aggregate("slots", begin, stay).alias("first"))
    pairs = F.zip_with("slots", "first.to", lambda s, t: F.struct(s.n_bytes.alias("n_bytes"), t.alias("to")))
    after = F.struct(F.col("first.loads").alias("loads"), F.array().cast("array<int>").alias("to"))
    moved = stayed.select("version", "slots", F.aggregate(pairs, after, move, lambda acc: acc.to).alias("to"))
    flat = moved.select((F.col("version") + 1).alias("version"), F.explode(F.zip_with("slots", "to", lambda s, t: F.struct(s.virtual_slot.alias("virtual_slot"), t.alias("shard"), s.n_rows.alias("n_rows"), s.n_bytes.alias("n_bytes")))).alias("m"))
    return flat.select("version", "m.*")


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of a map; stored versions are never changed."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def place(rows: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``virtual_slot``) with ``shard``, ``map_version`` and ``slot``, the place in the
    shard, gapless from 0. Parts of slots, of a fixed number, are broadcast with the rows before them."""
    part, n, first, rank = (unused(rows, k) for k in ("part", "n", "first", "rank"))
    parted = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", part).rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("virtual_slot", part).agg(F.count("*").alias(n)).join(F.broadcast(slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"))), "virtual_slot")
    offsets = counts.select("virtual_slot", part, "shard", "map_version", F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("virtual_slot", part).orderBy(*order)
    placed = parted.withColumn(rank, F.row_number().over(within)).join(F.broadcast(offsets), ["virtual_slot", part])
    return placed.withColumn("slot", (F.col(first) + F.col(rank) - 1).cast("long")).drop(first, rank, part)


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = slotted(documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    path = fresh_path(spark, "op3-map")
    save_map(first_map(spark), path, 0)
    save_map(rebalanced(load_map(spark, path, 0), slot_loads(rows)), path, 1)
    placed = place(rows, load_map(spark, path, 1), ["doc_id", "text_crc32", "size", "ordinal"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
