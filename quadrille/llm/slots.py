"""Sharding by fixed virtual slots, in DataFrame operations only.

Every record hashes into one of SLOTS virtual slots, for good. Bytes are summed by slot, and a slot map says which shard
holds each slot. The map is a table (version, slot, shard, bytes, n_rows) that is stored by version; rebalancing writes
a new version that moves whole slots and never rehashes a record.

First map: slots in order of falling size go to the shard with the fewest bytes so far, so shards differ by about
one small slot. Adding a shard moves slots only into the new one. The map has SLOTS rows whatever the data, so it is the one
thing here that is broadcast.

A record hashes by its id and text, so that neither rows without an id nor those that repeat one meet in a slot.

Defined results: a null text has size 1 and the CRC of no bytes (0), and a null id counts as the empty string; repeated
rows are in one slot and keep a place each; an empty table gives no rows, and its map has only empty slots; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir, table

SLOTS = 4096
SHARDS = 16
#: A slot's rows are numbered in so many parts, so that no part grows past a share of the slot.
PARTS = 8


def virtual_slot(id_col: str, text, slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), F.lit(slots)).cast("int")


def part_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of every part of a slot, SLOTS * PARTS rows at most; stored, as both the map and the places need it."""
    return materialize(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), "parts")


def slot_sizes(parts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, those without rows included."""
    sums = parts.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
    every = parts.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: largest slot first, each to the shard with the fewest bytes (then rows, then number)."""
    slots = F.sort_array(F.collect_list(F.struct(F.col("bytes"), F.col("n_rows"), F.col("virtual_slot"))), asc=False)
    start = F.struct(F.array(*(F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(i).alias("s")) for i in range(shards))).alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(state, slot):
        least = F.array_min(state["loads"])
        after = F.transform(state["loads"], lambda x: F.when(x["s"] == least["s"], F.struct((x["b"] + slot["bytes"]).alias("b"), (x["n"] + slot["n_rows"]).alias("n"), x["s"].alias("s"))).otherwise(x))
        return F.struct(after.alias("loads"), F.concat(state["to"], F.array(least["s"])).alias("to"))

    one = sizes.agg(slots.alias("slots")).select("slots", F.aggregate("slots", start, place)["to"].alias("to"))
    placed = one.select(F.explode(F.arrays_zip("slots", "to")).alias("x"))
    return placed.select(F.lit(1).alias("version"), F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.n_rows").alias("n_rows"))


def add_shard(current: DataFrame) -> DataFrame:
    """The next version with one more shard: each old shard gives its smallest slots, in order, until it has given a
    share of 1/(new count) of its bytes; no other slot moves. The one window is over the map's fixed number of rows by shard."""
    w = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    totals = Window.partitionBy("shard")
    new = current.agg((F.max("shard") + 1).alias("new_shard"))
    run = current.withColumn("so_far", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("bytes").over(totals))
    moves = (F.col("bytes") > 0) & (F.col("so_far") * (F.col("new_shard") + 1) <= F.col("total"))
    return run.join(F.broadcast(new), F.lit(True)).select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moves, F.col("new_shard")).otherwise(F.col("shard")).alias("shard"), "bytes", "n_rows")


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Append a version to the stored map and return that version as read back."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(slot_map.sparkSession, path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    every = spark.read.schema("virtual_slot int, shard int, bytes long, n_rows long, version int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(version))


def place_rows(rows: DataFrame, parts: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Add shard and slot, the row's place in its shard, gapless from 0.

    Places come from counts: a row's number in its part of a virtual slot, plus the rows of the parts before it in the
    shard. No window holds more than a part of one virtual slot.
    """
    in_part = Window.partitionBy("virtual_slot", "part").orderBy(*order)
    counts = parts.select("virtual_slot", "part", F.col("n_rows").alias("n")).join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("virtual_slot", "part", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("in_part", F.row_number().over(in_part) - 1)
    # SLOTS * PARTS rows at most
    return numbered.join(F.broadcast(places), ["virtual_slot", "part"]).withColumn("slot", F.col("before") + F.col("in_part")).drop("before", "in_part", "part")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(id_col, text, slots).alias("virtual_slot")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col(id_col).cast("string"), F.col("text_crc32")), F.lit(PARTS)).cast("int"))


def op3_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the stored slot map; law: bytes."""
    rows = records(table(spark, sf_dir, "documents"))
    path = f"{shared_dir(spark)}/quadrille-slot-map-{uuid.uuid4().hex}"
    parts = part_sizes(rows)
    slot_map = store_map(first_map(slot_sizes(parts)), path)
    placed = place_rows(rows, parts, slot_map, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
