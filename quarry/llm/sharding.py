"""Sharding by fixed virtual slots.

Every record is hashed by its doc_id (a null one: by its text) into one of `slots` virtual slots (thousands, fixed
for the life of the data set). Records never move between slots; a small versioned map
says which shard holds which slot, and rebalancing edits that map. The bytes of a slot
are aggregated; version 1 deals the slots in turn, each later version moves just the
slots beyond a shard's fair share of bytes to the emptiest shards. A map in a folder of
its own (`store`) outlives the job: the next run edits its newest version.

Law: `bytes` (shard sizes near equal). Defined cases: a null text counts as empty
(size 1, crc 0); null doc_ids are dealt by their texts; repeated rows land in the same
slot, each with a place of its own; equal texts, however many, are dealt by their
doc_ids like all others, so a large group of copies weighs on no single shard; very long
texts count all their bytes; ties of slots go by number; an empty table gives no rows;
other columns are ignored.
All on DataFrame functions; what is collected into one row are `slots` sums, a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

SLOTS = 4096
PARTS = 16


def record_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every record; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots are dealt to the shards in turn."""
    return sizes.select(F.lit(1).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"))


def edit_map(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version: a shard keeps its largest slots up to the mean load; the others go, largest first, to the emptiest shard.

    `shards` may exceed the shards of the present map (growth). Both tables have at most `slots` rows.
    """
    now = slot_map.join(F.broadcast(sizes), "virtual_slot", "inner")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(shards)
    ahead = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    now = now.select("version", "virtual_slot", "shard", "bytes", (ahead <= mean).alias("stays"))
    loads = F.array(*[F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes")).otherwise(0)) for k in range(shards)])
    moving = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "virtual_slot"))))
    one = now.agg((F.max("version") + 1).alias("version"), loads.alias("loads"), moving.alias("moving"), F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard"))).alias("kept"))
    placed = F.expr(
        """aggregate(moving, named_struct('loads', loads, 'put', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
             (acc, x) -> named_struct(
               'loads', transform(acc.loads, (l, i) -> l + if(i = array_position(acc.loads, array_min(acc.loads)) - 1, -x.minus, 0L)),
               'put', array_append(acc.put, named_struct('virtual_slot', x.virtual_slot, 'shard', cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)))),
             acc -> acc.put)"""
    )
    return one.select("version", F.explode(F.concat("kept", placed)).alias("m")).select("version", "m.virtual_slot", "m.shard")


def place(records: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each record's shard and its gapless place in the shard, by the newest version of the map."""
    newest = slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version", "left_semi")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("rows")
    offsets = newest.join(F.broadcast(sizes), "virtual_slot").select("virtual_slot", "shard", before.alias("before"))
    # a slot is numbered in parts, so that many rows of one doc_id are no single task
    parts = records.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int"))
    counts = parts.groupBy("virtual_slot", "part").agg(F.count("*").alias("in_part"))
    counts = counts.withColumn("ahead", F.sum("in_part").over(Window.partitionBy("virtual_slot").orderBy("part")) - F.col("in_part")).select("virtual_slot", "part", "ahead")
    at = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        # at most slots x PARTS offsets
        parts.withColumn("at", at)
        .join(F.broadcast(counts), ["virtual_slot", "part"])
        .join(F.broadcast(offsets), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("ahead") + F.col("at") - 1).cast("long").alias("slot"), "virtual_slot")
    )


def load_map(spark, store: str) -> DataFrame:
    """All versions of a stored map: version, virtual_slot, shard."""
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(store).select("version", "virtual_slot", "shard")


def save_map(slot_map: DataFrame, store: str) -> None:
    """Add versions to a stored map, each in a folder of its own; a version that is there already is written again."""
    slot_map.write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(store)


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, store: str | None = None, stored: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard), virtual_slot.

    store: folder of the versioned map; stored: it holds a map already, whose newest version is edited.
    """
    records = write_table(record_slots(docs, slots), "records")
    sizes = write_table(slot_sizes(records), "slot_sizes")
    was = first_map(sizes, shards)
    if stored:
        every = load_map(docs.sparkSession, store)
        known = every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version", "left_semi")
        fresh = was.join(F.broadcast(known.select("virtual_slot")), "virtual_slot", "left_anti").crossJoin(F.broadcast(known.agg(F.max("version").alias("of")))).select(F.col("of").alias("version"), "virtual_slot", "shard")
        was = known.unionByName(fresh)
    slot_map = write_table(was.unionByName(edit_map(was, sizes, shards)), "slot_map")
    if store:
        save_map(slot_map, store)
    return place(records, slot_map, sizes)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 7 under the law `bytes`."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
