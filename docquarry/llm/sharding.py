"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's id hashes into one of SLOTS slots, for ever. Bytes are summed by slot, and a map gives each slot a shard so
that shards get nearly equal bytes. A map is a table with a version: rebalancing edits some slots' shards and stores the
result as the next version, and only records of edited slots move.

An id that holds many rows can't be divided by its hash alone, so a record's slot also depends on its text and, among
rows equal in both, on its number there. Equal rows are counted, not gathered, and written out again from their count in
runs of RUN, so a group of any size spreads over the slots and over the tasks. Which of several equal rows has which
number doesn't show.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import scratch, written

SLOTS = 8192
#: Equal rows that one row of the intermediate table stands for at most.
RUN = 1024


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 (0 for null and empty) and vslot.

    The first of equal rows has the slot of the hash of id and text, its n-th copy that of this hash and n."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(id_col), text).alias("h"))
    counted = own.groupBy("id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.select("id", "size", "text_crc32", "h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("first"))
    # runs of one group go to different tasks
    slot = F.pmod(F.when(F.col("copy") == 0, F.col("h")).otherwise(F.xxhash64("h", "copy")), F.lit(slots)).cast("int")
    last = F.least(F.col("first") + RUN, F.col("n")) - 1
    numbered = runs.repartition("h", "first").select("id", "size", "text_crc32", "h", F.explode(F.sequence("first", last)).alias("copy"))
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", slot.alias("vslot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any: at most SLOTS rows."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balanced(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: the heaviest slots first, each to the shard that has least so far. Slots without bytes come last, in turn."""
    heap = [(0, s) for s in range(shards)]
    out = [s % shards for s in range(slots)]
    for slot in sorted(sizes, key=lambda k: (-sizes[k], k)):
        have, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (have + sizes[slot], shard))
    return out


def rebalanced(now: list[int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The next version of a map, for `shards` shards: slots move only from shards above the mean to shards below it, and
    no more than that needs. Growing by one shard therefore moves slots into the new one only, if the others were balanced."""
    out = list(now)
    have = [0] * shards
    for slot, size in sizes.items():
        have[out[slot]] += size
    mean = sum(have) / shards
    of = {s: sorted((k for k in sizes if out[k] == s), key=lambda k: (-sizes[k], k)) for s in range(shards)}
    while True:
        to, frm = min(range(shards), key=lambda s: (have[s], s)), max(range(shards), key=lambda s: (have[s], -s))
        fits = [k for k in of[frm] if sizes[k] < have[frm] - have[to] and have[to] + sizes[k] <= mean * (1 + tolerance)]
        if have[to] >= mean * (1 - tolerance) or not fits:
            return out
        slot = fits[0]
        of[frm].remove(slot)
        of[to].append(slot)
        out[slot], have[frm], have[to] = to, have[frm] - sizes[slot], have[to] + sizes[slot]


def store_map(spark: SparkSession, slot_map: list[int], version: int, path: str) -> None:
    """Add a version to the table of maps at path: version, vslot, shard."""
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(slot_map)], "vslot int, shard int").coalesce(1)
    rows.withColumn("version", F.lit(version)).select("version", "vslot", "shard").write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """vslot and shard of a version of the table of maps at path, the newest by default."""
    maps = spark.read.schema("version int, vslot int, shard int").parquet(path)
    newest = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == newest).select("vslot", "shard")


def placed(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with shard and slot, the row's place in its shard: gapless from 0, by virtual slot, id, size and checksum.

    Equal rows are counted and take a range of places together. Places are numbered within a virtual slot and shifted by
    what the shard's slots before it hold, which is a window over the map (at most SLOTS rows)."""
    counted = rows.groupBy(id_col, "size", "text_crc32", "vslot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("vslot").orderBy(id_col, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    held = slot_map.join(slot_bytes(rows).select("vslot", F.col("rows").alias("held")), "vslot")
    upto = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("first", F.coalesce(F.sum("held").over(upto), F.lit(0))).select("vslot", "shard", "first")
    # the map has SLOTS rows at most
    return local.join(F.broadcast(starts), "vslot").withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.col("at") + F.col("n") - 1))).select(id_col, "size", "text_crc32", "vslot", "shard", "slot")


def sharded(df: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Per row of df: id, size, text_crc32, law (bytes), shard, slot, grown_shard (null under this law), vslot, map_version
    and moved_shard, the row's shard in version 2 of the map, which is edited for one more shard.

    Null ids are ids of their own; repeated rows get places of their own; an empty table gives an empty result."""
    spark = df.sparkSession
    path = path or scratch(spark, "slot-map")
    rows = written(digests(df, id_col=id_col, text_col=text_col, slots=slots), "digests")
    sizes = {r.vslot: r.bytes for r in slot_bytes(rows).collect()}  # at most SLOTS rows
    first = balanced(sizes, shards, slots)
    store_map(spark, first, 1, path)
    store_map(spark, rebalanced(first, sizes, shards + 1), 2, path)
    second = load_map(spark, path, 2).withColumnRenamed("shard", "moved_shard")
    out = placed(rows, load_map(spark, path, 1), id_col).join(F.broadcast(second), "vslot")
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(1).alias("map_version"), "moved_shard")
