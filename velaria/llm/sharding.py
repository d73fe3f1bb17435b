"""Fixed virtual slots: records are hashed to slots once and for all, and a small versioned map says which
shard has a slot.  Rebalancing edits the map; only the records of moved slots move.

The map's size is the number of slots, whatever the table's; it is the one thing the driver works on.
A record's slot comes from its id and text, so one repeated id doesn't fill a slot.  Null ids and texts
are hashed like values (a null text has no bytes and crc 0), repeated rows share a slot and differ in
their place; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from velaria.llm import common

SLOTS = 1 << 14


def sized(df: DataFrame, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and the task that read the row."""
    body = F.col(f"`{text}`")
    return df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long"), body), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.spark_partition_id().alias("part"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    total, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect():
        total[r["virtual_slot"]], count[r["virtual_slot"]] = r["n"], r["c"]
    return total, count


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: equal runs of slots."""
    return [slot * shards // slots for slot in range(slots)]


def rebalanced(shard_of: list[int], total: list[int], shards: int) -> list[int]:
    """An edited map with nearly equal bytes.  A shard above its share gives up slots, the largest that
    its excess covers; these go, largest first, to whichever shard has least.  All other slots stay."""
    share = sum(total) / shards
    load = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += total[slot]
        own[shard].append(slot)
    moved = []
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda s: -total[s]):
            if total[slot] and load[shard] - total[slot] >= share:
                load[shard] -= total[slot]
                moved.append(slot)
    out = list(shard_of)
    heap = [(n, shard) for shard, n in enumerate(load)]
    heapq.heapify(heap)
    # What is just over the share stays; the rest is filled up from below.
    for slot in sorted(moved, key=lambda s: -total[s]):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + total[slot], shard))
    return out


def store(spark: SparkSession, folder: str, version: int, shard_of: list[int]) -> None:
    """Keep a version of the map; earlier ones stay readable."""
    rows = spark.createDataFrame([(slot, shard) for slot, shard in enumerate(shard_of)], "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def shards_of(rows: DataFrame, mapping: DataFrame, count: list[int]) -> DataFrame:
    """Every row with its shard and its place there, gapless from 0.

    Rows are numbered within the task that read them and their slot, then offset by the counts before:
    no shard and no slot is numbered in one task.
    """
    spark = rows.sparkSession
    counts = spark.createDataFrame(list(enumerate(count)), "virtual_slot int, n long")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    homes = mapping.join(counts, "virtual_slot").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
    tasks = tasks.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(tasks, ["virtual_slot", "part"])
        .withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(homes), "virtual_slot")
        .withColumn("slot", F.col("base") + F.col("shift") + F.col("nth"))
    )


def shard_by_bytes(df: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Records in shards of nearly equal bytes, by the second version of a map written beside them."""
    spark = df.sparkSession
    rows = common.written(sized(df, text, key), "sized")
    total, count = slot_sizes(rows)
    folder = f"{common.new_folder(spark, 'slot-map')}"
    first = first_map(shards)
    store(spark, folder, 1, first)
    store(spark, folder, 2, rebalanced(first, total, shards))
    out = shards_of(rows, load(spark, folder, 2), count)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
