"""Sharding by fixed virtual slots: records are hashed into slots, bytes are summed by slot,
and a versioned map from slot to shard is stored, and edited to rebalance."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Number of slots.  It never changes, so a record's slot never does.
SLOTS = 8192


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of every row.  Size is the UTF-8 bytes of
    the text (null: none) plus 8.  The slot is decided by doc_id alone; rows without one are
    spread by their text.  A null text has the checksum of no bytes, 0."""
    where = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(3), "text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.pmod(where, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot; never more entries than there are slots."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {r.virtual_slot: (r.bytes, r.n) for r in sums.collect()}


def assign(sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """A first map: slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot, (size, _) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        held, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (held + size, k))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards: slots move from the fullest shard to the emptiest,
    as long as that narrows the gap; slots of shards that are no more move first."""
    out = {s: k for s, k in old.items() if k < shards}
    held = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for s, k in out.items():
        held[k] += sizes.get(s, (0, 0))[0]
        own[k].append(s)
    for s in sorted(set(old) - set(out) | set(sizes) - set(old), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        k = min(range(shards), key=held.__getitem__)
        out[s] = k
        held[k] += sizes.get(s, (0, 0))[0]
        own[k].append(s)
    while True:
        full, low = max(range(shards), key=held.__getitem__), min(range(shards), key=held.__getitem__)
        gap = held[full] - held[low]
        fit = [s for s in own[full] if 0 < sizes.get(s, (0, 0))[0] < gap]
        if not fit:
            return out
        s = min(fit, key=lambda s: (abs(gap / 2 - sizes[s][0]), s))
        own[full].remove(s)
        own[low].append(s)
        out[s] = low
        held[full] -= sizes[s][0]
        held[low] += sizes[s][0]


def write_map(spark: SparkSession, path: str, version: int, slots: dict[int, int]) -> None:
    """Store a map as ``path/version=N``; a version that exists is not overwritten."""
    entries = ",".join(f'{{"virtual_slot":{s},"shard":{k}}}' for s, k in sorted(slots.items()))
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(f"[{entries}]"), "array<struct<virtual_slot:int,shard:int>>")))
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r.virtual_slot: r.shard for r in spark.read.parquet(f"{path}/version={version}").collect()}


def latest(spark: SparkSession, path: str) -> int:
    """The last version of the map at ``path``; 0 if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return max((int(x.getPath().getName().split("=")[1]) for x in found or ()), default=0)


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law`` ("bytes"), ``shard, slot`` (the row's place in
    its shard, gapless from 0), ``grown_shard`` (null under this law) and ``virtual_slot``.
    The map of slots to shards is stored at ``map_path`` (if none is given, in the folder of the
    run) as its next version, an edited copy of the last one where there is one, and the rows
    are placed by the map as it is read back.

    Only the sums of the slots, whose number is fixed, reach the driver.
    A row's place is its rank within its slot plus the rows of the shard's earlier slots, so
    no task gathers a shard.  Equal texts and repeated rows are rows like others.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, slots), "slotted")
    sizes = slot_sizes(rows)
    path = map_path or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
    version = latest(spark, path)
    write_map(spark, path, version + 1, rebalance(read_map(spark, path, version), sizes, shards) if version else assign(sizes, shards))
    slot_map = spark.read.parquet(f"{path}/version={version + 1}")
    counted = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(slot_map, "virtual_slot")  # a row for each slot
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = counted.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
