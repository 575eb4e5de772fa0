"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots once and for all; bytes and rows are added up per slot; a versioned map says
which shard holds each slot. Rebalancing edits the map and moves whole slots, never single records. The map and the
sums have one row per slot, so that their size depends on the number of slots alone.

A given map has to hold every slot once and shards below the asked number alone; another one is an error, as is writing a
version that is there already: no record is ever left out for want of a slot.

Edge cases: a null text has size 1 and the checksum of no bytes; records with equal id and text are one record to the
hash and share a slot, so that the shards' bytes are near equal only if no record's copies weigh more than a shard's
fair share; a null id is hashed like any value, together with the text; ties within a slot are ordered by id, checksum
and size, and records equal in all three in any order; an empty table gives an empty result and a map that deals slots
out in turn; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import shared_dir, table

SLOTS = 4096
MAP = "version int, virtual_slot int, shard int"


def slotted(docs: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc, size, text_crc32 and virtual_slot of every row. The slot comes from the record alone, whatever the shards."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.pmod(F.xxhash64(F.col(doc), whole), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sums: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Heaviest slot first, each to the lightest shard so far, of equal ones to that with fewest slots."""
    load = [(0, 0, k) for k in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sums.get(s, 0), s)):
        have, n, k = heapq.heappop(load)
        out[slot] = k
        heapq.heappush(load, (have + sums.get(slot, 0), n + 1, k))
    return out


def rebalanced(current: dict[int, int], sums: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """current edited until no shard is over its fair share by more than tolerance, or no single move helps.

    Shards may be more than before (new ones start empty) or fewer (slots of the dropped ones move).
    """
    out = dict(current)
    held: list[list[int]] = [[] for _ in range(shards)]
    load = [0] * shards
    homeless = []
    for slot, k in sorted(out.items()):
        if k < shards:
            held[k].append(slot)
            load[k] += sums.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: -sums.get(s, 0)):
        k = min(range(shards), key=lambda i: (load[i], i))
        out[slot] = k
        held[k].append(slot)
        load[k] += sums.get(slot, 0)
    fair = sum(load) / shards
    for x in held:
        x.sort(key=lambda s: (sums.get(s, 0), -s))
    while True:
        top, low = max(range(shards), key=lambda i: load[i]), min(range(shards), key=lambda i: load[i])
        if load[top] <= fair * (1 + tolerance) and load[low] >= fair * (1 - tolerance):
            return out
        gap = load[top] - load[low]
        fit = [s for s in held[top] if 0 < sums.get(s, 0) < gap]
        if not fit:
            return out
        slot = min(fit, key=lambda s: abs(gap / 2 - sums.get(s, 0)))
        held[top].remove(slot)
        held[low].append(slot)
        load[top] -= sums.get(slot, 0)
        load[low] += sums.get(slot, 0)
        out[slot] = low


class SlotMap:
    """Versions of a slot-to-shard map under one path; each is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(self.path)

    def write(self, version: int, shard_of: dict[int, int]) -> None:
        """A version that is there already is an error, as other jobs may have placed records by it."""
        if self.exists() and not self.versions().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"{self.path}: version {version} is written already")
        rows = [(version, s, k) for s, k in sorted(shard_of.items())]
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(place) and len(fs.listStatus(place)) > 0

    def latest(self) -> tuple[int, dict[int, int]]:
        rows = self.versions().collect()  # one row for each slot and version
        version = max(r["version"] for r in rows)
        return version, {r["virtual_slot"]: r["shard"] for r in rows if r["version"] == version}

    def rebalance(self, sums: dict[int, int], shards: int, tolerance: float = 0.02) -> int:
        version, current = self.latest()
        self.write(version + 1, rebalanced(current, sums, shards, tolerance))
        return version + 1


def place(rows: DataFrame, sums: list, shard_of: dict[int, int], doc: str = "doc_id") -> DataFrame:
    """Adds shard and slot, the record's place in its shard without gaps.

    A slot's records are numbered within the slot, and a slot starts where the slots before it in its shard end. So
    no task sees more than one slot's ids, checksums and sizes.
    """
    spark = rows.sparkSession
    count = {r["virtual_slot"]: r["n"] for r in sums}
    start: dict[int, int] = {}
    used: dict[int, int] = {}
    for slot, k in sorted(shard_of.items()):
        start[slot] = used.get(k, 0)
        used[k] = start[slot] + count.get(slot, 0)
    placed = spark.createDataFrame([(s, k, start[s]) for s, k in shard_of.items()], "virtual_slot int, shard int, start long")
    order = Window.partitionBy("virtual_slot").orderBy(doc, "text_crc32", "size")
    numbered = rows.withColumn("__n", F.row_number().over(order))
    joined = numbered.join(F.broadcast(placed), "virtual_slot", "left")
    sure = F.when(F.col("start").isNull(), F.raise_error(F.lit("a record's slot isn't in the map"))).otherwise(F.col("start"))
    return joined.withColumn("slot", (sure + F.col("__n") - 1).cast("long")).drop("__n", "start")


def checked(shard_of: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """shard_of, if it holds each of the slots and no others, in shards below the given number."""
    if shard_of.keys() != set(range(slots)):
        raise ValueError(f"the map has {len(shard_of)} slots, not 0 to {slots - 1}")
    if other := sorted({k for k in shard_of.values() if not 0 <= k < shards}):
        raise ValueError(f"the map has shards {other}, not 0 to {shards - 1}; rebalance it first")
    return shard_of


def shard(docs: DataFrame, shards: int, doc: str = "doc_id", text: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """doc, size, text_crc32, virtual_slot, shard, slot, version; sizes per shard are near equal.

    A slot_map that has versions already is used as it is, if it fits slots and shards; else version 1 is made from the
    slots' bytes.
    """
    rows = slotted(docs, doc, text, slots)
    sums = slot_sums(rows).collect()  # at most `slots` rows
    slot_map = slot_map or SlotMap(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}")
    if slot_map.exists():
        version, shard_of = slot_map.latest()
    else:
        version, shard_of = 1, first_map({r["virtual_slot"]: r["bytes"] for r in sums}, shards, slots)
        slot_map.write(version, shard_of)
    return place(rows, sums, checked(shard_of, shards, slots), doc).withColumn("version", F.lit(version))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
