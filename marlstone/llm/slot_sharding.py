"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands, whatever the
number of shards). Only the slots are dealt to shards, by a small versioned
table ``(version, slot, shard, bytes, rows)``. Rebalancing writes a new version
that moves as few slots as it needs; no record is hashed anew.

The law kept is ``bytes``: the shards' sizes are near equal. Rows hash by
identifier, checksum and size; a slot that repeated rows make too heavy is dealt
anew, row by row, so one identifier on a third of all rows fills no shard.

Defined results: a null text has no bytes; null identifiers are told apart by
their texts, and equal rows by their place in the input, so none of them meet in
one slot; repeated rows get places of their own; an empty table gives an empty
table with an empty map; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, dropped, scratch_path

SLOTS = 4096
#: Rebalancing stops when no shard is further than this share from the mean.
TOLERANCE = 0.0005
#: A slot of several rows with more than this share of a shard is dealt anew.
HEAVY = 0.05
#: Rows of a slot that one task ranks.
PART_ROWS = 50_000
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


@dataclass
class SlotMap:
    """Slot to shard, with each slot's bytes and rows when the version was made."""

    version: int
    shard: np.ndarray
    n_shards: int

    @classmethod
    def even(cls, slots: int, n_shards: int) -> SlotMap:
        return cls(1, np.arange(slots) % n_shards, n_shards)

    def rebalanced(self, size: np.ndarray, n_shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: moves and swaps slots between the fullest and the emptiest shard
        until sizes are within ``tolerance`` of the mean or no move helps."""
        n = n_shards or self.n_shards
        shard = np.where(self.shard < n, self.shard, -1)
        load = np.bincount(shard[shard >= 0], weights=size[shard >= 0], minlength=n)
        for slot in sorted(np.flatnonzero(shard < 0), key=lambda s: -size[s]):
            shard[slot] = int(load.argmin())
            load[shard[slot]] += size[slot]
        mean = load.sum() / n
        for _ in range(20 * len(shard)):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            if gap <= 0 or max(load[high] - mean, mean - load[low]) <= tolerance * mean:
                break
            ours, theirs = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
            given = np.append(size[theirs], 0.0)
            change = size[ours][:, None] - given[None, :]
            score = np.where((change > 0) & (change < gap), np.abs(change - gap / 2), np.inf)
            best = int(score.argmin())
            i, j = divmod(best, len(given))
            if not np.isfinite(score[i, j]):
                break
            shard[ours[i]] = low
            if j < len(theirs):
                shard[theirs[j]] = high
            load[high] -= change[i, j]
            load[low] += change[i, j]
        return SlotMap(self.version + 1, shard, n)


class SlotMapStore:
    """Versions of a map as Parquet files in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, slot_map: SlotMap, size: np.ndarray, rows: np.ndarray) -> None:
        data = [(slot_map.version, s, int(slot_map.shard[s]), int(size[s]), int(rows[s])) for s in range(len(size))]
        table = self.spark.createDataFrame(data, MAP_SCHEMA)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{slot_map.version:06d}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version:06d}")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row, and a number of the row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sized.withColumns({"virtual_slot": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"), "_number": F.monotonically_increasing_id()})


def _counted(rows: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows by slot. One row per slot reaches the driver, whatever the input."""
    size, count = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    return size, count


def _spread(rows: DataFrame, slots: int, n_shards: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``rows`` with every slot that repeated rows make too heavy dealt anew row by row, and the slots' bytes and rows."""
    size, count = _counted(rows, slots)
    heavy = (count > 8 + 4 * count.mean()) | ((count > 1) & (size > HEAVY * size.sum() / n_shards))
    if heavy.any():
        own = F.pmod(F.xxhash64("virtual_slot", "_number"), F.lit(slots)).cast("int")
        hot = F.broadcast(rows.sparkSession.createDataFrame([(int(s), True) for s in np.flatnonzero(heavy)], "virtual_slot int, _heavy boolean"))
        rows = rows.join(hot, "virtual_slot", "left").withColumn("virtual_slot", F.when(F.col("_heavy"), own).otherwise(F.col("virtual_slot"))).drop("_heavy")
        size, count = _counted(rows, slots)
    return rows, size, count


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with a gapless ``place`` inside their slot; ``most`` is the largest slot's number of rows.

    Slots are ranked in parts of about PART_ROWS rows, so that no task follows a slot's size.
    """
    parts = -(-most // PART_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_number"), F.lit(max(1, parts))).cast("int"))
    inside = Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size", "_number")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    if parts <= 1:
        return ranked
    earlier = Window.partitionBy("virtual_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("virtual_slot", "_part").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return ranked.join(before, ["virtual_slot", "_part"]).withColumn("place", F.col("place") + F.col("_before"))


def shard_by_slots(docs: DataFrame, n_shards: int = 16, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Every row's shard and its gapless place there; the map's versions are written to ``store``,
    or to a folder that goes once the edited version is read, where none is named."""
    spark = docs.sparkSession
    # Narrow rows, read from the texts once: every later step sees the same numbers.
    rows, size, count = _spread(cut(records(docs, slots)), slots, n_shards)
    first = SlotMap.even(slots, n_shards)
    path = store or scratch_path(spark, "slot-map")
    kept = SlotMapStore(spark, path)
    kept.write(first, size, count)
    edited = first.rebalanced(size)
    kept.write(edited, size, count)
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot")
    entries = kept.read(edited.version).withColumn("before", F.sum("rows").over(by_shard) - F.col("rows")).select("virtual_slot", "version", "shard", "before")
    # One row per slot, so the map is always small enough for every executor.
    entries = spark.createDataFrame(entries.collect(), entries.schema)
    if store is None:
        dropped(spark, path)
    return (
        _placed(rows, int(count.max()))
        .join(F.broadcast(entries), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
    )
