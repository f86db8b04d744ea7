"""Sharding over fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import new_path

#: Slots are fixed for good: shards change, the slot of a record never does.
SLOTS = 4096


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record, from its id and text alone."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots))


def record_size() -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, rows`` of the slots in use; at most ``slots`` rows."""
    return docs.groupBy(virtual_slot(slots).alias("virtual_slot")).agg(F.sum(record_size()).alias("bytes"), F.count("*").alias("rows"))


@dataclass
class SlotMap:
    """Which shard owns each slot. ``owner[slot]`` is a shard; each edit makes the next version."""

    owner: np.ndarray
    version: int = 0

    @classmethod
    def fresh(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(np.arange(slots) % shards)

    def rebalanced(self, weight: np.ndarray, shards: int, only_into: int | None = None) -> SlotMap:
        """The next version: slots move, or change places, from the heaviest shard to the lightest
        until no such edit brings the two closer. With ``only_into`` slots move into that shard alone.

        The map has a fixed number of slots, so this is the same small job at every corpus size.
        """
        owner = self.owner.copy()
        load = np.bincount(owner, weights=weight, minlength=shards)
        mean = weight.sum() / shards
        while True:
            high = int(np.argmax(load))
            low = int(np.argmin(load)) if only_into is None else only_into
            gap = load[high] - load[low] if only_into is None else 2 * min(load[high] - mean, mean - load[low])
            mine = np.flatnonzero((owner == high) & (weight > 0))
            if gap <= 1 or high == low or not len(mine):
                break
            movable = mine[weight[mine] < gap] if only_into is None else mine[weight[mine] <= gap / 2]
            if len(movable):
                a, b = movable[np.argmin(np.abs(weight[movable] - gap / 2))], None
                best = abs(weight[a] - gap / 2)
            else:
                a, b, best = None, None, gap / 2
            theirs = np.flatnonzero(owner == low)
            if only_into is None and best > 0.5 and len(theirs):
                order = theirs[np.argsort(weight[theirs])]
                at = np.clip(np.searchsorted(weight[order], weight[mine] - gap / 2), 0, len(order) - 1)
                miss = np.abs(weight[mine] - weight[order][at] - gap / 2)
                if (k := int(np.argmin(miss))) is not None and miss[k] < best - 0.5:
                    a, b = mine[k], order[at[k]]
            if a is None:
                break
            owner[a] = low
            moved = weight[a]
            if b is not None:
                owner[b] = high
                moved -= weight[b]
            load[high] -= moved
            load[low] += moved
        return SlotMap(owner, self.version + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the map's table ``version, slot, shard``; old versions stay."""
        rows = pd.DataFrame({"version": self.version, "slot": np.arange(len(self.owner)), "shard": self.owner}).astype("int64")
        spark.createDataFrame(rows, "version long, slot long, shard long").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A saved version, by default the newest."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("slot").select("shard").collect()
        return cls(np.array([r.shard for r in rows]), version)


def assign_shards(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version``. The law is ``bytes``: shards are nearly equal in bytes.

    A map saved at ``map_path`` is taken up and edited (a new version), else a fresh one is. ``slot``
    is the row's place in its shard, gapless from 0: the virtual slots of a shard follow each other,
    and rows are numbered within their virtual slot, so no shard is numbered in one task. Rows alike
    share a virtual slot and have places of their own; the law is about bytes, so equal texts under different
    ids may lie in different shards. A null text has one byte, ids may be null, no rows give none. ``grown_shard`` is null under this law.
    """
    spark = docs.sparkSession
    sizes = slot_sizes(docs, slots).toPandas()  # one row for each of a fixed number of slots
    weight, rows = np.zeros(slots), np.zeros(slots, dtype="int64")
    weight[sizes["virtual_slot"].to_numpy("int64")] = sizes["bytes"].to_numpy("float64")
    rows[sizes["virtual_slot"].to_numpy("int64")] = sizes["rows"].to_numpy("int64")
    path = map_path or new_path(spark, "slot-map")
    try:
        current = SlotMap.load(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        current = SlotMap.fresh(shards, slots)
        current.save(spark, path)
    current = current.rebalanced(weight, shards)
    current.save(spark, path)
    table = pd.DataFrame({"virtual_slot": np.arange(slots), "shard": current.owner, "rows": rows}).sort_values(["shard", "virtual_slot"])
    table["_before"] = table.groupby("shard")["rows"].cumsum() - table["rows"]
    places = spark.createDataFrame(table[["virtual_slot", "shard", "_before"]].astype("int64"), "virtual_slot long, shard long, _before long")
    narrow = docs.select("doc_id", record_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), virtual_slot(slots).alias("virtual_slot"))
    nth = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1
    return (
        narrow.withColumn("_nth", nth)
        .join(F.broadcast(places), "virtual_slot")  # one row per slot: a fixed number
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("_before") + F.col("_nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(current.version).cast("long").alias("map_version"))
    )
