"""Shards over fixed virtual slots, with a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, text_or_empty

#: Slots never change; only the map from slots to shards is edited. The map is their number of integers.
SLOTS = 4096
MOST_SLOTS = 1 << 16


def slot_of(columns: list[str], slots: int = SLOTS):
    """The virtual slot of a key; null keys have a slot like any other."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt in turn, before any size is known."""
    return [slot % shards for slot in range(slots)]


def rebalance(owners: list[int], sizes: list[int], shards: int) -> list[int]:
    """An edited copy of the map: few slots move, until no move or swap out of the largest shard helps.

    Slots of shards that are no more are dealt to the smallest first. Then the
    largest shard gives the smallest one the slot that brings both nearest to
    their mean.
    """
    owners = list(owners)
    load = [0] * shards
    lost = []
    for slot, owner in enumerate(owners):
        if owner < shards:
            load[owner] += sizes[slot]
        else:
            lost.append(slot)
    queue = [(total, shard) for shard, total in enumerate(load)]
    heapq.heapify(queue)
    for slot in sorted(lost, key=lambda slot: (-sizes[slot], slot)):
        total, shard = heapq.heappop(queue)
        owners[slot] = shard
        load[shard] = total + sizes[slot]
        heapq.heappush(queue, (load[shard], shard))
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, owner in enumerate(owners):
        held[owner].add(slot)
    for _ in range(4 * len(owners)):
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [slot for slot in held[high] if 0 < sizes[slot] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda slot: (abs(gap - 2 * sizes[slot]), slot))
        owners[slot] = low
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
    return owners


def write_map(spark: SparkSession, path: str, version: int, owners: list[int]) -> None:
    """Store a version of the map beside the older ones: path/version=N."""
    _map_table(spark, owners).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, map); the newest unless a version is named."""
    stored = spark.read.parquet(path)
    newest = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == newest).orderBy("vslot").collect()  # SLOTS rows
    return newest, [row.owner for row in rows]


def newest_map(spark: SparkSession, path: str, shards: int, slots: int) -> tuple[int, list[int]]:
    """The newest version that is stored; where there is none, version 0 is stored first."""
    try:
        version, owners = read_map(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_map(spark, path, 0, first_map(shards, slots))
        return read_map(spark, path)
    if len(owners) != slots:
        raise ValueError(f"the map has {len(owners)} slots, not {slots}: slots never change")
    return version, owners


def _map_table(spark: SparkSession, owners: list[int]) -> DataFrame:
    numbers = F.split(F.lit(",".join(map(str, owners))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(numbers).alias("vslot", "owner"))


def slot_totals(sized: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot: ``slots`` pairs, whatever the number of rows."""
    totals = [(0, 0)] * slots
    for row in sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        totals[row.vslot] = row.bytes, row.n
    return totals


def shard(docs: DataFrame, *, shards: int = 16, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version for every row.

    A row's id, text CRC and size hash into a fixed virtual slot; the slots' bytes are summed; the newest
    map stored under ``maps`` (version 0, dealt before any size is known, where there is none) is edited
    until the shards' bytes are near equal, stored as the next version, and read back to place the rows.
    ``law`` is thus "bytes", and grown_shard is null. ``slot`` is a row's
    place in its shard, gapless from 0: the rows of the shard's earlier virtual
    slots, plus its rank by doc_id in its own, so that no task sorts a whole
    shard.

    Null text has size 1 and the CRC of no bytes. Rows that are equal in id, CRC and size, null ids included, fall
    into one slot; a slot that so gets over a quarter of a shard's bytes or rows is dealt over all slots, by the
    rows' places in the written table. Ties in a slot are ranked by that place. An empty table gives no rows. Other columns
    are not read; very long texts count whole.
    """
    if not 0 < slots <= MOST_SLOTS:
        raise ValueError(f"slots must be 1 to {MOST_SLOTS}")
    spark = docs.sparkSession
    maps = maps or f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    raw = text_or_empty().cast("string").cast("binary")
    measured = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # The place is written with the row, so that it stays the same however often a task runs.
    sized = materialize(measured.select("*", F.monotonically_increasing_id().alias("place"), slot_of(["doc_id", "text_crc32", "size"], slots).alias("vslot")), "sized")
    first = slot_totals(sized, slots)
    limits = [max(1, sum(part) // (4 * shards)) for part in zip(*first)] or [1, 1]
    hot = [number for number, total in enumerate(first) if any(value > limit for value, limit in zip(total, limits))]
    if hot:  # at most eight a shard
        sized = sized.withColumn("vslot", F.when(F.col("vslot").isin(*hot), slot_of(["vslot", "place"], slots)).otherwise(F.col("vslot")))
    totals = slot_totals(sized, slots) if hot else first

    version, owners = newest_map(spark, maps, shards, slots)
    write_map(spark, maps, version + 1, rebalance(owners, [size for size, _ in totals], shards))
    version, owners = read_map(spark, maps)
    starts, rows_of = [], [0] * shards
    for owner, (_, n) in zip(owners, totals):
        starts.append(rows_of[owner])
        rows_of[owner] += n

    rank = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "place")
    ranked = sized.withColumn("rank", F.row_number().over(rank))
    of_slot = lambda values, kind: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col("vslot"))  # noqa: E731  # ``slots`` numbers
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), of_slot(owners, "int").alias("shard"), (of_slot(starts, "bigint") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(version).alias("map_version"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
