"""Sharding through fixed virtual slots.

Records hash into a fixed number of slots (thousands); bytes are summed per slot, and a small versioned
map says which shard owns each slot. Rebalancing edits that map: it moves or swaps a few slots and
leaves the rest where they are. Only DataFrame functions touch records; the driver sees one row per
slot, never more than the fixed number of slots.

Defined results: a null text has size 1 (no bytes plus one); a null doc_id hashes by its text; repeated
rows each get a position of their own; an empty table gives an empty result and leaves the map as it was.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, text_or_empty

SLOTS = 4096


@dataclass
class SlotMap:
    """Which shard owns each virtual slot. Every edit makes a new version."""

    owners: list[int]
    shards: int
    version: int = 0
    moved: int = field(default=0, compare=False)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls([s % shards for s in range(slots)], shards)

    def loads(self, weights: dict[int, int]) -> list[int]:
        total = [0] * self.shards
        for slot, owner in enumerate(self.owners):
            total[owner] += weights.get(slot, 0)
        return total

    def rebalanced(self, weights: dict[int, int], rounds: int = 20_000) -> SlotMap:
        """Move or swap slots between the heaviest and the lightest shard while that narrows their gap."""
        owners, total = list(self.owners), self.loads(weights)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, owner in enumerate(owners):
            held[owner].append((weights.get(slot, 0), slot))
        for x in held:
            x.sort()
        for _ in range(rounds):
            high, low = max(range(self.shards), key=total.__getitem__), min(range(self.shards), key=total.__getitem__)
            gap = total[high] - total[low]
            best = None
            # nothing, or a lighter slot, comes back for each slot that could go
            for weight, slot in held[high]:
                wanted = weight - gap / 2
                at = bisect_left(held[low], (wanted, -1))
                for other in [(0, -1), *held[low][max(0, at - 1) : at + 1]]:
                    shift = weight - other[0]
                    if 0 < shift < gap and (best is None or abs(shift - gap / 2) < best[0]):
                        best = (abs(shift - gap / 2), (weight, slot), other)
            if best is None:
                break
            _, out, back = best
            held[high].remove(out)
            held[low].insert(bisect_left(held[low], out), out)
            total[high] -= out[0]
            total[low] += out[0]
            owners[out[1]] = low
            if back[1] >= 0:
                held[low].remove(back)
                held[high].insert(bisect_left(held[high], back), back)
                total[high] += back[0]
                total[low] -= back[0]
                owners[back[1]] = high
        changed = sum(a != b for a, b in zip(owners, self.owners, strict=True))
        return SlotMap(owners, self.shards, self.version + 1, changed)

    def grown(self, weights: dict[int, int]) -> SlotMap:
        """One more shard; slots move only into it, from the shards that are heaviest at each step."""
        owners, total = list(self.owners), [*self.loads(weights), 0]
        goal = sum(total) / (self.shards + 1)
        queues: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, owner in enumerate(owners):
            queues[owner].append((weights.get(slot, 0), slot))
        for q in queues:
            q.sort(reverse=True)
        while total[-1] < goal:
            high = max(range(self.shards), key=total.__getitem__)
            room = min(goal - total[-1], total[high] - goal)
            at = next((i for i, (w, _) in enumerate(queues[high]) if 0 < w <= room), None)
            if at is None:
                break
            weight, slot = queues[high].pop(at)
            owners[slot] = self.shards
            total[high] -= weight
            total[-1] += weight
        changed = sum(a != b for a, b in zip(owners, self.owners, strict=True))
        return SlotMap(owners, self.shards + 1, self.version + 1, changed)

    def table(self, spark: SparkSession, first: dict[int, int] | None = None) -> DataFrame:
        """Columns virtual_slot, shard, first and version; first: where the slot's rows begin in their shard."""
        first = first or {}
        owners = F.split(F.lit(",".join(map(str, self.owners))), ",")
        begins = F.split(F.lit(",".join(str(first.get(s, 0)) for s in range(len(self.owners)))), ",")
        slot = F.col("id").cast("int")
        return spark.range(len(self.owners), numPartitions=1).select(
            slot.alias("virtual_slot"), owners[slot].cast("int").alias("shard"), begins[slot].cast("long").alias("first"), F.lit(self.version).alias("version")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones; a version is never overwritten."""
        self.table(spark).drop("first", "version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest."""
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = sorted((r.virtual_slot, r.shard) for r in stored.where(F.col("version") == version).collect())
        owners = [s for _, s in rows]
        return cls(owners, max(owners) + 1, version)


def slot_of(doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    key = F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0))
    spread = F.when(F.col(doc_id).isNull(), F.xxhash64(text_or_empty(text))).otherwise(key)
    return F.pmod(spread, F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual_slot of each record."""
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        slot_of(slots=slots).alias("virtual_slot"),
    )


def slot_totals(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each slot: at most one row for each of the fixed slots reaches the driver."""
    rows = records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    return {r.virtual_slot: (r.n, r.b) for r in rows}


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, current: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """Each record's shard and its place there, under a map rebalanced for these records' bytes.

    The previous map (or an even one) and the edited one are stored under store, as versions.
    """
    spark = docs.sparkSession
    store = store or shared_path(spark, "slot-map")
    records = sized(docs, slots)
    totals = slot_totals(records)
    before = current or SlotMap.even(shards, slots)
    after = before.rebalanced({s: b for s, (_, b) in totals.items()}) if totals else before
    for each in (before, after) if after.version != before.version else (before,):
        each.save(spark, store)
    first, filled = {}, [0] * after.shards
    for slot, owner in enumerate(after.owners):
        first[slot] = filled[owner]
        filled[owner] += totals.get(slot, (0, 0))[0]
    # the map has exactly `slots` rows, whatever the input
    placed = records.join(F.broadcast(after.table(spark, first)), "virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
