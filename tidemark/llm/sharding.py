"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands); a versioned map says which shard owns each slot.
Rebalancing aggregates bytes per slot and edits that map; no record changes its slot. The slot loads are at most
``slots`` rows, a bound that does not depend on the data, so the driver edits the map itself and the map is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc, cut, new_path, occurrences, utf8_bytes

SLOTS = 4096
RECORD_OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """``owner[slot]`` is the shard of a slot. Editing gives a new version."""

    shards: int
    owner: tuple[int, ...]
    version: int = 0
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def initial(cls, slots: int, shards: int) -> SlotMap:
        return cls(shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, load: dict[int, int], shards: int | None = None) -> SlotMap:
        """Move slots, one at a time, from the fullest shard to the emptiest: the slot whose bytes come nearest to
        half their difference. Each move lowers the sum of squared loads, so it ends; slots that need not move stay."""
        shards = shards or self.shards
        owner = [s if s < shards else s % shards for s in self.owner]
        held: list[dict[int, int]] = [{} for _ in range(shards)]
        for slot, shard in enumerate(owner):
            if load.get(slot, 0):
                held[shard][slot] = load[slot]
        total = [sum(h.values()) for h in held]
        for_sale = True
        while for_sale:
            low = min(range(shards), key=lambda s: (total[s], s))
            for_sale = False
            for high in sorted(range(shards), key=lambda s: (-total[s], s)):
                gap = total[high] - total[low]
                fits = [(abs(gap - 2 * b), slot, b) for slot, b in held[high].items() if b < gap]
                if fits:
                    _, slot, b = min(fits)
                    held[low][slot] = held[high].pop(slot)
                    total[high] -= b
                    total[low] += b
                    owner[slot] = low
                    for_sale = True
                    break
        moved = tuple(s for s in range(len(owner)) if owner[s] != self.owner[s])
        return SlotMap(shards, tuple(owner), self.version + 1, moved)


class SlotMapStore:
    """Versions of a slot map in a folder, one Parquet folder for each. A version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, slot_map: SlotMap) -> None:
        rows = [(slot_map.shards, slot, shard) for slot, shard in enumerate(slot_map.owner)]
        table = self.spark.createDataFrame(rows, "shards int, slot int, shard int").coalesce(1)
        try:
            table.write.mode("errorifexists").parquet(f"{self.path}/version={slot_map.version}")
        except AnalysisException as e:
            raise ValueError(f"version {slot_map.version} of the slot map is there already") from e

    def latest(self) -> int | None:
        """The number of the last version; None if the folder holds none."""
        try:
            return self.spark.read.parquet(self.path).agg(F.max("version")).first()[0]
        except AnalysisException:  # no such folder, or no version in it
            return None

    def load(self, version: int | None = None) -> SlotMap:
        version = self.latest() if version is None else version
        try:
            rows = self.spark.read.parquet(f"{self.path}/version={version}").orderBy("slot").collect()  # one row a slot
        except AnalysisException as e:
            raise ValueError(f"the slot map has no version {version}") from e
        shards = {r["shards"] for r in rows}
        if [r["slot"] for r in rows] != list(range(len(rows))) or len(shards) != 1 or not all(0 <= r["shard"] < r["shards"] for r in rows):
            raise ValueError(f"version {version} of the slot map does not give each slot one owner")
        return SlotMap(shards.pop(), tuple(r["shard"] for r in rows), version)


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One light row for each record: id, size (UTF-8 bytes plus 8; null text has none), CRC and virtual slot.

    The slot hashes id, CRC, size and, for rows that repeat in all three, which of them a row is: so rows that share an
    id, a text or everything spread over all slots."""
    light = docs.select(F.col(id_col).alias("doc_id"), (utf8_bytes(F.col(text_col)) + RECORD_OVERHEAD).alias("size"), crc(F.col(text_col)).alias("text_crc32"))
    numbered = occurrences(light, ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "nth"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def shard_records(docs: DataFrame, shards: int = 24, slots: int = SLOTS, store: SlotMapStore | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record's shard and its place there.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (place in the shard, gapless from 0),
    grown_shard (null: only the law ``key`` has one), virtual_slot, map_version.

    The map starts from the last version in ``store``, or from slots dealt in turn (version 0) if it holds none; if the
    loads move slots, the edited map is stored as the next version. Null ids and texts are records like others; equal
    texts, and rows that repeat as a whole, are spread over all shards and get a place each; an empty table gives no
    rows; other columns are ignored. A record is never split, so one that is larger than a shard's even part stays
    whole. Places follow (virtual slot, id, CRC, size): rows equal in all of them are interchangeable.
    """
    if not 0 < shards <= slots:
        raise ValueError("shards must be from 1 to the number of slots")
    spark = docs.sparkSession
    recs = cut(records(docs, slots, id_col, text_col))
    loads = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in slot_loads(recs).collect()}  # at most one row a slot
    store = store or SlotMapStore(spark, new_path(spark, "slotmap"))
    if store.latest() is None:
        store.save(SlotMap.initial(slots, shards))
    current = store.load()
    if len(current.owner) != slots:
        raise ValueError(f"the stored map has {len(current.owner)} slots, not {slots}")
    edited = current.rebalanced({s: b for s, (b, _) in loads.items()}, shards)
    if edited.moved or edited.shards != current.shards:
        store.save(edited)
        current = store.load(edited.version)
    filled, rows = [0] * shards, []
    for slot, shard in enumerate(current.owner):
        rows.append((slot, shard, filled[shard], current.version))
        filled[shard] += loads.get(slot, (0, 0))[1]
    owner = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, before long, map_version int"))  # `slots` rows
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        recs.withColumn("place", place)
        .join(owner, "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
        )
    )
