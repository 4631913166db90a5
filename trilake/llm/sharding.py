"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilake.llm.common import running_total, stored, unit_interval

SHARDS = 16
#: Units of packing for each bin: smaller groups are first bundled into tiles of a bin's size / TILES.
TILES = 1_024
#: Bins that one packing task fills at most; more bins are packed in independent cells.
CELL_BINS = 64


class Rooms:
    """Remaining capacities in a balanced search tree (a treap with hashed priorities)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]; key = (room, bin)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = [key, hash((key[1] * 2654435761) % (1 << 32) ^ key[0]), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest room of at least `size`, ties to the lower bin."""
        low, high = self._split(self.root, (size, -1))
        best = high
        while best is not None and best[2] is not None:
            best = best[2]
        if best is None:
            return None
        _, high = self._split(high, (best[0][0], best[0][1] + 1))
        self.root = self._merge(low, high)
        return best[0]

    def _split(self, node, key):
        """Trees of what is below `key`, and of the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """A bin for each size: by decreasing size, into the bin with the tightest room that
    fits, else into a new one. A size above the capacity has a bin of its own."""
    rooms, bins, opened = Rooms(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take_tightest(sizes[i])
        room, target = found or (capacity, opened)
        opened += found is None
        bins[i] = target
        if room > sizes[i]:
            rooms.add((room - sizes[i], target))
    return bins


def fit_into(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing into at most `shards` bins, of about the smallest capacity
    for which it needs no more. Groups above a fair share of what is left get a bin alone."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, left, alone = [0] * len(sizes), sum(sizes), 0
    while alone < min(shards - 1, len(order)) and sizes[order[alone]] * (shards - alone) > left:
        bins[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    if not rest:
        return bins
    units, open_bins = [sizes[i] for i in rest], shards - alone
    low = max(-(-left // open_bins), units[0])
    high = -(-left // open_bins) + units[0]  # here a unit that fits nowhere would mean more than all is packed
    best = best_fit_decreasing(units, high)
    while high - low > low // 10_000:
        tried = best_fit_decreasing(units, middle := (low + high) // 2)
        if max(tried) < open_bins:
            best, high = tried, middle
        else:
            low = middle + 1
    for i, b in zip(rest, best):
        bins[i] = alone + b
    return bins


def plan(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Where each unit of packing goes: big (a group's key, or null), tile (or null), shard, tiles.

    `groups`: key, size. Give either the number of `shards`, which then come out nearly
    equal, or their `capacity`, and as few shards as best-fit-decreasing needs are made.
    Groups of at most a shard / ``TILES`` are bundled by a hash of their key into tiles of
    about that size, so a task packs at most about 2 * ``TILES`` units for each of its
    bins, however many groups there are. With a capacity, units are dealt into cells of
    about ``CELL_BINS`` bins that are packed independently; each cell may leave one bin
    partly empty.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    unit = max(1, (-(-total // shards) if shards else capacity) // TILES)
    cells = 1 if shards else max(1, -(-total // (capacity * CELL_BINS)))
    is_small = F.col("size") <= unit
    tiles = max(1, -(-(groups.where(is_small).agg(F.sum("size")).first()[0] or 0) // unit))
    units = (
        groups.select(
            F.when(~is_small, F.col("key")).alias("big"),
            F.when(is_small, tile_of(F.col("key"), tiles)).alias("tile"),
            "size",
        )
        .groupBy("big", "tile")
        .agg(F.sum("size").alias("size"))
        .withColumn("cell", F.pmod(F.xxhash64("big", "tile"), F.lit(cells)))
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "big", "tile"], ascending=[False, True, True])
        sizes = pdf["size"].tolist()
        return pdf.assign(bin=fit_into(sizes, shards) if shards else best_fit_decreasing(sizes, capacity))

    packed = stored(
        units.groupBy("cell").applyInPandas(pack, "big string, tile long, size long, cell long, bin long"), "shard-plan"
    )
    used = packed.groupBy("cell").agg((F.max("bin") + 1).alias("used"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = used.select("cell", F.coalesce(F.sum("used").over(earlier), F.lit(0)).alias("first"))
    return packed.join(first, "cell").select("big", "tile", (F.col("first") + F.col("bin")).alias("shard"), F.lit(tiles).alias("tiles"))


def tile_of(key: Column, tiles: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), tiles if isinstance(tiles, Column) else F.lit(tiles))


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """The shard and the place in it of each document: doc_id, size, text_crc32, shard, slot.

    Equal texts are one group and are never parted. Size: UTF-8 bytes of the text plus 1.
    Shards are nearly equal in bytes, as far as one group is not larger than a fair
    share; such a group has a shard of its own. Slots are gapless from 0 in each shard,
    in the order of a hash of doc_id, then doc_id.

    A null text counts as empty and is in one group with empty texts (size 1, CRC 0).
    Null doc_ids and repeated rows are rows like others. Ties in size go by key. With
    fewer groups than shards, some shards stay empty. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (F.length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.md5(text).alias("key"),
        ),
        "shard-rows",
    )
    placed = plan(rows.groupBy("key").agg(F.sum("size").alias("size")), shards, capacity)
    # at most 2 * TILES units a bin were packed; broadcast follows the measured size of the plan
    big = placed.where("big is not null").select(F.col("big").alias("key"), F.col("shard").alias("big_shard"))
    tile = placed.where("tile is not null").select("tile", F.col("shard").alias("tile_shard"))
    tiles = placed.groupBy().agg(F.max("tiles")).first()[0] or 1
    placed = stored(
        rows.join(big, "key", "left")
        .withColumn("tile", F.when(F.col("big_shard").isNull(), tile_of(F.col("key"), tiles)))
        .join(tile, "tile", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "tile_shard").alias("shard"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place")),
        "shard-placed",
    )
    counts = placed.groupBy("shard").agg(F.count("*").alias("rows"))
    return running_total(
        placed.join(counts, "shard"), "shard", "rows", unit_interval(F.col("place")), ["place", "doc_id", "text_crc32", "size"], F.lit(1), "slot"
    ).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
