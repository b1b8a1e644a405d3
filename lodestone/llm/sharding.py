"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups with equal texts stay together. Groups above a small share of a shard are
items of their own; there can be only a fixed number of them. All others are
bundled by a hash into a fixed number of items. So the packer sees a bounded
number of (item, size) pairs, whatever the table's size: from the largest on, each
goes to the open shard with the tightest room that holds it, found in a balanced
tree. With a given number of shards the smallest capacity that suffices is searched.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import checkpointed

OVERHEAD = 16
#: Items of their own and bundles, at most this many for each shard.
ITEMS_A_SHARD = 256
ROWS_A_RANK = 5_000


class RoomTree:
    """(room, shard) pairs in order: a two-level B-tree whose leaves split in halves."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.lows: list[tuple[int, int]] = [(-1, -1)]

    def add(self, room: int, shard: int) -> None:
        at = max(bisect_left(self.lows, (room, shard)) - 1, 0)
        leaf = self.leaves[at]
        insort(leaf, (room, shard))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.lows.insert(at + 1, leaf[half])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the pair of least room that holds ``size``."""
        wanted = (size, -1)
        at = max(bisect_left(self.lows, wanted) - 1, 0)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, wanted)
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and len(self.leaves) > 1 and at:
                    del self.leaves[at], self.lows[at]
                return found
            at += 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The shard of each item; None if an item exceeds the capacity or more than ``most`` shards are needed.

    ``sizes`` must fall. Equal rooms go to the smaller shard.
    """
    tree, opened, placed = RoomTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if size > capacity or opened == most:
                return None
            found, opened = (capacity, opened), opened + 1
        tree.add(found[0] - size, found[1])
        placed.append(found[1])
    return placed


def pack_items(sizes: Iterable[int], shards: int | None, capacity: int | None) -> list[int]:
    """Shards of falling sizes: fewest for a capacity, or the least capacity for a number of shards."""
    sizes = list(sizes)
    if not sizes:
        return []
    if capacity is not None:
        placed = best_fit_decreasing(sizes, capacity)
        if placed is None:
            raise ValueError("an indivisible group exceeds the capacity")
        return placed
    # A group above a fair share of what is left fills a shard alone, so that it doesn't widen the others.
    alone, left = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > left:
        left -= sizes[alone]
        alone += 1
    if alone:
        return [*range(alone), *(alone + s for s in pack_items(sizes[alone:], shards - alone, None))]
    low, high = max(-(-left // shards), sizes[0]), left
    best = best_fit_decreasing(sizes, high, shards)
    while low < high:
        middle = (low + high) // 2
        placed = best_fit_decreasing(sizes, middle, shards)
        if placed is None:
            low = middle + 1
        else:
            high, best = middle, placed
    return best


def sharded(
    docs: DataFrame,
    shards: int | None = 40,
    capacity: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    expected_shards: int = 4_096,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs``.

    Give ``shards``, or ``capacity`` in bytes (and then ``expected_shards``, which bounds
    the items). Size is the text's UTF-8 bytes plus 16; null texts have none and form a group. Slots
    are gapless in each shard, by a hash of the id, then the id. ``grown_shard`` is null: bins give no promise
    about one more shard. Null ids and repeated rows are kept, other columns ignored. An
    empty table gives no rows. A group larger than a fair share fills a shard alone.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    groups = checkpointed(slim.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    total, rows = groups.agg(F.sum("size"), F.sum("rows")).first()
    bundles = (shards or expected_shards) * ITEMS_A_SHARD
    share = -(-(total or 0) // bundles)
    # At most ``bundles`` groups can be larger than a share of 1 / bundles.
    single = groups.where(F.col("size") > share).select("group", "size").collect()
    bundle = F.pmod(F.hash("group"), F.lit(bundles))
    bundled = (
        groups.where(F.col("size") <= share).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()
    )
    items = sorted(
        [(r["size"], 0, r["group"]) for r in single] + [(r["size"], 1, r["bundle"]) for r in bundled],
        key=lambda item: (-item[0], item[1], item[2]),
    )
    placed = pack_items((item[0] for item in items), shards, capacity)
    of_group = [(item[2], shard) for item, shard in zip(items, placed) if item[1] == 0]
    of_bundle = [(item[2], shard) for item, shard in zip(items, placed) if item[1] == 1]
    by_group = F.broadcast(spark.createDataFrame(of_group, "group bigint, own int"))
    by_bundle = F.broadcast(spark.createDataFrame(of_bundle, "bundle int, common int"))
    ranks = max(1, -(-(rows or 0) // ((max(placed, default=0) + 1) * ROWS_A_RANK)))
    assigned = (
        slim.join(by_group, "group", "left")
        .withColumn("bundle", bundle)
        .join(by_bundle, "bundle", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(ranks)).alias("rank"),
        )
    )
    part = Window.partitionBy("shard", "rank").orderBy("doc_id", "text_crc32")
    placed_rows = checkpointed(assigned.withColumn("place", F.row_number().over(part)))
    counts = placed_rows.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "rank", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    return placed_rows.join(starts, ["shard", "rank"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
