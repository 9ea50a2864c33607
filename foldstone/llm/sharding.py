"""Sharding (operator 8): best-fit-decreasing bin packing of groups of equal texts.

Law `bytes`: shard sizes are near equal. Items are the groups of equal texts, each as large as its rows together; none is
ever split. They are packed by size, largest first, each into the bin with the tightest remaining room that takes it,
which a balanced tree finds. Items of one size are alike, so the driver packs runs of them: it needs the histogram of
sizes only, D rows, where D * (D + 1) / 2 is at most the corpus' bytes. Each run gives ranges of ranks that go to a bin,
and a group finds its bin by its rank among the groups of its size; ranks are counted in hashed blocks.

An item over the even share of what is left gets a bin of its own; the capacity of the others is the least, to a
ten-thousandth of their mean, for which they suffice. Where one group holds more than a shard's share, sizes cannot be
equal: its shard is as large as it is, and the others are near equal.

Null texts count as empty (size 1) and are one group with empty ones, texts may be of any length, and ids may be null or
repeat. Rows with the same id and text may get any order among their slots; groups of one size are ranked by digest, so
results do not depend on the order of rows. An empty table gives an empty result. Extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.functions.numbering import row_numbers
from foldstone.llm.common import mixed64, stored, text_key, utf8

#: Rows that one task numbers, and bits of a digest that deal groups to blocks of ranks.
SLOT_BLOCK, RANK_BITS = 200_000, 12


class RoomTree:
    """Treap of (room, bin): insert, remove, and the least room that is enough, in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple) -> tuple:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, room: int, shard: int) -> None:
        left, right = self._split(self.root, (room, shard))
        priority = int(mixed64(np.array([shard * 2654435761 + room + 1], np.uint64))[0])
        self.root = self._merge(self._merge(left, [(room, shard), priority, None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the (room, bin) with the least room of at least size."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            left, right = self._split(self.root, found)
            _, right = self._split(right, (found[0], found[1] + 1))
            self.root = self._merge(left, right)
        return found


Runs = list[tuple[int, int]]
Ranges = list[tuple[int, int, int]]


def best_fit_decreasing(runs: Runs, capacity: int, most: int | None = None) -> Ranges | None:
    """(size, first rank, bin): groups of that size go to the bin from that rank on, to the next range's rank.

    runs: (size, groups), largest first. A bin that is the tightest for a size stays so as long as it takes it, so a
    run fills it at once. None if an item is larger than a bin or more than `most` bins are needed.
    """
    rooms, out, opened = RoomTree(), [], 0
    for size, count in runs:
        if size > capacity:
            return None
        rank = 0
        while rank < count:
            got = rooms.take_tightest(size)
            if got is None:
                if most is not None and opened >= most:
                    return None
                got, opened = (capacity, opened), opened + 1
            room, shard = got
            out.append((size, rank, shard))
            n = min(count - rank, room // size)
            rank += n
            rooms.insert(room - n * size, shard)
    return out


def even_bins(runs: Runs, shards: int) -> Ranges:
    """The packing of all runs into `shards` bins: large items alone, the rest by the least capacity that suffices."""
    runs = sorted((r for r in runs if r[1]), reverse=True)
    alone: Ranges = []
    total = sum(s * n for s, n in runs)
    while runs and len(alone) < shards - 1 and runs[0][0] * (shards - len(alone)) > total:
        size, count = runs[0]
        rank = next((r + 1 for s, r, _ in reversed(alone) if s == size), 0)
        alone.append((size, rank, len(alone)))
        total -= size
        runs = [(size, count - 1), *runs[1:]] if count > 1 else runs[1:]
    if not runs:
        return alone
    bins = shards - len(alone)
    low = max(-(-total // bins), runs[0][0])
    high, found = low, best_fit_decreasing(runs, low, bins)
    step = max(1, low // 10_000)
    while found is None:
        low, high, step = high + 1, high + step, step * 2
        found = best_fit_decreasing(runs, high, bins)
    while high - low > max(0, total // bins // 10_000):
        mid = (low + high) // 2
        tried = best_fit_decreasing(runs, mid, bins)
        if tried is None:
            low = mid + 1
        else:
            high, found = mid, tried
    before = {}
    for size, _, _ in alone:
        before[size] = before.get(size, 0) + 1
    return alone + [(size, rank + before.get(size, 0), shard + len(alone)) for size, rank, shard in found]


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: see the module; only ids and digests are moved."""
    spark = docs.sparkSession
    data = utf8(text)
    rows = stored(docs.select(F.col(key).alias("_key"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), text_key(text).alias("_group")), "shard-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    sizes = groups.groupBy("_bytes").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).toArrow()
    placed = even_bins(list(zip(sizes["_bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True)), shards)
    ranges: dict[int, list[dict]] = {}
    for size, rank, shard in sorted(placed):
        ranges.setdefault(size, []).append({"rank": rank, "shard": shard})
    kind = pa.schema([("_size", pa.int64()), ("_ranges", pa.list_(pa.struct([("rank", pa.int64()), ("shard", pa.int32())])))])
    bins = spark.createDataFrame(pa.table([list(ranges), list(ranges.values())], schema=kind))
    block = F.shiftrightunsigned(F.xxhash64("_group"), 64 - RANK_BITS)
    ranked = row_numbers(groups.select("_group", "_bytes"), block, [F.xxhash64("_group"), F.col("_group")], "_rank", ["_bytes"], 0)
    mine = F.element_at(F.filter("_ranges", lambda r: r["rank"] <= F.col("_rank")), -1)["shard"]
    homes = ranked.join(bins, F.col("_bytes") == F.col("_size")).select(F.col("_group").alias("_home"), mine.alias("shard"))
    out = rows.join(homes, F.col("_group") == F.col("_home"))
    blocks = max(64, sum(sizes["rows"].to_pylist()) // SLOT_BLOCK)
    out = row_numbers(out, F.pmod(F.xxhash64("_key"), F.lit(blocks)), [F.col("_key"), F.col("text_crc32")], "slot", ["shard"], 0)
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
