"""Index allocation with recycling: sequential by nature, so it runs on allocation and free events only, node by node.

A node's events stream through its task in order, in Arrow batches; memory holds its pool, never its events.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pool:
    """Indices 1..size of one node; recycled indices go first, oldest first; 0 is never used."""

    def __init__(self, size: int) -> None:
        self.size, self.fresh = size, 0
        self.free: deque[int] = deque()
        self.held: dict = {}

    def step(self, key: object, is_alloc: bool) -> int:
        """Index that an allocation gets or a free gives back."""
        if not is_alloc:
            idx = self.held.pop(key)
            self.free.append(idx)
            return idx
        if self.free:
            idx = self.free.popleft()
        else:
            self.fresh += 1
            if self.fresh > self.size:
                raise OverflowError(f"all {self.size} indices are in use")
            idx = self.fresh
        self.held[key] = idx
        return idx


def allocate(events: list[tuple[object, bool]], pool_size: int) -> list[int]:
    """events: (key, is_alloc) in order. Index of each event."""
    pool = Pool(pool_size)
    return [pool.step(key, is_alloc) for key, is_alloc in events]


def recycled_lba(counted: DataFrame, node: F.Column, pool_size: int) -> DataFrame:
    """(seq, node_idx, fingerprint, kind, ssd_lba) of every allocation and free; nodes have pools of their own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pool = None, Pool(pool_size)
        for pdf in parts:
            lba = []
            for n, key, kind in zip(pdf["node_idx"], pdf["fingerprint"], pdf["kind"], strict=True):
                if n != at:
                    at, pool = n, Pool(pool_size)
                lba.append(pool.step(key, kind == "alloc"))
            yield pdf.assign(ssd_lba=lba)

    events = counted.filter("is_alloc or is_gc").select("seq", node.cast("int").alias("node_idx"), "fingerprint", F.when(F.col("is_alloc"), "alloc").otherwise("free").alias("kind"))
    dealt = events.repartition("node_idx").sortWithinPartitions("node_idx", "seq")
    return dealt.mapInPandas(run, "seq long, node_idx int, fingerprint string, kind string, ssd_lba long")
