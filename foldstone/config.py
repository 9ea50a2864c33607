"""Engine parameters. Every size is a parameter; the defaults are the reference's."""

from __future__ import annotations

from dataclasses import dataclass

OPS = ("NOP", "WRITE2FREE", "ERASEREF", "READSSD")
LIVE_OPS = OPS[1:]


@dataclass(frozen=True)
class RoutingTable:
    """Channels of one node: (hash_start, hash_len, node_idx) each, entry 0 is the node itself."""

    entries: tuple[tuple[int, int, int], ...]
    mode: str = "nearest"
    bits: int = 16
    node_bits: int = 4

    def __post_init__(self) -> None:
        if not 1 <= len(self.entries) <= 10:
            raise ValueError("a routing table has 1 to 10 active channels")
        if self.mode not in ("nearest", "chord"):
            raise ValueError(f"unknown routing mode {self.mode!r}")
        ring = 1 << self.bits
        if any(not (0 <= s < ring and 0 <= n <= ring and 0 <= k < 1 << self.node_bits) for s, n, k in self.entries):
            raise ValueError("a start, length or node index is out of range")
        if self.mode == "chord":
            away = [(s - self.entries[0][0]) % ring for s, _, _ in self.entries]
            if away != sorted(away):
                raise ValueError("chord routing needs its entries clockwise from entry 0")


@dataclass(frozen=True)
class DedupConfig:
    page_size: int = 4096
    idx_bucket_width: int = 15
    routing_bits: int = 16
    bloom_bits_log2: int = 5
    bloom_k: int = 3
    pool_size: int = 1 << 18
    node_idx: int = 0
    #: Pages of one document that a sequence number leaves room for.
    pages_per_doc: int = 1 << 20


#: Rings used by the registered queries, on 16 routing bits.
NEAREST = RoutingTable(((61440, 8192, 12), (4096, 4096, 11), (45056, 16384, 13), (20480, 4096, 15)), "nearest")
CHORD = RoutingTable(((61440, 8192, 3), (4096, 4096, 4), (8192, 12288, 5), (32768, 4096, 7)), "chord")
#: Four nodes that own a quarter each; every one knows itself and its next neighbour clockwise.
HOP_NODES = {n: RoutingTable(((n * 16384, 16384, n), ((n + 1) % 4 * 16384, 16384, (n + 1) % 4)), "chord") for n in range(4)}
