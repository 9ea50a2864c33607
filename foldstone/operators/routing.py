"""Routing by ring arithmetic. A table has ten entries at most, so it compiles into an expression: no join, no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.config import RoutingTable
from foldstone.functions.fingerprint import ring
from foldstone.functions.numbering import row_numbers


def inside(h: Column, start: int, length: int, bits: int) -> Column:
    return ring(h - start, bits) < length


def owner(h: Column, table: RoutingTable) -> Column:
    """Channel whose half-open range holds h; of several the highest; else null."""
    return F.coalesce(*[F.when(inside(h, s, n, table.bits), F.lit(i)) for i, (s, n, _) in reversed(list(enumerate(table.entries)))])


def _nearest(dists: list[Column]) -> Column:
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dists)]))["i"]


def nearest(h: Column, table: RoutingTable) -> Column:
    """Channel with the nearest range border; ties to the lowest."""
    b = table.bits
    return _nearest([F.least(ring(F.lit(s) - h, b), ring(h - (s + n), b)) for s, n, _ in table.entries])


def _before_first_false(tests: list[Column]) -> Column:
    out = F.lit(len(tests) - 1)
    for i, t in reversed(list(enumerate(tests))):
        out = F.when(~t, F.lit(max(i - 1, 0))).otherwise(out)
    return out


def chord(h: Column, table: RoutingTable) -> Column:
    """Last channel of the leading run whose starts lie clockwise between entry 0 and h."""
    first = table.entries[0][0]
    return _before_first_false([F.lit((s - first) % (1 << table.bits)) <= ring(h - first, table.bits) for s, _, _ in table.entries])


def channel(h: Column, table: RoutingTable) -> Column:
    other = nearest if table.mode == "nearest" else chord
    return F.coalesce(owner(h, table), other(h, table)).cast("int")


def result_channel(dst: Column, table: RoutingTable) -> Column:
    """Channel of a result for node dst: that node's, else the nearest node's or the Chord predecessor's."""
    nodes, b = [n for _, _, n in table.entries], table.node_bits
    near = _nearest([F.least(ring(dst - n, b), ring(F.lit(n) - dst, b)) for n in nodes])
    if table.mode == "nearest":
        return near.cast("int")
    exact = F.coalesce(*[F.when(dst == n, F.lit(i)) for i, n in enumerate(nodes)])
    run = _before_first_false([F.lit((n - nodes[0]) % (1 << b)) <= ring(dst - nodes[0], b) for n in nodes])
    return F.coalesce(exact, run).cast("int")


def node_of(ch: Column, table: RoutingTable) -> Column:
    return F.element_at(F.array(*[F.lit(n) for _, _, n in table.entries]), ch + 1).cast("int")


def hops(df: DataFrame, h: str, src: str, nodes: dict[int, RoutingTable], limit: int = 16) -> DataFrame:
    """Adds hops and final_node: forwarded from node to node until one owns h, at most `limit` times."""

    def step(at: Column) -> Column:
        out = at
        for n, t in nodes.items():
            out = F.when(at == n, F.when(owner(F.col(h), t) == 0, F.lit(n)).otherwise(node_of(channel(F.col(h), t), t))).otherwise(out)
        return out

    out = df.withColumn("final_node", F.col(src).cast("int")).withColumn("hops", F.lit(0))
    for _ in range(min(limit, len(nodes))):
        out = out.withColumn("_next", step(F.col("final_node"))).withColumn("hops", F.col("hops") + (F.col("_next") != F.col("final_node")).cast("int")).withColumn("final_node", F.col("_next")).drop("_next")
    return out


def dealt(packets: DataFrame, block: Column, order: list[Column], n: int, m: int = 1) -> DataFrame:
    """packets with the channel, of n, that each goes to: m packets in a row to each channel in turn. Numbered in blocks
    (see row_numbers), so no task sees all packets."""
    out = row_numbers(packets, block, order, "channel", start=0)
    return out.withColumn("channel", F.pmod(F.floor(F.col("channel") / m), F.lit(n)).cast("int"))
