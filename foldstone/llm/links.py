"""Classes of linked rows: inside groups that fit a task, and over a whole graph. No side of a join is broadcast: all grow
with the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import stored

#: Rows, and bytes of payload, of one block. A group of more is dealt to blocks; nothing is left out, and no task holds
#: more than two blocks.
BLOCK, BLOCK_BYTES = 2000, 16 << 20


def sized(rows: DataFrame, group: str, weight: Column) -> DataFrame:
    """rows with `blocks`: how many blocks their group takes, by its rows and by the weight (bytes) of its payload."""
    sums = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_c"), F.sum(weight).alias("_w"))
    count = F.greatest(F.ceil(F.col("_c") / F.lit(BLOCK)), F.ceil(F.col("_w") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    return rows.hint("merge").join(sums.select("_g", count.alias("blocks")), F.col(group) == F.col("_g")).drop("_g")


def own_blocks(rows: DataFrame, group: str, node: str) -> DataFrame:
    """Adds _i and _j, both the row's own block."""
    own = F.pmod(F.xxhash64(node, group), F.col("blocks")).cast("int")
    return rows.withColumn("_i", own).withColumn("_j", own)


def pairs_of_blocks(rows: DataFrame, group: str, node: str) -> DataFrame:
    """Adds _i and _j: a row goes to each pair of blocks that has its own."""
    out = own_blocks(rows, group, node).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A group of several blocks needs no pair of a block with itself: any two that include it see all of it.
    out = out.filter((F.col("blocks") == 1) | (F.col("_i") != F.col("_o")))
    return out.withColumn("_j", F.greatest("_i", "_o")).withColumn("_i", F.least("_i", "_o")).drop("_o")


def group_edges(rows: DataFrame, group: str, node: str, weight: str, load_rows: Callable[[DataFrame], DataFrame], payload: str, load: Callable[[object], np.ndarray], link: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(a, b) edges whose components, with those of other groups, are the classes of linked rows(group, node, weight).

    load_rows adds the payload. Every block links its own rows. Groups of several blocks then link their blocks' classes
    by one row of each; most groups of near copies are one component after that. Only in groups that are not, rows that
    were not yet compared could still link two components: there every two blocks meet, which is exact, and costs the
    square of the blocks of such a group.
    """

    def edges(dealt: DataFrame) -> DataFrame:
        return grouped_edges(load_rows(dealt), [group, "_i", "_j"], node, payload, load, link)

    all_rows = sized(rows, group, F.col(weight))
    first = edges(own_blocks(all_rows, group, node))
    many = stored(all_rows.filter("blocks > 1").select(group, node, weight, "blocks"), "large-groups")
    if many.isEmpty():
        return first.select("a", "b")
    first = stored(first, "block-edges")
    followers = first.select(F.col("of").alias("_of"), F.col("a").alias("_a"))
    leaders = many.drop("blocks").hint("merge").join(followers, (F.col(group) == F.col("_of")) & (F.col(node) == F.col("_a")), "left_anti")
    both = first.unionByName(stored(edges(pairs_of_blocks(sized(leaders, group, F.col(weight)), group, node)), "leader-edges"))
    roots = components(both.select("a", "b")).select(F.col("node").alias("_node"), "root")
    rooted = many.hint("merge").join(roots, F.col(node) == F.col("_node"), "left").withColumn("root", F.coalesce("root", F.col(node)))
    split = stored(rooted.groupBy(F.col(group).alias("_g")).agg((F.min("root") != F.max("root")).alias("_open")).filter("_open").select("_g"), "split-groups")
    if not split.isEmpty():
        both = both.unionByName(edges(pairs_of_blocks(many.hint("merge").join(split, F.col(group) == F.col("_g"), "left_semi"), group, node)))
    return both.select("a", "b")


def classes(n: int, row: Callable[[int], np.ndarray]) -> np.ndarray:
    """Class (its least index) of each of n items; row(i) says which items are linked to i.

    First each item that nothing yet covers is compared with all. What remains are links between items covered from
    different classes: those rows are looked at until one class is left.
    """
    root = np.arange(n)
    covered = np.zeros(n, bool)
    lead = []

    def join(m: np.ndarray) -> None:
        old = np.unique(root[m])
        if len(old) > 1:
            root[np.isin(root, old)] = old[0]

    for i in range(n):
        if not covered[i]:
            lead.append(i)
            m = row(i)
            m[i] = True
            join(m)
            covered |= m
    if len(lead) < n:
        leads = set(lead)
        for i in range(n):
            if (root == root[0]).all():
                break
            if i not in leads:
                m = row(i)
                m[i] = True
                join(m)
    return root


def grouped_edges(rows: DataFrame, keys: list[str], node: str, payload: str, load: Callable[[object], np.ndarray], link: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(of, a, b): each node of a group with the least node of its class there, where these differ.

    Groups are runs of equal keys in sorted partitions, so small ones cost little; load() makes an item of a payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, items = None, [], []
        out: list[tuple] = []
        kind = pa.binary()

        def made(of: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((of, pa.binary(), pa.binary()))], ["of", "a", "b"])

        def close() -> None:
            if len(nodes) > 1:
                root = link(items)
                for c in np.unique(root):
                    members = [nodes[i] for i in np.flatnonzero(root == c)]
                    least = min(members)
                    out.extend((key[0], m, least) for m in members if m != least)

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for *k, name, data in zip(*lists, strict=True):
                if k != key:
                    close()
                    key, nodes, items = k, [], []
                elif nodes and nodes[-1] == name:
                    continue  # the same row again
                nodes.append(name)
                items.append(load(data))
            if out:
                yield made(batch.schema.field(0).type)
                out.clear()
            kind = batch.schema.field(0).type
        close()
        if out:
            yield made(kind)

    dealt = rows.select(*keys, node, payload).repartition(*keys).sortWithinPartitions(*keys, node)
    return dealt.mapInArrow(run, f"of {rows.schema[keys[0]].dataType.simpleString()}, a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the graph with the least node of its component.

    Large-star and small-star steps in turn; each is an aggregation and a join, so a node with very many neighbours is
    split like any skewed join. Every round is stored.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:  # rounds grow with the logarithm of the longest path
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = stored(small.filter("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
