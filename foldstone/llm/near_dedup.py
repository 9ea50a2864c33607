"""MinHash near-dedup (operator 4): ProbMinHash, banding, verification.

Every text is its set of five-word shingles. Each shingle is a Poisson process with its weight as rate, whose arrivals
fall on random registers; a register keeps the shingle that arrived first. Two texts agree in a register with the
probability Jaccard similarity of their weights. All weights are 1, whatever the counts, so that this is the similarity
that is verified: a passage repeated in one of two texts takes nothing from their agreement. Rounds of arrivals go on
only for shingles that can still be first somewhere, which ends early for most.

Registers are banded; texts that share a band meet in a bucket, where all their registers are compared: a pair that
agrees in SIFT of them or more is a candidate. Components of candidates are then verified, all pairs whose classes
differ, by the Jaccard similarity of their shingle sets, which has to be THRESHOLD or more. A class is a component of
verified links. With ROWS registers in each of BANDS bands a pair of similarity 0.8 has none in common once in 300,000
and stays under SIFT about as rarely.

Equal texts are one node from the start, so copies cost nothing later. Groups are compared in blocks bounded in rows and
bytes (links.py); a large group of copies of one text costs its blocks, not their square.

All joins are merged by sorting, whatever the sizes: every side grows with the corpus, and Spark takes a packed table, or
one with a list of keys in each row, for much smaller than its rows are on the driver that would broadcast them.

Null text counts as empty; texts without words equal each other only if they are the same characters; texts may be of any
length, a text's shingles have to fit a task. Rows that repeat an id and text each get the same class; null ids are given
the class of their text. Ties do not arise: the least id of a class names it, and where ids repeat the digest of the text
decides. An empty table gives an empty result. Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import mixed64, stored, text_key, unused
from foldstone.llm.links import classes, components, group_edges
from foldstone.llm.shingles import shingles

THRESHOLD, SIFT = 0.8, 0.6
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Shingles that are hashed at once, and texts that a task remembers so as not to sign copies again.
CHUNK, SEEN = 200_000, 100_000
_STEP = 0x9E3779B97F4A7C15


def registers(sets: list[tuple[np.ndarray, np.ndarray]], count: int = REGISTERS) -> np.ndarray:
    """(texts, count) uint64: the first shingle of each register. sets: (hashes, weights) of each text, none empty."""
    e = np.concatenate([h for h, _ in sets])
    w = np.concatenate([x for _, x in sets])
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    at, best = np.zeros(len(e)), np.full(len(sets) * count, np.inf)
    out = np.zeros(len(sets) * count, np.uint64)
    turn = 0
    while len(e):
        a, b = (mixed64(e + np.uint64((turn + i) * _STEP % (1 << 64))) for i in (1, 2))
        turn += 2
        at = at - np.log1p(-(a >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        to = doc * count + (b % np.uint64(count)).astype(np.int64)
        np.minimum.at(best, to, at)
        first = at == best[to]
        out[to[first]] = e[first]
        # The process of a shingle ends once its next arrivals are later than every register's first.
        go = at < best.reshape(-1, count).max(1)[doc]
        e, w, doc, at = e[go], w[go], doc[go], at[go]
    return out.reshape(-1, count)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    h = np.unique(shingles(text.split()))
    return h, np.ones(len(h))


def bands(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64 keys."""
    parts = regs.reshape(len(regs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed64(key ^ parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """node, short (registers of 16 bits), keys, of docs(node, text); texts without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(nodes: list, sets: list) -> pa.RecordBatch:
            regs = registers(sets)
            short = (regs & np.uint64(0xFFFF)).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in short], pa.binary()), pa.array(list(bands(regs)), pa.list_(pa.int64()))], ["node", "short", "keys"])

        seen: set[bytes] = set()
        for batch in batches:
            nodes, sets, size = [], [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue  # a copy that this task has signed
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                h, w = weighted(text.as_py() or "")
                if not len(h):
                    continue
                nodes.append(node)
                sets.append((h, w))
                size += len(h)
                if size > CHUNK:
                    yield made(nodes, sets)
                    nodes, sets, size = [], [], 0
            if nodes:
                yield made(nodes, sets)

    return docs.mapInArrow(run, "node binary, short binary, keys array<long>")


def _sifted(items: list[np.ndarray]) -> np.ndarray:
    s = np.stack(items)
    need = SIFT * s.shape[1]
    return classes(len(s), lambda i: (s == s[i]).sum(1) >= need)


def _verified(items: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in items])
    _, ids = np.unique(np.concatenate(items), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(ids.max() + 1, bool)

    def row(i: int) -> np.ndarray:
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[own] = False
        # |A and B| / |A or B| >= 4 / 5 in whole numbers: no rounding at the threshold
        return both * 10 >= round(THRESHOLD * 10) * (sizes + sizes[i] - both)

    return classes(len(items), row)


def candidates(sigs: DataFrame) -> DataFrame:
    """(a, b) edges between nodes whose registers agree enough, through shared bands."""
    rows = sigs.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = rows.hint("merge").join(shared.select("key"), "key").select("key", "node", F.lit(2 * REGISTERS).alias("bytes"))
    return group_edges(met, "key", "node", "bytes", lambda x: x.hint("merge").join(sigs.select("node", "short"), "node"), "short", lambda x: np.frombuffer(x, "<u2"), _sifted)


def _nodes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_key, node) of every row, and (node, _first, root) of every text: its least key and its class."""
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), text_key(text).alias("node"))
    named = stored(base.select("_key", "node"), "nodes")
    first = named.groupBy("node").agg(F.min("_key").alias("_first"), F.count("*").alias("_copies"))
    made = signatures(base.select("node", "_text"))
    sigs = stored(made.groupBy("node").agg(F.first("short").alias("short"), F.first("keys").alias("keys")), "signatures")
    near = stored(components(candidates(sigs)), "candidates")
    members = stored(near.hint("merge").join(first, "node").select(F.col("root").alias("group"), "node", "_first"), "members")
    held = (F.col("node") == F.col("_n")) & F.col("_key").eqNullSafe(F.col("_first"))
    texts = stored(base.hint("merge").join(members.select("group", F.col("node").alias("_n"), "_first"), held).select("group", "node", "_text", F.octet_length("_text").alias("bytes")).dropDuplicates(["group", "node"]), "texts")
    own = texts.select(F.col("group").alias("_group"), F.col("node").alias("_n"), "_text")
    load = lambda x: x.hint("merge").join(own, (F.col("group") == F.col("_group")) & (F.col("node") == F.col("_n"))).drop("_group", "_n")
    links = group_edges(texts.select("group", "node", "bytes"), "group", "node", "bytes", load, "_text", lambda t: np.unique(shingles(t.split())), _verified)
    roots = components(links)
    of_node = first.hint("merge").join(roots, "node", "left").select("node", "_first", "_copies", F.coalesce("root", "node").alias("root"))
    return named, stored(of_node, "classes")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id and class_size: every row with the least key of its class of near-duplicates (null if none of it has
    a key), and the rows of that class."""
    named, of_node = _nodes(docs, key, text)
    ids = of_node.groupBy("root").agg(F.min("_first").alias("class_id"), F.sum("_copies").alias("class_size"))
    return named.hint("merge").join(of_node.hint("merge").join(ids, "root").select("node", "class_id", "class_size"), "node").select(F.col("_key").alias(key), "class_id", "class_size")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each class the row with the least key stays, once.

    A row is its key and text: rows without a key, or with one that other texts have too, are told apart by their texts.
    """
    _, of_node = _nodes(docs, key, text)
    order = F.struct(F.col("_first").isNull().alias("no_key"), F.col("_first").alias("key"), F.col("node").alias("node"))
    kept = of_node.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.key").alias("_kept"), F.col("x.node").alias("_kept_node"))
    own, k, n = (unused(c, docs.columns) for c in ("_own", "_kept", "_kept_node"))
    rows = docs.withColumn(own, text_key(text))
    stay = rows.hint("merge").join(kept.toDF(k, n), (F.col(own) == F.col(n)) & F.col(key).eqNullSafe(F.col(k)), "left_semi")
    return stay.dropDuplicates([key, own]).drop(own)
