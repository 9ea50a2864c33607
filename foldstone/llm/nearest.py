"""Approximate nearest neighbours by inner product (operator 9): score-aware anisotropic quantisation.

Vectors are dealt to cells by k-means, and what is left of them after their cell's centre is quantised: two dimensions
to a 4-bit code, under a loss that weighs the error along the vector ETA times that across it, as only the former moves
large inner products. A query's tables hold its products with all codewords; scans of two codes a byte through them
give estimates. Of each block all entries are scored exactly whose estimate is at most REACH standard errors under the
k-th best one (however many: in a dense cluster estimates cannot tell entries apart), and the best k of all remain.

The model is fitted on SAMPLE rows at most (those of least hash); every row is indexed. Cells are probed in order of
the query's product with their centres; how many is the least number that held TARGET of the sample's true neighbours
(at this data's weak clustering most cells, so it is a scan by blocks; on clustered data few). Equal vectors are one
entry with its k + 1 smallest ids, so a vector that very many rows share costs one scan. Entries stay in blocks of BLOCK
or so, each in one task; queries go to the blocks that hold a cell they probe and stream through these tasks in batches,
so no entry is copied and a task's memory is that of its block.

Rows with a null id, and vectors that are null, empty, zero, of other length than most, or hold null or non-finite
components take no part. Rows repeated with the same id and vector count once; an id with several vectors is one
candidate for each. Ties go to the smaller id. An empty table gives an empty result, and extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.common import stored

SAMPLE, CELLS, TARGET = 20_000, 1024, 0.985
BLOCK, REACH = 4096, 3.0
#: Queries that a task scores at once.
AT_ONCE = 64
#: Inner products that count as large are over THRESHOLD times the norm.
THRESHOLD = 0.2
ROUNDS, WORDS = 6, 16


def vectors(rows: DataFrame, key: str, value: str) -> DataFrame:
    """vec_id, vec: usable vectors as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.as_py()
                if i is None or not x or None in x:
                    continue
                a = np.array(x, "<f8") + 0.0
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return rows.select(F.col(key).cast("long").alias(key), value).mapInArrow(run, "vec_id long, vec binary")


class Model:
    """Centres (cells, d), codewords (d / 2, 16, 2) and the number of cells to probe."""

    def __init__(self, x: np.ndarray, count: int, k: int) -> None:
        rng = np.random.default_rng(7)
        self.dim = x.shape[1]
        cells = max(1, min(CELLS, int(np.sqrt(count) / 2), len(x) // 20))
        self.centres = x[rng.choice(len(x), cells, replace=False)].copy()
        for _ in range(8):
            at = self.cell(x)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, at, x)
            n = np.bincount(at, minlength=cells)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        d = self.dim + self.dim % 2
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rest, unit = self._parts(x)
        self.words = np.stack([rest[rng.choice(len(x), WORDS, replace=len(x) < WORDS), m] for m in range(d // 2)])
        for _ in range(ROUNDS):
            self._refit(rest, unit, self._codes(rest, unit))
        self.probes = self._probes(x, k)
        self.error = self._error(x)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the centres leave, and the direction of each vector, both (n, d / 2, 2)."""
        rest = x - self.centres[self.cell(x)]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        wide = lambda a: np.pad(a, ((0, 0), (0, self.dim % 2))).reshape(len(a), -1, 2)
        return wide(rest), wide(unit)

    def _codes(self, rest: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Coordinate descent on |e|^2 + (eta - 1) (e . u)^2, one pair of dimensions at a time."""
        n, m = rest.shape[:2]
        codes = np.stack([((rest[:, j, None] - self.words[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
        along = np.stack([((rest[:, j] - self.words[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for _ in range(2):
            for j in range(m):
                e = rest[:, j, None] - self.words[j]
                a = (e * unit[:, j, None]).sum(2)
                others = total - along[:, j]
                best = ((e**2).sum(2) + (self.eta - 1) * (others[:, None] + a) ** 2).argmin(1)
                codes[:, j] = best
                along[:, j] = a[np.arange(n), best]
                total = others + along[:, j]
        return codes

    def _refit(self, rest: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword to the least loss for the vectors that have it: a 2 x 2 system."""
        m = rest.shape[1]
        along = np.stack([((rest[:, j] - self.words[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            others = total - along[:, j]
            for w in range(WORDS):
                at = codes[:, j] == w
                if not at.any():
                    continue
                u, r = unit[at, j], rest[at, j]
                left = np.eye(2) * at.sum() + (self.eta - 1) * u.T @ u
                right = r.sum(0) + (self.eta - 1) * (u * (others[at] + (r * u).sum(1))[:, None]).sum(0)
                self.words[j, w] = np.linalg.solve(left, right)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes, two to a byte."""
        codes = self._codes(*self._parts(x)).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return self.cell(x), codes[:, ::2] | codes[:, 1::2] << 4

    def _probes(self, x: np.ndarray, k: int) -> int:
        """Cells that hold TARGET of the true neighbours of up to 300 of the sample's vectors."""
        q = x[:: max(1, len(x) // 300)]
        s = q @ x.T
        k = min(k + 1, len(x))
        top = np.argpartition(-s, k - 1, 1)[:, :k]
        place = np.argsort(np.argsort(-(q @ self.centres.T), 1, "stable"), 1)
        ranks = np.sort(np.take_along_axis(place, self.cell(x)[top], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1

    def _error(self, x: np.ndarray) -> float:
        """Standard error of an estimate, for queries of length 1."""
        part, q = x[:4000], x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True)
        return float((self.scan(q, *self.encode(part)) - q @ part.T).std())

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """(queries, cells): whether a cell is probed; on beyond `probes` until the cells hold `least` entries."""
        order = np.argsort(-(q @ self.centres.T), 1, "stable")
        before = np.cumsum(sizes[order], 1) - sizes[order]
        take = (np.arange(order.shape[1]) < self.probes) | (before < least)
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, 1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): product with what each byte of two codes stands for."""
        wide = np.pad(q, ((0, 0), (0, self.words.shape[0] * 2 - self.dim))).reshape(len(q), -1, 2)
        one = np.einsum("qmd,mwd->qmw", wide, self.words)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)

    def scan(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, entries): estimated products."""
        t, columns = self.tables(q), np.ascontiguousarray(codes.T)
        out = (q @ self.centres.T).astype(np.float32)[:, cells]
        for i in range(len(q)):
            row = out[i]
            for j in range(columns.shape[0]):
                row += t[i, j].take(columns[j])
        return out


def _matrix(cells: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def search(rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`, itself left out."""
    usable = stored(vectors(rows, key, value).withColumn("_k", F.unhex(F.md5("vec"))), "vectors")
    dims = usable.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    usable = usable.filter(F.length("vec") == dims["n"])
    ids = usable.select("_k", "vec_id").distinct()
    first = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    entries = first.groupBy("_k").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.filter(F.col("vec_id") % every == 0)
    one = usable.groupBy("_k").agg(F.first("vec").alias("vec"))
    flagged = one.join(entries, "_k").join(asked.select("_k").distinct().withColumn("_q", F.lit(True)), "_k", "left")
    distinct = stored(flagged.withColumn("_q", F.coalesce("_q", F.lit(False))), "entries")
    count = distinct.count()
    sample = distinct.select("vec", F.xxhash64("_k").alias("h")).orderBy("h").limit(SAMPLE).collect()
    model = Model(np.stack([np.frombuffer(r["vec"], "<f8") for r in sample]), count, k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, codes = model.encode(_matrix(batch.column(1).to_pylist(), "<f8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "cell", "codes"])

    index = stored(distinct.select("_k", "vec", "ids", "_q").mapInArrow(encode, "_k binary, vec binary, ids array<long>, _q boolean, cell int, codes binary"), "index")
    sizes = np.zeros(len(model.centres), np.int64)
    for r in index.groupBy("cell").count().collect():  # CELLS rows at most
        sizes[r["cell"]] = r["count"]
    # Cells in order fill blocks; a cell larger than a block is dealt over several of its own.
    first_block, parts, room, block = np.zeros(len(sizes), int), np.maximum(1, -(-sizes // BLOCK)), BLOCK, 0
    for c, n in enumerate(sizes):
        if n > room:
            block, room = block + 1, BLOCK
        first_block[c] = block
        if n > BLOCK:
            block, room = block + int(parts[c]), BLOCK
        else:
            room -= n
    least = 20 * (k + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            took = model.probed(_matrix(batch.column(1).to_pylist(), "<f8"), sizes, least)
            blocks = [sorted({int(b) for c in np.flatnonzero(row) for b in range(first_block[c], first_block[c] + parts[c])}) for row in took]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.list_(pa.int32()))], ["_k", "vec", "blocks"])

    lookup = F.array(*[F.lit(int(x)) for x in first_block])
    split = F.array(*[F.lit(int(x)) for x in parts])
    home = (F.element_at(lookup, F.col("cell") + 1) + F.pmod(F.xxhash64("_k"), F.element_at(split, F.col("cell") + 1))).cast("int")
    have = index.select(home.alias("block"), F.lit(0).alias("kind"), F.col("ids")[0].alias("first"), "_k", "vec", "ids", "cell", "codes")
    want = index.filter("_q").select("_k", "vec").mapInArrow(ask, "_k binary, vec binary, blocks array<int>")
    want = want.select(F.explode("blocks").alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "_k", "vec")
    met = have.unionByName(want, allowMissingColumns=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        parts: list[tuple] = []  # entries of the block: they come before its queries, in order of their least ids
        block: tuple | None = None

        def scored(keys: list[bytes], q: np.ndarray) -> list[tuple]:
            x, cells, codes, ids = block
            out: list[tuple] = []
            short = min(k + 1, len(x))
            got = np.where(model.probed(q, sizes, least)[:, cells], model.scan(q, cells, codes), -np.inf)
            bars = -np.partition(-got, short - 1, 1)[:, short - 1] - REACH * model.error * np.linalg.norm(q, axis=1)
            for i, bar in enumerate(bars):
                row = np.flatnonzero((got[i] >= bar) & np.isfinite(got[i]))
                exact = (x[row] * q[i]).sum(1)
                took = 0
                for j in np.lexsort((row, -exact)):
                    if took > k:
                        break
                    out += [(keys[i], int(v), float(exact[j])) for v in ids[row[j]]]
                    took += len(ids[row[j]])
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            found: list[tuple] = []
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                if blocks[s] != at:
                    at, parts, block = blocks[s], [], None
                part = batch.slice(s, e - s)
                vec = _matrix(part.column("vec").to_pylist(), "<f8")
                if not kinds[s]:
                    parts.append((vec, part.column("cell").to_numpy(), _matrix(part.column("codes").to_pylist(), np.uint8), part.column("ids").to_pylist()))
                    continue
                if not parts and block is None:
                    continue  # no entry fell into this block
                if block is None:
                    block = (*[np.concatenate([p[i] for p in parts]) for i in range(3)], [v for p in parts for v in p[3]])
                    parts = []
                keys = part.column("_k").to_pylist()
                for i in range(0, len(keys), AT_ONCE):
                    found += scored(keys[i : i + AT_ONCE], vec[i : i + AT_ONCE])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.float64()), strict=True)], ["_k", "vec_id", "score"])

    found = met.repartition("block").sortWithinPartitions("block", "kind", "first").mapInArrow(best, "_k binary, vec_id long, score double")
    order = Window.partitionBy("_k").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    lists = kept.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, "_k").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("_p", "_x")).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))
