"""Packing (operator 7): shortest-pack-first over the histogram of lengths.

Texts become token ids, each followed by an end id, and are cut into pieces of `size` ids at most. The histogram of
piece lengths has `size` rows however large the corpus is; it is packed on the driver, longest lengths first, each into
the fullest-free (shortest) pack, by counts of packing patterns. The patterns become ranges of (length, rank within the
length), and every piece finds its sequence and offset by its own rank. Ranks are counted in hashed blocks, so a length
that a third of all pieces have is no single task.

Null and empty texts are the end id alone. Repeated rows are packed once each; pieces that agree in key and start may
swap places. Only ids' checksums and positions are moved, never texts.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.functions.numbering import row_numbers
from foldstone.llm.common import stored

#: Rows that one task ranks.
RANK_BLOCK = 200_000
#: Characters on whose classes all Unicode versions agree; texts with others go to the library whole.
PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]")
#: How byte-level BPE splits text before merging: a fixed value of the vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 3 apples,\n\n  naïve  über-words!! ¿42² $$$ tabs\tand\r\nspaces "


def plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return OTHER.search(text) is None


class IdWriter:
    """Little-endian uint32 ids of texts, as the tokenizers library gives them.

    Where the file is a plain byte-level BPE whose merges rank as their ids do, tiktoken's merging, built from that same
    file, gives the same ids three times as fast; it gets the texts of plain characters. Texts with other characters or
    with a special token's string, and files of other kinds, go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.lib = tokenizers.Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec)
        if self.fast is not None and self._whole(PROBE) != self.fast.encode_to_numpy(PROBE, disallowed_special=()).tobytes():
            self.fast = None

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("dropout"):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        # Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.special) or not plain(text):
            return self._whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()


@lru_cache(maxsize=2)
def writer(path: str) -> IdWriter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return IdWriter(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, end = writer(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = w.ids(value.as_py() or "") + end
                n = len(ids) // 4
                for s in range(0, n, size):
                    part = ids[4 * s : 4 * (s + size)]
                    at.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]], [key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, packs) of each pattern. Lengths go longest first to the pack with most room; if none has enough, as many
    packs are opened as the pieces of that length need."""
    done: list[tuple[tuple[int, ...], int]] = []
    heap: list[list] = []  # [used, pattern, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} ids does not fit {size}")
        while left:
            if not heap or heap[0][0] + length > size:
                opened = -(-left // (size // length))
                heapq.heappush(heap, [length, (length,), opened])
                left -= opened
                continue
            used, pattern, packs = heapq.heappop(heap)
            n = min(left, packs)
            if packs > n:
                heapq.heappush(heap, [used, pattern, packs - n])
            filled = [used + length, (*pattern, length), n]
            if filled[0] == size:
                done.append((filled[1], n))
            else:
                heapq.heappush(heap, filled)
            left -= n
    return sorted(done + [(p, n) for _, p, n in heap], reverse=True)


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): ranks from there on go to sequences from there on."""
    rows, taken, base = [], {}, 0
    for pattern, packs in patterns:
        at = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, base, at))
            taken[length] = rank + packs
            at += length
        base += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (which are read more than once)."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `size` rows at most
    table = ranges(shortest_pack_first(counts, size))
    blocks = max(16, sum(counts.values()) // RANK_BLOCK)
    ranked = row_numbers(cut, F.pmod(F.xxhash64(key, "start"), F.lit(blocks)), [F.col(key), F.col("start")], "_rank", ["length"], 0)
    wide = np.int64(1 << 44)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, end_id, size, key, text), "pieces"), size, key)


def padding(patterns: list[tuple[tuple[int, ...], int]], size: int) -> int:
    """Ids of padding; a sequence whose ids are a power of two stays at that length."""
    return sum(n * (0 if (u := sum(p)) & (u - 1) == 0 else size - u) for p, n in patterns)

