"""Token counts (operator 2): exact counts at every prefix by dynamic programming.

A token sequence is the encoding of its text exactly if every two neighbours in it are the encoding of theirs. So the
last token of a prefix is the one token that ends there and is compatible with the last token of the prefix before it,
and count(prefix) = count(prefix without that token) + 1: one pass over the characters, with the compatibility of pairs
remembered, gives the count at every prefix, in a word of a million characters too. Characters outside the vocabulary
are as many tokens as they have bytes and never merge.

The vocabulary's merges never cross from a non-space into a space or touch a newline (checked when it is loaded), so
counts of segments, a run of spaces with the word after it or a newline, add up: a text's table is the sum of its
segments' tables. Totals of short segments are kept between texts, in a cache bounded in characters; the table inside a
segment is made where a cut falls into it, or for all by prefix_tables(). No prefix is ever encoded again. A vocabulary
that the checks find to be of another kind is one segment a text and is encoded prefix by prefix.

Null and empty texts have 0 tokens. Very long texts and words cost time and memory in proportion to their length. Texts
at the limit are not over it. Repeated rows give repeated results, ties do not arise, an empty table gives an empty
result, and extra columns may have any name: only key and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: Characters of segments, and pairs of tokens, that each worker remembers; longer segments are not kept.
CACHE, PAIRS, SHORT = 6_000_000, 500_000, 64
SEGMENT = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")
CROSSING = re.compile(r"[^▁]▁|\n")
PROBE = "  a▁ b\n c  there's 12,000 naïve 漢字!! "


class PrefixCounter:
    def __init__(self, model: str) -> None:
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        pieces = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not any(f(i) for f in kinds)}
        self.base = len(lib.encode("\n"))
        self.cache: dict[str, int] = {}
        self.kept = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids = {p: i for p, i in pieces.items() if self._encoded(p) == [i]}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        whole = [len(lib.encode(PROBE[:i])) for i in range(len(PROBE) + 1)]
        self.exact = [0, *self.inside(" " + PROBE)[2:]] == whole
        self.splits = self.exact and not any(map(CROSSING.search, pieces))
        self.splits = self.splits and sum(self.totals(SEGMENT.findall(" " + PROBE))) == whole[-1]

    def _encoded(self, text: str) -> list[int]:
        """Ids of a text as they are in the middle of another one."""
        return self.lib.encode("\n" + text)[self.base :]

    def _compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = got = self._encoded(a + b) == [self.ids[a], self.ids[b]]
        return got

    def inside(self, segment: str) -> list[int]:
        """Tokens of every prefix of a segment, the empty one first."""
        s, ids, lengths = segment.replace(" ", "▁"), self.ids, self.lengths
        count: list[int] = [0]
        last: list[str | None] = [None]  # of each prefix, its last token; None where no merge can reach
        for i, char in enumerate(s, 1):
            for n in lengths.get(char, ()):
                if n <= i:
                    token = s[i - n : i]
                    if token in ids and (last[i - n] is None or self._compatible(last[i - n], token)):
                        count.append(count[i - n] + 1)
                        last.append(token)
                        break
            else:
                count.append(count[-1] + len(char.encode("utf-8", "surrogatepass")))
                last.append(None)
        return count

    def totals(self, segments: list[str]) -> list[int]:
        """Tokens of whole segments, of which short ones are remembered."""
        cache = self.cache
        try:
            return list(map(cache.__getitem__, segments))
        except KeyError:
            pass
        if self.kept > CACHE:
            cache.clear()
            self.kept = 0
        missing = [s for s in set(segments) if s not in cache]
        new = dict(zip(missing, (len(x) - self.base for x in self.lib.encode(["\n" + s for s in missing], num_threads=1)), strict=True))
        short = {s: n for s, n in new.items() if len(s) <= SHORT}
        cache.update(short)
        self.kept += sum(map(len, short))
        return [new[s] if s in new else cache[s] for s in segments]

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, tokens): prefixes of `ends` characters have `tokens` tokens. Starts with (0, 0)."""
        if not text:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        if not self.splits:
            return np.array([0, len(text)]), np.array([0, len(self.lib.encode(text))])
        segments = SEGMENT.findall(" " + text)
        ends = np.cumsum([0, *map(len, segments)]) - 1
        ends[0] = 0
        return ends, np.cumsum([0, *self.totals(segments)])

    def within(self, text: str, table: tuple[np.ndarray, np.ndarray], j: int) -> np.ndarray:
        """Tokens of the prefixes from ends[j] to ends[j + 1] characters."""
        ends, tokens = table
        start, end = int(ends[j]), int(ends[j + 1])
        if not self.exact:
            return np.array([len(self.lib.encode(text[:i])) for i in range(start, end + 1)])
        got = self.inside(text[start:end])[1:] if j else self.inside(" " + text[:end])[2:]  # a text begins as after a space
        return np.append(tokens[j], tokens[j] + np.array(got, np.int64))

    def every(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, the empty one first."""
        table = self.table(text)
        return np.concatenate([table[1][:1], *[self.within(text, table, j)[1:] for j in range(len(table[0]) - 1)]])

    def count_at(self, text: str, table: tuple[np.ndarray, np.ndarray], at: int) -> int:
        """Tokens of text[:at]."""
        ends, tokens = table
        at = max(0, min(at, len(text)))
        if not at:
            return 0
        j = int(np.searchsorted(ends, at, "right")) - 1
        return int(tokens[j]) if ends[j] == at else int(self.within(text, table, j)[at - int(ends[j])])

    def longest_prefix(self, text: str, table: tuple[np.ndarray, np.ndarray], budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        ends, tokens = table
        j = int(np.searchsorted(tokens, budget, "right")) - 1
        if j < 0 or j == len(ends) - 1:
            return 0 if j < 0 else len(text)
        return int(ends[j]) + int(np.flatnonzero(self.within(text, table, j) <= budget)[-1])


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def token_counts(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, and fit_chars: the characters of the longest prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            sizes, totals, fits = [], [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                prefixes = c.table(t)
                n = int(prefixes[1][-1])
                sizes.append(len(t.encode()))
                totals.append(n)
                fits.append(len(t) if n <= limit else c.longest_prefix(t, prefixes, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())], [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens array<int>: the count at every prefix, the empty one first, to be stored beside the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):  # a row at a time: a table is longer than its text
                tokens = c.every(value.as_py() or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays([0, len(tokens)], tokens)], [key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens array<int>")
