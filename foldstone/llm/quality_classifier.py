"""Quality classifier (operator 1): weak labels by expectation-maximisation, then a hashed linear scorer.

LABELLERS are overlapping heuristics; each votes good, bad or nothing on a document. Only the counts of vote patterns,
3 ** len(LABELLERS) rows at most, are needed to estimate each labeller's vote distribution under good and bad documents
and the share of good ones; the posterior of a pattern is the weak label of all its documents. A logistic scorer over
hashed words and word shapes is trained on these labels and scores every whole text. It is trained on the TRAIN distinct
rows of least hash of id and text, fewer if their vectors pass TRAIN_BYTES (a bound on the sample, not on what is scored
or on what EM sees), in the order of that hash: results do not depend on how rows are dealt to tasks.

Texts are read once: patterns and hashed vectors, of 2 ** BITS numbers at most however long the text, are stored, and
sampling and scoring work on these.

Null and blank texts have no features: their score is that of the bias, their votes are those of no words. Repeated rows
get equal results and count once in the sample; extra columns do not matter; ties of hashes are rows alike; on an empty
table nothing is trained and the result is empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import stored
from foldstone.llm.quality_rules import measure

TRAIN, TRAIN_BYTES = 6_000, 64 << 20
BITS, EPOCHS, BATCH, RATE, DECAY = 18, 6, 128, 0.5, 1e-6
CACHE = 300_000
#: Words from which on a text counts in full.
FULL = 40
#: Frequent function words of the corpus' languages: fixed values.
STOP = frozenset("the of and to in is it that was for on are with as de la le les des et un une que en el los las y der die das und ist nicht mit von zu den".split())

#: name: (feature, good at most, bad over) or, with the bounds the other way round, (feature, good from, bad under).
LABELLERS: dict[str, tuple[str, float, float]] = {
    "symbols": ("symbols", 0.02, 0.15),
    "capitals": ("capitals", 0.12, 0.35),
    "exclaims": ("exclaims", 0.05, 0.3),
    "repeats": ("repeats", 0.15, 0.4),
    "same_lines": ("dup_lines", 0.1, 0.4),
    "variety": ("variety", 0.35, 0.2),
    "function_words": ("stop", 0.08, 0.03),
    "word_length": ("word_length", 7.0, 8.5),
}


def features(text: str) -> dict[str, float]:
    n, chars, symbols, dup, repeats, n_lines, capitals, bangs = measure(text)
    words = text.lower().split()
    m = max(n, 1)
    return {
        "symbols": symbols / m,
        "capitals": capitals / max(chars, 1),
        "exclaims": bangs / m,
        "repeats": repeats / m,
        "dup_lines": dup / max(n_lines, 1),
        "variety": len(set(words)) / max(len(words), 1) * max(1.0, (len(words) / 300) ** 0.3),
        "stop": sum(map(STOP.__contains__, words)) / max(len(words), 1),
        "word_length": chars / m,
    }


def votes(text: str) -> int:
    """Pattern of the votes: a base-3 number, 0 nothing, 1 bad, 2 good."""
    f, code = features(text), 0
    for name, good, bad in LABELLERS.values():
        x = f[name]
        up = bad > good
        vote = 1 if (x > bad if up else x < bad) else 2 if (x <= good if up else x >= good) else 0
        code = 3 * code + vote
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))], 1)


def em(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) as (labellers, 2, 3), and the share of good."""
    v = digits(codes)
    good, bad = (v == 2).sum(1), (v == 1).sum(1)
    post = np.clip((good + 0.5) / (good + 3.0 * bad + 1.0), 0.02, 0.98)  # a start only: bad votes are rarer and weigh more
    table, share = np.full((v.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        for j in range(v.shape[1]):
            for c in range(2):
                n = np.bincount(v[:, j], weights=weight[c], minlength=3) + 0.1
                table[j, c] = n / n.sum()
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.log(table)[np.arange(v.shape[1])[None], :, v].sum(1)
        odds = np.log(share / (1 - share)) + logs[:, 1] - logs[:, 0]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, table, share


def accuracies(table: np.ndarray, share: float) -> dict[str, float]:
    """P(a vote is right, given that the labeller votes)."""
    right = share * table[:, 1, 2] + (1 - share) * table[:, 0, 1]
    cast = share * table[:, 1, 1:].sum(1) + (1 - share) * table[:, 0, 1:].sum(1)
    return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist(), strict=True))


_LETTERS = regex.compile(r"\p{L}+")


class Hasher:
    """Buckets of words: each word counts itself, its shape, and whether it came before in the text."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}
        self.mask = (1 << BITS) - 1
        self.again = zlib.crc32(b"again") & self.mask

    def of(self, word: str) -> tuple[int, int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            shape = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
            self.cache[word] = got = (zlib.crc32(b"w" + word.lower().encode()) & self.mask, zlib.crc32(b"s" + shape.encode()) & self.mask)
        return got

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights), of length 1; of less for texts under FULL words, which are less evidence."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        flat = [b for w in words for b in self.of(w)]
        flat += [self.again] * (len(words) - len(set(words)))
        buckets, n = np.unique(np.array(flat, np.int32), return_counts=True)
        x = np.sqrt(n).astype(np.float32)
        return buckets, x * np.float32(min(1.0, len(words) / FULL) / np.sqrt((x * x).sum()))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer for probabilities as labels; the last is the bias. Adagrad over mini-batches."""
    w = np.zeros((1 << BITS) + 1)
    seen = np.full(len(w), 1e-8)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), BATCH):
            part = [docs[i] for i in order[s : s + BATCH]]
            at = np.concatenate([d[0] for d in part])
            x = np.concatenate([d[1] for d in part])
            row = np.repeat(np.arange(len(part)), [len(d[0]) for d in part])
            z = np.bincount(row, w[at] * x, len(part)) + w[-1]
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[order[s : s + BATCH]]
            used, inverse = np.unique(at, return_inverse=True)
            grad = np.bincount(inverse, err[row] * x) / len(part) + DECAY * w[used]
            seen[used] += grad**2
            w[used] -= RATE * grad / np.sqrt(seen[used])
            g = err.mean()
            seen[-1] += g**2
            w[-1] -= RATE * g / np.sqrt(seen[-1])
    return w.astype(np.float32)


def _mapped(docs: DataFrame, text: str, extra: str, f: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """docs without text, with the columns that f makes of its values."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *f([v.as_py() or "" for v in batch.column(batch.num_columns - 1)])], [*keep, *[x.split()[0] for x in extra.split(", ")]])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), extra])
    return docs.select(*keep, text).mapInArrow(run, kinds)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, weak_label (posterior of good), score (of the trained scorer) and keep (score of a half or more)."""
    spark = docs.sparkSession
    state: list[Hasher] = []

    def hashed(ts: list[str]) -> list[pa.Array]:
        if not state:
            state.append(Hasher())
        got = [state[0].vector(t) for t in ts]
        return [pa.array(map(votes, ts), pa.int32()), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())]

    base = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_at"), F.col(text).alias("_text"))
    read = stored(_mapped(base, "_text", "pattern int, buckets binary, weights binary", hashed), "vectors")
    seen = read.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** len(LABELLERS) rows at most
    if not seen:
        return docs.select(key, F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(True).alias("keep")).limit(0)
    codes, counts = (np.array([r[c] for r in seen]) for c in ("pattern", "count"))
    post, _, _ = em(codes, counts.astype(float))
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))

    size = 8 + 2 * F.octet_length("buckets")
    least = read.groupBy("_at").agg(F.max(size).alias("n")).orderBy("_at").limit(TRAIN).collect()
    fits = np.cumsum([r["n"] for r in least]) <= TRAIN_BYTES
    last = least[max(0, int(fits.sum()) - 1)]["_at"]
    sample = sorted(read.filter(F.col("_at") <= F.lit(last)).dropDuplicates(["_at"]).select("_at", "pattern", "buckets", "weights").collect())  # TRAIN rows, TRAIN_BYTES
    weights = train([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in sample], np.array([posterior[r["pattern"]] for r in sample]))
    model = spark.sparkContext.broadcast(weights)  # 2 ** BITS + 1 floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            pattern, buckets, x = (batch.column(i).to_pylist() for i in (1, 2, 3))
            z = [float(w[np.frombuffer(b, np.int32)] @ np.frombuffer(v, np.float32) + w[-1]) for b, v in zip(buckets, x, strict=True)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([posterior[c] for c in pattern], pa.float64()), pa.array(p, pa.float64()), pa.array(p >= 0.5, pa.bool_())], [key, "weak_label", "score", "keep"])

    kind = docs.schema[key].dataType.simpleString()
    return read.select("_key", "pattern", "buckets", "weights").mapInArrow(score, f"`{key}` {kind}, weak_label double, score double, keep boolean")
