"""Sharding, mixing, near-dedup, substring dedup, nearest neighbours and the pipeline against brute force."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldstone.llm import links, mixing, near_dedup, nearest, sharding, substring_dedup
from foldstone.llm.common import stored
from foldstone.llm.shingles import shingles

DATA = "/root/testdata/sf0.01"


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


# --- sharding


def packed_one_by_one(sizes, capacity):
    """Bins of items, largest first, each in the bin with the least room that takes it."""
    rooms, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(capacity)
        b = min(fits)[1] if fits else len(rooms) - 1
        rooms[b] -= size
        out.append((size, b))
    return out


def items(ranges, runs):
    """(size, bin) of each item of each run, in rank order."""
    out = []
    for size, count in sorted(runs, reverse=True):
        mine = sorted(r[1:] for r in ranges if r[0] == size)
        out += [(size, [b for at, b in mine if at <= rank][-1]) for rank in range(count)]
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=12), st.integers(100, 160))
def test_best_fit_of_runs_is_best_fit_of_items(histogram, capacity):
    runs = sorted(histogram.items(), reverse=True)
    got = items(sharding.best_fit_decreasing(runs, capacity), runs)
    assert got == packed_one_by_one([s for s, n in runs for _ in range(n)], capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 1000), st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 6))
def test_even_bins_place_every_item_and_large_ones_alone(histogram, shards):
    got = items(sharding.even_bins(list(histogram.items()), shards), histogram.items())
    assert len(got) == sum(histogram.values()) and {b for _, b in got} <= set(range(shards))
    loads = [sum(s for s, b in got if b == k) for k in range(shards)]
    total = sum(loads)
    assert max(loads) <= max(max(histogram), total / shards * 2)
    if max(histogram) * shards > total and shards > 1:
        assert [s for s, b in got if b == 0] == [max(histogram)]


def test_shards_are_near_equal_and_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.shard_documents(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(got) == docs.count() and set(got["shard"]) == set(range(16)) and set(got["law"]) == {"bytes"}
    assert (got["size"] == got["text"].map(lambda t: len(t.encode()) + 1)).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    totals = got.groupby("shard")["size"].sum()
    assert totals.max() / totals.mean() < 1.01
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    groups = got.groupby("text").agg(size=("size", "sum"), shard=("shard", "first"))
    runs = sorted(groups["size"].value_counts().items(), reverse=True)
    assert sorted(zip(groups["size"], groups["shard"], strict=True)) == sorted(items(sharding.even_bins(runs, 16), runs))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_of_odd_tables(spark):
    rows = [(i % 50, None if i % 7 == 0 else "same text", 3) for i in range(300)] + [(None, "x", 1), (None, "long " * 9, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns({c: F.lit(4) for c in ("_group", "size", "_key", "_rank", "slot")})
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == 302 and got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all() and got["shard"].nunique() == 4  # groups stay whole
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- mixing


def slow_fill(budget, weights, supplies):
    """Shares by weight in small steps of logic: deal, cap the full, deal what is left to the others, again."""
    out, open_ = [0.0] * len(weights), {i for i in range(len(weights)) if supplies[i] > 0 and weights[i] > 0}
    left = min(float(budget), float(sum(supplies[i] for i in open_)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= supplies[i] - 1e-9 * supplies[i]}
        for i in full or open_:
            out[i] = float(supplies[i]) if full else left * weights[i] / total
        if not full:
            break
        left, open_ = max(left - sum(supplies[i] for i in full), 0.0), open_ - full
    return out


def slow_quotas(leaves, budget, weights, temper, epochs):
    """Quota of each leaf, one family after the other."""

    def deal(prefix, amount):
        depth = len(prefix) + 1
        kids = sorted({p[:depth] for p in leaves if p[: depth - 1] == prefix}, key=str)
        supplies = [epochs * sum(t for p, t in leaves.items() if p[:depth] == k) for k in kids]
        total = sum(s**temper for s in supplies if s) or 1.0
        shares = slow_fill(amount, [weights.get(k, s**temper / total if s else 0.0) for k, s in zip(kids, supplies, strict=True)], supplies)
        return {k: q for kid, share in zip(kids, shares, strict=True) for k, q in ({kid: share} if kid in leaves else deal(kid, share)).items()}

    return deal((), budget)


def spark_quotas(spark, leaves, budget, weights, temper, epochs):
    depth = len(next(iter(leaves)))
    names = [f"n{i}" for i in range(depth)]
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], ", ".join([*(f"{n} string" for n in names), "t long"]))
    return {tuple(r[n] for n in names): r["quota"] for r in mixing.quotas(df, names, budget, weights, temper, epochs).collect()}


def test_shortages_go_to_siblings_first(spark):
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100, ("b", "y"): 100}
    equal = {p[:k]: 1.0 for p in leaves for k in (1, 2)}
    got = spark_quotas(spark, leaves, 160, equal, 0.5, 1)
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 70, ("b", "x"): 40, ("b", "y"): 40})
    got = spark_quotas(spark, leaves, 260, equal, 0.5, 1)  # all of a is not enough: the rest goes to b
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 75, ("b", "y"): 75})


def test_budgets_are_those_of_dealing_family_by_family(spark):
    r = random.Random(14)
    for trial in range(8):
        paths = {(r.choice("abc"), r.choice(["x", "y", "z", None]), str(r.randrange(6))) for _ in range(r.randrange(1, 30))}
        leaves = {p: r.choice([0, 1, r.randrange(1000)]) for p in paths}
        weights = {p[:k]: r.choice([0.0, 0.1, 2.0]) for p in paths for k in (1, 2, 3) if r.random() < 0.3}
        budget = r.randrange(5000)
        want = slow_quotas(leaves, budget, weights, 0.5, 2)
        assert spark_quotas(spark, leaves, budget, weights, 0.5, 2) == pytest.approx(want, abs=1e-6), trial
        if not weights:
            assert sum(want.values()) == pytest.approx(min(budget, 2 * sum(leaves.values())))


def test_tokens_are_those_of_the_tokenizer(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("_key", "_row", "epoch", "_text")})
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = mixing.mix(docs, path, [F.col("source")], max_epochs=1).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(1, len(Tokenizer.from_file(path).encode("the cat sat").ids)), (2, 0), (3, 0)}


def test_mix_takes_whole_epochs_and_a_prefix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    levels = [mixing.source_domain("source"), F.col("lang"), F.col("source")]
    kept = mixing.mix(docs, mixing.word_tokens("text"), levels, 0.6).toPandas()
    again = mixing.mix(docs, mixing.word_tokens("text"), levels, 0.6).toPandas()
    assert sorted(map(str, kept.values.tolist())) == sorted(map(str, again.values.tolist()))
    pdf = docs.toPandas()
    tokens = dict(zip(pdf["doc_id"], pdf["text"].str.split().map(len), strict=True))
    assert all(tokens[r.doc_id] == r.n_tokens for r in kept.itertuples()) and not kept.duplicated(["doc_id", "epoch"]).any()
    leaf = ["_level0", "_level1", "_level2"]
    all_rows = mixing.mix(docs, mixing.word_tokens("text"), levels, 1.0, max_epochs=1).toPandas()
    assert sorted(all_rows["doc_id"]) == sorted(pdf["doc_id"])
    supply = all_rows.groupby(leaf)["n_tokens"].sum().to_dict()
    quota = slow_quotas(supply, 0.6 * sum(supply.values()), {}, 0.5, 2)
    for path, part in kept.groupby(leaf):
        over = part["n_tokens"].sum() - quota[path]
        assert -1 <= over <= part["n_tokens"].max()
        tail = part.dropna(subset=["leaf_offset"]).sort_values("leaf_offset")
        assert (tail["n_tokens"].cumsum() - tail["n_tokens"] == tail["leaf_offset"]).all()


def test_mix_of_odd_tables(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "s1"), (3, "a b", "en", None), (4, "c", None, "x9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = [mixing.source_domain("source"), F.col("lang"), F.col("source")]
    got = mixing.mix(docs, mixing.word_tokens("text"), levels, 1.0, max_epochs=1).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4]
    assert mixing.mix(docs.limit(0), mixing.word_tokens("text"), levels).count() == 0


# --- near-dedup


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (n and 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def near_corpus(seed, n_base, copies):
    r, out = random.Random(seed), []
    for _ in range(n_base):
        base = words(r, r.randrange(3, 200))
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = words(r, 1)[0]
            out.append(" ".join(w))
    return [*out, None, "", " ", "", "a b", "a b", out[0]]


@pytest.mark.parametrize("block", [2000, 7])
def test_near_classes_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    texts = near_corpus(4, 12, 14)
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, node string, size int, _row_node int, _kept int")
    rows, want = near_dedup.near_classes(docs).collect(), brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == want
    assert all(r["class_size"] == want.count(r["class_id"]) for r in rows)
    if block == 2000:
        left = near_dedup.deduplicated(docs.unionByName(docs))
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(brute_classes(texts)))
        assert near_dedup.near_classes(docs.limit(0)).count() == 0


def test_a_chain_over_many_blocks_is_one_class(spark, monkeypatch):
    """Near copies of near copies, with long texts among them, in blocks of few rows and few bytes."""
    monkeypatch.setattr(links, "BLOCK", 4)
    monkeypatch.setattr(links, "BLOCK_BYTES", 9_000)
    r, texts = random.Random(26), []
    for n in (60, 400):
        w = words(r, n)
        for _ in range(25):
            texts.append(" ".join(w))
            w[r.randrange(n)] = words(r, 1)[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_classes_broadcast_nothing(spark, monkeypatch):
    """Tables that grow with the corpus look small to Spark when packed; the driver would hold them."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(links, "BLOCK", 3)
    for module in (links, near_dedup):
        monkeypatch.setattr(module, "stored", kept)
    docs = spark.createDataFrame(list(enumerate(near_corpus(4, 1, 7))), "doc_id long, text string")
    plans += [(f.__name__, f(docs)._jdf.queryExecution().executedPlan().toString()) for f in (near_dedup.near_classes, near_dedup.deduplicated)]
    assert {"candidates", "texts", "edges", "leader-edges", "large-groups"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_near_copies_with_repeated_passages_are_found(spark):
    r, texts = random.Random(25), []
    for times in (1, 5, 50, 50, 50, 200, 200, 200):
        w = words(r, 100)
        at = r.randrange(60)
        texts += [" ".join(w), " ".join(w + w[at : at + 30] * times)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    want = brute_classes(texts)
    assert want == [i - i % 2 for i in range(len(texts))]
    assert sum(got[i] != want[i] for i in range(len(texts))) == 0


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(5)
    e = r.integers(0, 1 << 62, 400).astype(np.uint64)
    a, b = (e[:300], r.random(300) + 0.1), (e[100:], r.random(300) + 0.1)
    regs = near_dedup.registers([a, b], 4096)
    wa, wb = dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True))
    both = set(wa) & set(wb)
    want = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in set(wa) | set(wb)) for x in both)
    assert abs((regs[0] == regs[1]).mean() - want) < 0.03


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    b = lambda i: i.to_bytes(4, "big")
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    got = {bytes(x["node"]): bytes(x["root"]) for x in links.components(spark.createDataFrame([(b(x), b(y)) for x, y in edges], "a binary, b binary")).collect()}
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {b(x): b(y) for x, y in root.items() if x not in alone}


# --- substring dedup


def test_compact_windows_cover_each_passage_once():
    r = np.random.default_rng(2)
    for n in (0, 10, 46, 150):
        h = r.integers(0, 40, n).astype(np.uint64) if n == 150 else r.integers(0, 1 << 62, n).astype(np.uint64)
        _, _, lo, c, hi = substring_dedup.compact_windows([h], 20)
        for i in range(n - 19):
            assert ((lo <= i) & (i <= c) & (c <= i + 19) & (i + 19 <= hi)).sum() == substring_dedup.HASHES


def test_repeated_passages_are_found_and_one_copy_stays(spark):
    r = random.Random(6)
    shared = [words(r, n) for n in (51, 60, 80, 140, 55)]
    docs, holds = [], []
    for i in range(120):
        w, mine = words(r, 60), []
        for _ in range(r.randrange(3)):
            k = r.randrange(len(shared))
            w += shared[k] + words(r, 30)
            mine.append(k)
        docs.append((i, " \n".join(w) if i % 2 else " ".join(w), "v", 1))
        holds.append(mine)
    df = spark.createDataFrame([*docs, (500, None, "v", 1), (501, "", "v", 1), (502, "a " * 3000, "v", 1)], "doc_id long, text string, value string, n_chars long")
    rows = substring_dedup.repeated_passages(df).collect()
    words_of = {i: t.split() for i, t, *_ in docs}
    words_of[502] = ["a"] * 3000
    for x in rows:
        assert (x["source"], x["source_start"]) < (x["doc_id"], x["start_word"])
        assert x["doc_id"] == 502 or words_of[x["doc_id"]][x["start_word"] : x["end_word"]] == words_of[x["source"]][x["source_start"] : x["source_end"]]
    first, want = {}, set()
    for i, mine in enumerate(holds):
        for k in mine:
            if k in first:
                want.add(i)
            first.setdefault(k, i)
    assert {x["doc_id"] for x in rows} - {502} == want
    left = substring_dedup.deduplicated(df)
    assert left.columns == df.columns and left.count() == df.count()
    kept = {x["doc_id"]: (x["text"] or "").split() for x in left.collect()}
    joined = {i: " ".join(w) for i, w in kept.items()}
    for k, s in enumerate(shared):
        at = [i for i, t in joined.items() if " ".join(s) in t]
        assert at == ([first[k]] if k in first else [])
    assert all(joined[i] == " ".join(words_of[i]) for i in range(120) if i not in want)
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_the_interval_join_finds_where_enough_functions_agree():
    r = np.random.default_rng(4)
    for _ in range(20):
        h = r.integers(0, 1 << 62, 150).astype(np.uint64)
        _, at, *_ = substring_dedup.compact_windows([h, h[:3], h])
        assert np.bincount(at, minlength=3).tolist() == [len(at) // 2, 0, len(at) // 2]
        value, _, lo, c, hi = substring_dedup.compact_windows([h])
        some = r.random(len(value)) < 0.5
        first, last = substring_dedup.covered_starts(lo[some], c[some], hi[some])
        start, stop, values = substring_dedup.regions(value[some], first, last)
        want = {}
        for i in range(len(h) - substring_dedup.LEAST + 1):
            over = {int(v) for v, a, m, b in zip(value[some], lo[some], c[some], hi[some], strict=True) if a <= i <= m < i + substring_dedup.LEAST <= b + 1}
            if len(over) >= substring_dedup.ENOUGH:
                want[i] = over
        got = {i: {int(v) for v in row if v} for a, b, row in zip(start, stop, values, strict=True) for i in range(a, b)}
        assert got == want


def test_four_hundred_thousand_windows_of_one_value_lose_no_exact_passage(spark):
    """Texts of one line in many contexts, and pairs among them that share a passage around it."""
    r = random.Random(31)
    line, rows = words(r, 30), []
    for i in range(2000):
        rows.append((i, " ".join(words(r, 25) + line + words(r, 25))))
    want = set()
    for k in range(60):
        passage = words(r, 12) + line + words(r, 12)
        for i in (5000 + k, 6000 + k):
            rows.append((i, " ".join(words(r, 20) + passage + words(r, 20))))
        want.add((6000 + k, 5000 + k))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {(x["doc_id"], x["source"]) for x in got} == want and all(x["end_word"] - x["start_word"] == 54 for x in got)
    # Grouping keeps every window of a value, however many there are.
    many = spark.range(400_000).select(F.lit(8).cast("long").alias("value"), F.col("id").alias("row"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(False).alias("known"), F.lit(False).alias("alone"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("long").alias("start_word"))
    assert substring_dedup.shared(many).count() == 400_000


def brute_passages(texts, least=50):
    """Words of each text that lie in a passage of `least` words that an earlier text, or the text before, has too."""
    out, seen = [], {}
    for t in texts:
        w, covered, mine = t.split(), set(), {}
        for i in range(len(w) - least + 1):
            g = tuple(w[i : i + least])
            if g in seen or g in mine:
                covered |= set(range(i, i + least))
            mine.setdefault(g, i)
        seen.update(mine)
        out.append(covered)
    return out


def repeating_corpus(r, count):
    """Texts of passages, lines and variants that recur in several of them."""
    passages = [words(r, r.randrange(40, 90)) for _ in range(12)]
    lines = [words(r, r.randrange(3, 30)) for _ in range(8)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(r.randrange(1, 7)):
            kind = r.random()
            if kind < 0.4:
                parts += r.choice(passages)
            elif kind < 0.6:
                p = list(r.choice(passages))
                p[r.randrange(len(p))] = words(r, 1)[0]
                parts += p
            elif kind < 0.8:
                parts += r.choice(lines)
            else:
                parts += words(r, r.randrange(5, 60))
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_every_passage_that_brute_force_finds_is_found(spark, seed):
    texts = repeating_corpus(random.Random(seed), 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    covered = [set() for _ in texts]
    for x in substring_dedup.repeated_passages(docs).collect():
        assert (x["source"], x["source_start"]) < (x["doc_id"], x["start_word"])
        mine, yours = (shingles(texts[d].split()[a:b]) for d, a, b in ((x["doc_id"], x["start_word"], x["end_word"]), (x["source"], x["source_start"], x["source_end"])))
        both = len(set(mine.tolist()) & set(yours.tolist()))
        assert 5 * both >= 4 * (len(set(mine.tolist())) + len(set(yours.tolist())) - both)
        covered[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    for i, want in enumerate(brute_passages(texts)):
        assert covered[i] >= want, i


def test_rows_of_repeated_null_and_string_ids_keep_their_own_words(spark):
    r = random.Random(41)
    shared, clean = words(r, 100), " ".join(words(r, 300))
    rows = [(1, " ".join(words(r, 60) + shared + words(r, 60))), (7, " ".join(words(r, 20) + shared + words(r, 20))), (7, clean), (7, clean)]
    rows += [(None, " ".join(words(r, 30) + shared)), (None, " ".join(shared + words(r, 40))), (None, None), (8, "")]
    for kind, of in (("long", lambda i: i), ("string", lambda i: None if i is None else f"id-{i}")):
        docs = spark.createDataFrame([(of(i), t, 1, 2, 3, 4) for i, t in rows], f"doc_id {kind}, text string, _key int, _spans int, _node int, row int")
        left = substring_dedup.deduplicated(docs, length=None)
        assert left.columns == docs.columns
        kept = [x["text"] for x in left.collect()]
        assert len(kept) == len(rows) and kept.count(clean) == 2 and kept.count(rows[0][1]) == 1
        assert sum(" ".join(shared) in (t or "") for t in kept) == 1 and sorted(len((t or "").split()) for t in kept) == sorted([220, 40, 300, 300, 30, 40, 0, 0])
        assert substring_dedup.deduplicated(docs.limit(0)).count() == 0


def test_parts_of_a_longer_passage_are_found(spark):
    r = random.Random(12)
    rows = []
    for i in range(0, 180, 3):
        p = words(r, 100)
        parts = (p[:60], p, p[40:])
        rows += [(i + k, " ".join(words(r, 60) + part + words(r, 60))) for k, part in enumerate(parts)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x["source"], x["doc_id"]) for x in got}
    assert all((i, i + 1) in found and (i + 1, i + 2) in found for i in range(0, 180, 3))


def variants(r, passage, count):
    """Variants with edits spread so that none has Jaccard 0.8 to the passage as a whole."""
    out = []
    for _ in range(count):
        v = list(passage)
        for at in (r.randrange(12, 28), r.randrange(34, 48)):
            v[at] = words(r, 1)[0]
        out.append(v)
    return out


def test_exact_passages_in_families_of_variants_are_found(spark):
    r = random.Random(21)
    rows, want = [], set()
    for k in range(40):
        p = words(r, 60)
        family = [*variants(r, p, 40), p, p]
        rows += [(100 * k + i, " ".join(words(r, 20) + v + words(r, 20))) for i, v in enumerate(family)]
        want.add((100 * k + 41, " ".join(p)))
    text = dict(rows)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {(x["doc_id"], " ".join(text[x["doc_id"]].split()[x["start_word"] : x["end_word"]])) for x in got}
    missed = {d for d, p in want if not any(d == e and p in t for e, t in found)}
    assert len(missed) == 0


def test_near_partners_between_the_first_and_the_last_of_a_name_are_found(spark):
    """Texts that share half of a passage with it come first, after and between the two that share it all but a word."""
    r = random.Random(27)
    rows, want = [], []
    for k in range(20):
        p = words(r, 62)
        middle = [*p[:31], *words(r, 1), *p[32:]]
        halves = [[*p[:31], *words(r, 31)] if i % 2 else [*words(r, 32), *p[32:]] for i in range(24)]
        family = [*halves[:6], middle, *halves[6:], p]
        rows += [(100 * k + i, " ".join(words(r, 20) + v + words(r, 20))) for i, v in enumerate(family)]
        want.append((100 * k + 6, 100 * k + len(family) - 1))
    text = dict(rows)
    pairs = [(a, b) for a, b in want if substring_dedup.Earlier(text[a]).spans(text[b])]
    assert len(pairs) == 20
    got = {(x["source"], x["doc_id"]) for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert sorted(set(pairs) - got) == []


def test_large_families_of_variants_are_searched_whole_without_all_their_pairs(spark, monkeypatch):
    """Variants of one text with edits of their own, and texts that share a line with them and nothing else: every run
    that is left has no earlier text with a passage around it, and few pairs were tried for that."""
    r = random.Random(33)
    base, rows = words(r, 150), []
    for i in range(240):
        v = list(base)
        for at in r.sample(range(150), 5):
            v[at] = words(r, 1)[0]
        rows.append((i, " ".join(v)))
    rows += [(i, " ".join(words(r, 40) + base[60:100] + words(r, 40))) for i in range(240, 480)]
    tried, plain = [], substring_dedup.verified

    def verified(pairs, docs):
        tried.append(pairs.count())
        return plain(pairs, docs)

    monkeypatch.setattr(substring_dedup, "verified", verified)
    covered = {i: np.zeros(len(t.split()), bool) for i, t in rows}
    for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        covered[x["doc_id"]][x["start_word"] : x["end_word"]] = True
    early = [substring_dedup.Earlier(t) for _, t in rows]
    names = [set(substring_dedup.runs(e.h)[1].tolist()) for e in early]
    left = 0
    for i, t in rows:
        at, name = substring_dedup.runs(early[i].h)
        bare = [(a, n) for a, n in zip(at.tolist(), name.tolist(), strict=True) if not covered[i][a : a + substring_dedup.RUN + 4].all()]
        left += len(bare) > 0
        for j in range(i) if bare and i % 5 == 0 else ():
            held = [a for a, n in bare if n in names[j]]
            assert not any(s <= a and a + substring_dedup.RUN + 4 <= e for s, e, _, _ in (early[j].spans(t) if held else ()) for a in held), (i, j)
    assert left > 240 and sum(tried[1:]) < 20 * 240


def test_a_passage_beside_its_widest_gap_is_found():
    r = random.Random(34)
    early = words(r, 80)
    late = [w if i not in (10, 21, 48, 49) else words(r, 1)[0] for i, w in enumerate(early)]
    assert substring_dedup.Earlier(" ".join(early)).spans(" ".join(late)) == [(22, 80, 22, 80)]


def test_passages_with_lines_that_recur_in_the_earlier_text_are_found():
    r = random.Random(22)
    p = words(r, 62)
    line = p[25:37]
    texts = [(line + words(r, 40) + p + words(r, 20), p)]
    lines = [words(r, 12) for _ in range(5)]
    recur = [w for a, b in zip(lines, lines[1:], strict=False) for w in a + b + words(r, 9)]
    texts.append((recur + sum(lines, []) + words(r, 20), sum(lines, [])))
    for early, p in texts:
        near = [*p[:18], words(r, 1)[0], *p[19:]]
        for copy in (p, near):
            late = words(r, 30) + copy + words(r, 30)
            covered = set()
            for s, e, a, b in substring_dedup.Earlier(" ".join(early)).spans(" ".join(late)):
                assert e - s >= 50 and 30 <= s < e <= 30 + len(p) and (copy == near or late[s:e] == early[a:b])
                covered |= set(range(s, e))
            assert covered == set(range(30, 30 + len(p)))
    own = line + words(r, 40) + texts[0][1] + words(r, 20) + texts[0][1]
    got = substring_dedup.Earlier(" ".join(own)).spans(" ".join(own), own=True)
    assert any(s == len(own) - 62 and e == len(own) and own[a:b] == own[s:e] for s, e, a, b in got)


def test_pairs_of_texts_of_few_shingles_are_exact():
    """Every passage of 50 words that two texts share is covered, however their lines recur."""
    r = random.Random(23)
    for trial in range(40):
        lines = [words(r, r.randrange(1, 30)) for _ in range(r.randrange(1, 9))]
        early, late = ([w for _ in range(r.randrange(2, 40)) for w in r.choice(lines)] for _ in range(2))
        for own in (False, True):
            late = early if own else late
            got = substring_dedup.Earlier(" ".join(early)).spans(" ".join(late), own=own)
            covered = {i for s, e, _, _ in got for i in range(s, e)}
            grams = {}
            for a in range(len(early) - 49):
                grams.setdefault(tuple(early[a : a + 50]), a)
            for i in range(len(late) - 49):
                if grams.get(tuple(late[i : i + 50]), len(late)) < (i if own else len(late)):
                    assert covered >= set(range(i, i + 50)), trial
            assert all(a < s for s, _, a, _ in got if own)


def test_passages_whose_minima_recur_in_their_texts_are_found(spark):
    r = random.Random(24)
    rows = []
    for k in range(60):
        passage = words(r, 52)
        for i in range(2):
            mixed = [w for at in [*range(0, 48, 12)] * 3 for w in words(r, 45) + passage[at : at + 16]]
            rows.append((2 * k + i, " ".join(mixed + words(r, 45) + passage + words(r, 45))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["source"], x["doc_id"]) for x in substring_dedup.repeated_passages(docs).collect()}
    assert len({(2 * k, 2 * k + 1) for k in range(60)} - got) == 0


def test_near_passages_are_found(spark):
    r = random.Random(9)
    p = words(r, 200)
    q = [w if i % 60 else "other" for i, w in enumerate(p)]
    rows = [(1, " ".join(words(r, 70) + p + words(r, 70))), (2, " ".join(words(r, 90) + q + words(r, 40)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {2} and max(x["end_word"] - x["start_word"] for x in got) > 150


# --- nearest neighbours


def brute_nearest(ids, x, k, every):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ v
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s.round(12))) if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    pdf = rows.toPandas()
    want = brute_nearest(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), 20, 20)
    got = nearest.search(rows).toPandas()
    assert sorted(got.columns) == ["query_id", "rank", "score", "vec_id"]
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and (np.diff(part["score"]) <= 0).all()
        near = dict(brute_nearest(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), 10**6, 20)[q])
        assert all(abs(near[v] - s) < 1e-9 for v, s in zip(part["vec_id"], part["score"], strict=True))
        hits += len(set(part["vec_id"]) & {v for v, _ in want[q]})
    assert set(got["query_id"]) == set(want) and hits >= 0.9 * 20 * len(want)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 2.0]) for i in range(20, 80)] + [(i, [2.0, 1.0]) for i in range(80, 90)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = nearest.search(df, 20, 20).toPandas()
    usable = {i: v for i, v in rows if i is not None and v and len(v) == 2 and None not in v and np.isfinite(v).all() and any(v)}
    want = brute_nearest(np.array(list(usable)), np.array(list(usable.values())), 20, 20)
    assert {q: list(zip(p.sort_values("rank")["vec_id"], p.sort_values("rank")["score"], strict=True)) for q, p in got.groupby("query_id")} == want
    few = nearest.search(spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0)]
    assert nearest.search(df.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pdf = docs.toPandas()
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, DATA)
        got = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns and set(got["doc_id"]) <= set(seen.toPandas()["doc_id"])
            assert name == "mixing" or not got["doc_id"].duplicated().any()
        if name == "near-dedup":
            before = seen.toPandas().sort_values("doc_id")
            roots = brute_classes(before["text"].tolist())
            assert sorted(got["doc_id"]) == sorted(before["doc_id"].iloc[i] for i in set(roots))
        if name == "substring dedup":
            assert (got["n_chars"] == got["text"].str.len()).all() and len(got) >= 0.95 * seen.count()
        if name == "packing":
            assert got["length"].sum() > 0 and set(got["doc_id"]) == set(seen.toPandas()["doc_id"])
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name.replace(' ', '-')}"
        out.write.parquet(path)
        seen = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, DATA).count() > 0.5 * len(pdf)


def test_pipeline_cuts_passages_whose_partner_is_not_next_to_them(spark):
    """Between the copies, and before them, stand texts with a half of the passage."""
    r = random.Random(28)
    texts, want = [], {}
    for _ in range(8):
        p = words(r, 62)
        middle = [*p[:31], *words(r, 1), *p[32:]]
        halves = [[*p[:31], *words(r, 31)] if i % 2 else [*words(r, 32), *p[32:]] for i in range(12)]
        texts += [" ".join(words(r, 20) + v + words(r, 20)) for v in (*halves[:6], middle, *halves[6:], p)]
        want[len(texts) - 1] = 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    left = {x["doc_id"]: len(x["text"].split()) for x in corpus_pipeline.passages(spark, docs, "").collect()}
    assert {i: left[i] for i in want} == want


def test_pipeline_stages_of_odd_tables(spark):
    """Null and repeated ids: every text keeps its own fate, and no row multiplies."""
    r = random.Random(3)
    texts = [" ".join(words(r, 90)) for _ in range(6)]
    rows = [(None, texts[0], "en", None, 1), (None, texts[1], None, "s1", 2), (None, texts[1], None, "s1", 2), (7, texts[2], "en", "s1", 3), (7, texts[3], "en", "s1", 3)]
    rows += [(8, None, "en", "s1", None), (9, "", None, None, 0), (None, "junk", "en", "s1", 4), (10, texts[4], "en", "s1", 5), (10, texts[4], "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("epoch", F.lit(5)).withColumn("_id", F.lit(6))
    good = [x[1] for x in rows if x[1] and len(x[1]) > 10]

    def of(stage):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        return sorted(x["text"] or "" for x in out.collect())

    assert of(corpus_pipeline.quality) == sorted(good)
    assert of(corpus_pipeline.near_duplicates) == sorted({*good, "", "junk"})
    mixed = of(corpus_pipeline.mixture)
    assert set(mixed) <= {*good, "", "junk"} and all(mixed.count(t) <= corpus_pipeline.MAX_EPOCHS * good.count(t) for t in good)
    assert all(stage(spark, docs.limit(0), DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_shingles_of_short_texts():
    assert len(shingles([])) == 0 and len(shingles(["a"])) == 1 and shingles(["a", "b"])[0] != shingles(["b", "a"])[0]


# --- what the steps of an operator leave behind


def test_stored_leaves_no_shuffle_files(spark):
    """Steps that follow one another must not take the disk of all together, until the driver collects its garbage."""
    from pathlib import Path

    from foldstone.llm import common

    folders = [Path(x.getPath()) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    setting, before = spark.conf.get(common.REMOVED, None), files()
    rows = spark.range(1000).withColumn("k", F.col("id") % 10).repartition(4, "k").groupBy("k").count()
    assert sorted(map(tuple, common.stored(rows, "rows").collect())) == [(k, 100) for k in range(10)]
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(common.REMOVED, None) == setting
