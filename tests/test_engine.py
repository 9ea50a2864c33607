import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldstone.config import CHORD, HOP_NODES, NEAREST, RoutingTable
from foldstone.engine import DedupEngine
from foldstone.functions.crc import VARIANTS, crc_hex
from foldstone.functions.fingerprint import bloom_mask, bucket_index, routing_key, sha3_256_hex, sha3_512_hex
from foldstone.functions.numbering import row_numbers
from foldstone.operators import bloom, refcount, routing, storage
from foldstone.operators.allocator import allocate, recycled_lba
from foldstone.sources import codec
from foldstone.sources.shared import shared_folder
from foldstone.sources.tables import page_chunks
from foldstone.streaming.refcount import counted_stream
from tests import model


def stream(n, keys, seed):
    r = random.Random(seed)
    return [(i, r.choice(["WRITE2FREE", "WRITE2FREE", "ERASEREF", "READSSD"]), hashlib.sha256(str(r.randrange(keys)).encode()).hexdigest()) for i in range(n)]


def ops_frame(spark, ops):
    return spark.createDataFrame([(s, o, f, 0, s) for s, o, f in ops], "seq long, op string, fingerprint string, host_data_node long, host_lba long")


@pytest.mark.parametrize("seed", [1, 2])
def test_responses_equal_the_sequential_model(spark, seed):
    ops = stream(1500, 40, seed)
    got = {r["seq"]: r for r in storage.responses(ops_frame(spark, ops), F.lit(0)).collect()}
    for want, (_, op, _) in zip(model.run(ops), ops, strict=True):
        r = got[want["seq"]]
        hit = want["hit"] or op == "WRITE2FREE"
        assert (r["ref_count"], r["ssd_lba"], r["hit"]) == (want["ref_count"], want["ssd_lba"], hit)


def test_misses_give_no_command_and_nops_no_row(spark):
    ops = [(0, "ERASEREF", "a"), (1, "READSSD", "a"), (2, "NOP", "a"), (3, "WRITE2FREE", "a"), (4, "ERASEREF", "a"), (5, "ERASEREF", "a"), (6, "WRITE2FREE", "a")]
    resp = storage.responses(ops_frame(spark, ops), F.lit(0)).orderBy("seq").collect()
    assert [(r["seq"], r["ref_count"], r["is_exec"], r["ssd_lba"]) for r in resp] == [(0, 0, False, 0), (1, 0, True, 0), (3, 1, True, 1), (4, 0, True, 1), (5, 0, False, 0), (6, 1, True, 2)]
    assert [r["ssd_op"] for r in storage.ssd_commands(storage.responses(ops_frame(spark, ops), F.lit(0))).orderBy("seq").collect()] == ["WRITE", "ERASE", "WRITE"]


def test_reads_get_the_write_of_their_own_life(spark):
    ops = [(0, "READSSD", "a"), (1, "WRITE2FREE", "a"), (2, "WRITE2FREE", "a"), (3, "READSSD", "a"), (4, "ERASEREF", "a"), (5, "ERASEREF", "a"), (6, "READSSD", "a"), (7, "WRITE2FREE", "a"), (8, "READSSD", "a")]
    got = storage.read_back(storage.responses(ops_frame(spark, ops), F.lit(0))).collect()
    assert {r["seq"]: r["stored_seq"] for r in got} == {0: None, 3: 1, 6: None, 8: 7}


def test_thirty_two_pages_four_times(spark):
    rows = [(i, f"p{i % 32}") for i in range(128)]
    out = refcount.write_only(spark.createDataFrame(rows, "seq long, fingerprint string")).collect()
    seen = {}
    for r in out:
        assert r["is_exec"] == (r["ref_count"] == 1)
        seen.setdefault(r["fingerprint"], set()).add(r["ref_count"])
    assert len(seen) == 32 and all(v == {1, 2, 3, 4} for v in seen.values())


def test_pages_are_padded_and_cover_the_text(spark):
    texts = {0: "", 1: None, 2: "é" * 3000, 3: "a" * 4096, 4: "b" * 4097}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in page_chunks(df, "doc_id", "text").orderBy("seq").collect():
        assert len(r["page_data"]) == 4096
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["page_data"])
    for k, t in texts.items():
        data = (t or "").encode()
        assert got[k] == data.ljust(max(1, -(-len(data) // 4096)) * 4096, b"\0")


def test_digests_and_crcs(spark):
    rows = [(i, bytes(random.Random(i).randbytes(i))) for i in range(60)] + [(99, b"123456789"), (100, None)]
    df = spark.createDataFrame(rows, "id long, data binary").select("id", "data", sha3_256_hex("data").alias("a"), sha3_512_hex("data").alias("b"), *[crc_hex(F.col("data"), v).alias(v) for v in VARIANTS])
    for r in df.collect():
        if r["data"] is None:
            assert r["a"] is None and r["CRC-32"] is None
            continue
        x = bytes(r["data"])
        assert r["a"] == hashlib.sha3_256(x).hexdigest() and r["b"] == hashlib.sha3_512(x).hexdigest() and int(r["CRC-32"], 16) == zlib.crc32(x)
        if r["id"] == 99:
            assert all(int(r[v], 16) == VARIANTS[v][5] for v in VARIANTS)


def test_codec_round_trip(spark):
    fp = hashlib.sha256(b"x").hexdigest()
    words = [codec.pack_instruction("WRITE2FREE", 7, 2, 77), codec.pack_instruction("NOP"), codec.pack_instruction("READSSD", fingerprint=fp)]
    got = codec.decode_instructions(spark.createDataFrame(list(enumerate(words)), "seq long, word binary")).orderBy("seq").collect()
    assert [(r["op"], r["start"], r["length"], r["node"], r["fingerprint"]) for r in got] == [("WRITE2FREE", 7, 2, 77, None), ("READSSD", 0, 1, 0, fp)]
    data = words[0] + b"a" * 4096 + b"b" * 4096 + codec.pack_instruction("WRITE2FREE", 9, 0, 1) + words[1] + words[2]
    assert [(i["op"], len(p)) for i, p in codec.split_stream(data)] == [("WRITE2FREE", 2), ("WRITE2FREE", 0), ("READSSD", 0)]
    assert len(codec.pack_response(fp, 1, 2, 3, 4, 5, 6, True, "WRITE2FREE")) == 64


def ring_model(h, t):
    n = 1 << t.bits
    hits = [i for i, (s, k, _) in enumerate(t.entries) if (h - s) % n < k]
    if hits:
        return max(hits)
    if t.mode == "nearest":
        return min((min((s - h) % n, (h - s - k) % n), i) for i, (s, k, _) in enumerate(t.entries))[1]
    a = t.entries[0][0]
    for i, (s, _, _) in enumerate(t.entries):
        if (s - a) % n > (h - a) % n:
            return max(i - 1, 0)
    return len(t.entries) - 1


@pytest.mark.parametrize("t", [NEAREST, CHORD, RoutingTable(((0, 65536, 1),)), RoutingTable(((10, 0, 1), (20, 5, 2))), RoutingTable(((0, 100, 1), (50, 100, 2)))])
def test_routing_over_the_ring(spark, t):
    got = spark.range(0, 65536, 7).select("id", routing.channel(F.col("id").cast("int"), t).alias("c")).collect()
    assert all(r["c"] == ring_model(r["id"], t) for r in got)


@pytest.mark.parametrize(("n", "m"), [(3, 1), (4, 2), (1, 5)])
def test_packets_are_dealt_in_turn(spark, n, m):
    got = routing.dealt(spark.range(0, 700, 7).select(F.col("id").alias("seq")), F.floor(F.col("seq") / 64), [F.col("seq")], n, m).orderBy("seq").collect()
    assert [r["channel"] for r in got] == [i // m % n for i in range(100)]


def test_hops_end_at_the_owner(spark):
    df = spark.range(0, 65536, 1001).select(F.col("id").cast("int").alias("h"), F.lit(1).alias("src"))
    for r in routing.hops(df, "h", "src", HOP_NODES).collect():
        assert r["final_node"] == r["h"] // 16384 and r["hops"] == (r["final_node"] - 1) % 4


def test_chord_tables_are_checked():
    with pytest.raises(ValueError):
        RoutingTable(((0, 1, 0), (9, 1, 1), (5, 1, 2)), "chord")


def test_bit_slices_and_filters(spark):
    fps = [hashlib.sha256(bytes([i])).hexdigest() for i in range(100)]
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint string")
    for r in df.select("fingerprint", bucket_index(F.col("fingerprint")).alias("b"), routing_key(F.col("fingerprint")).alias("h"), bloom_mask(F.col("fingerprint")).alias("m")).collect():
        v = int(r["fingerprint"], 16)
        mask = 0
        for j in range(3):
            mask |= 1 << (v >> 241 >> 5 * j & 31)
        assert (r["b"], r["h"], r["m"]) == (v & 32767, v >> 15 & 65535, mask)
    assert bloom.probes(df, df).filter("skipped").count() == 0


def test_allocator_invariants():
    r, held, events = random.Random(3), [], []
    for k in range(2000):
        if held and r.random() < 0.45:
            events.append((held.pop(r.randrange(len(held))), False))
        else:
            held.append(k)
            events.append((k, True))
    used, owner = set(), {}
    for (k, alloc), idx in zip(events, allocate(events, 5000), strict=True):
        assert idx > 0
        if alloc:
            assert idx not in used
            used.add(idx)
            owner[k] = idx
        else:
            assert owner[k] == idx
            used.remove(idx)
    with pytest.raises(OverflowError):
        allocate([(1, True), (2, True)], 1)


def test_block_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = row_numbers(df, F.floor(F.col("k") / 64), [F.col("k")], "n", ["g"]).collect()
    for g in range(3):
        part = sorted((r["k"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in part] == list(range(1, len(part) + 1))


def test_stream_over_two_batches_equals_batch(spark):
    ops = stream(600, 20, 5)
    ops[7], ops[450] = (7, "NOP", ops[7][2]), (450, "WRITE2FREE", None)
    top = shared_folder(spark)
    frame = ops_frame(spark, ops)
    frame.filter("seq < 300").coalesce(1).write.parquet(f"{top}/in/a")
    frame.filter("seq >= 300").coalesce(1).write.parquet(f"{top}/in/b")
    src = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{top}/in")
    q = counted_stream(src).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["seq"], r["ref_count"], r["hit"]) for r in spark.read.parquet(f"{top}/out").collect()}
    assert got == {(r["seq"], r["ref_count"], r["hit"]) for r in refcount.mixed(frame.filter("fingerprint is not null")).collect()} and len(got) == 598


@pytest.mark.parametrize("block", [1, 7, 100])
def test_a_hot_fingerprint_is_counted_in_blocks(spark, block):
    ops = stream(700, 2, 11)
    frame = ops_frame(spark, ops)
    full = refcount.with_fresh_lba(refcount.mixed(frame, block=block), block=block)
    got = {r["seq"]: (r["ref_count"], r["ssd_lba"], r["hit"]) for r in full.collect()}
    assert got == {w["seq"]: (w["ref_count"], w["ssd_lba"], w["hit"]) for w in model.run(ops)}
    counts = {r["seq"]: r["ref_count"] for r in refcount.write_only(frame.select("seq", "fingerprint"), block).collect()}
    seen = {}
    for s, _, f in ops:
        seen[f] = seen.get(f, 0) + 1
        assert counts[s] == seen[f]


def test_recycled_addresses_are_those_of_the_sequential_pools(spark):
    ops = stream(900, 30, 4)
    node = F.pmod(F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int"), F.lit(3))
    counted = refcount.mixed(ops_frame(spark, ops))
    got = recycled_lba(counted, node, 100).orderBy("seq").collect()
    for n in {r["node_idx"] for r in got}:
        mine = [r for r in got if r["node_idx"] == n]
        assert [r["ssd_lba"] for r in mine] == allocate([(r["fingerprint"], r["kind"] == "alloc") for r in mine], 100)
    with pytest.raises(Exception, match="indices are in use"):
        recycled_lba(counted, F.lit(0), 2).collect()


def test_the_engine_goes_on_where_the_last_batch_ended(spark):
    ops = stream(600, 25, 9)
    engine = DedupEngine(spark, shared_folder(spark))
    engine.clear()
    want, got = model.run(ops), []
    for lo in (0, 250, 400):
        part = [o for o in ops if lo <= o[0] < {0: 250, 250: 400, 400: 600}[lo]]
        frame = ops_frame(spark, [(s - lo, o, f) for s, o, f in part])
        resp = engine.run(frame, frame.filter("op = 'WRITE2FREE'").select("seq", F.encode("fingerprint", "utf-8").alias("page_data")))
        got += [(r["seq"] + lo, r["ref_count"], r["ssd_lba"]) for r in resp.collect()]
        assert engine.commands().count() == resp.filter("hit").count()
    assert sorted(got) == [(w["seq"], w["ref_count"], w["ssd_lba"]) for w in want]
    live = {}
    for (_, _, f), w in zip(ops, want, strict=True):
        live[f] = (w["ref_count"], w["ssd_lba"])
    live = {f: x for f, x in live.items() if x[0]}
    assert {r["fingerprint"]: (r["ref_count"], r["ssd_lba"]) for r in engine.table().collect()} == live
    pages = engine.pages().collect()
    assert {(r["ssd_lba"], bytes(r["page_data"]).decode()) for r in pages} == {(x[1], f) for f, x in live.items()} and len(pages) == len(live)
    engine.clear()
    assert engine.table().count() == 0 and engine.pages().count() == 0


def test_host_streams_become_sliced_operations(spark, tmp_path):
    fp = hashlib.sha256(b"x").hexdigest()
    data = codec.pack_instruction("WRITE2FREE", 0xFFFFFFFF, 2, 77) + b"a" * 4096 + b"b" * 100 + bytes(3996) + codec.pack_instruction("NOP") + codec.pack_instruction("WRITE2FREE", 9, 0, 1)
    (tmp_path / "s.bin").write_bytes(data + codec.pack_instruction("ERASEREF", fingerprint=fp))
    got = codec.host_streams(spark, f"file://{tmp_path}/s.bin").orderBy("instr", "page_no").collect()
    assert [(r["op"], r["page_no"], r["host_lba"], r["host_data_node"], r["fingerprint"]) for r in got] == [("WRITE2FREE", 0, 0xFFFFFFFF, 77, None), ("WRITE2FREE", 1, 0, 77, None), ("ERASEREF", 0, 0, 0, fp)]
    assert bytes(got[1]["page_data"]) == b"b" * 100 + bytes(3996)
