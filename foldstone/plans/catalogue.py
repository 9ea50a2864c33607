"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.config import CHORD, HOP_NODES, LIVE_OPS, NEAREST, DedupConfig
from foldstone.functions.crc import VARIANTS, crc_hex
from foldstone.functions.fingerprint import bloom_mask, bucket_index, routing_key, sha3_256_hex, sha256_hex
from foldstone.functions.numbering import row_numbers
from foldstone.operators import allocator, bloom, refcount, routing, storage
from foldstone.sources.tables import event_ops, page_chunks, table
from foldstone.streaming.refcount import run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Expected entries of a bucket.
BUCKET_SIZE = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return page_chunks(table(spark, d, "documents"), "doc_id", "text", ("source", "lang"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by fingerprint; their bytes never reach an exchange."""
    return _raw(spark, d).withColumn("fingerprint", sha256_hex(F.col("page_data"))).drop("page_data")


def _ops(spark: SparkSession, d: str) -> DataFrame:
    return event_ops(table(spark, d, "events"))


def _key() -> F.Column:
    return routing_key(F.col("fingerprint"))


def _node() -> F.Column:
    return routing.node_of(routing.channel(_key(), NEAREST), NEAREST)


@query
def page_chunks_(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", "page_no", "seq", "fingerprint")


QUERIES["page_chunks"] = QUERIES.pop("page_chunks_")


@query
def page_chunks_html(spark: SparkSession, d: str) -> DataFrame:
    return page_chunks(table(spark, d, "pages"), "page_id", "html").select("page_id", "page_no", "seq", sha256_hex(F.col("page_data")).alias("fingerprint"))


@query
def page_fingerprint_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("seq", "fingerprint")


@query
def page_fingerprint_sha3(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("seq", sha3_256_hex("page_data").alias("fingerprint"))


@query
def op_decode_dispatch(spark: SparkSession, d: str) -> DataFrame:
    write = F.col("op") == "WRITE2FREE"
    return _ops(spark, d).filter(F.col("op").isin(*LIVE_OPS)).select(
        "seq",
        "op",
        write.alias("needs_digest"),
        F.when(write, F.col("host_lba")).otherwise(F.lit(0)).cast("long").alias("host_lba_start"),
        F.lit(1).cast("long").alias("host_lba_len"),
        F.when(write, F.col("host_data_node")).otherwise(F.lit(0)).cast("long").alias("host_data_node"),
    )


@query
def slice_write_instr(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is an instruction, its turns are the pages; starts are 64 pages apart."""
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    lba = (F.col("conv_id") * 64 + F.col("turn") - first).bitwiseAND(F.lit(0xFFFFFFFF))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("instr"), F.col("turn").alias("page_no"), lba.alias("host_lba"), F.lit(1).cast("long").alias("host_lba_len"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))


@query
def refcount_write_only(spark: SparkSession, d: str) -> DataFrame:
    return refcount.write_only(_pages(spark, d).select("seq", "fingerprint"))


@query
def refcount_mixed_ops(spark: SparkSession, d: str) -> DataFrame:
    return refcount.mixed(_ops(spark, d).select("seq", "op", "fingerprint"))


@query
def responses_full(spark: SparkSession, d: str) -> DataFrame:
    return storage.responses(_ops(spark, d), _node())


@query
def ssd_commands(spark: SparkSession, d: str) -> DataFrame:
    return storage.ssd_commands(responses_full(spark, d))


@query
def unique_pages_store(spark: SparkSession, d: str) -> DataFrame:
    return storage.unique_pages(_pages(spark, d).select("seq", "fingerprint"))


@query
def alloc_fresh_lba(spark: SparkSession, d: str) -> DataFrame:
    firsts = _pages(spark, d).groupBy("fingerprint").agg(F.min("seq").alias("seq"))
    return row_numbers(firsts, F.floor(F.col("seq") / refcount.PAGE_BLOCK), [F.col("seq")], "ssd_lba")


@query
def alloc_recycled_lba(spark: SparkSession, d: str) -> DataFrame:
    return allocator.recycled_lba(refcount.mixed(_ops(spark, d)), _node(), DedupConfig().pool_size)


@query
def fp_table_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return storage.fp_table(responses_full(spark, d))


@query
def gc_events(spark: SparkSession, d: str) -> DataFrame:
    return refcount_mixed_ops(spark, d).filter("is_gc").select("seq", "fingerprint")


@query
def lookup_vs_snapshot(spark: SparkSession, d: str) -> DataFrame:
    ops = _ops(spark, d)
    reads = ops.filter("op = 'READSSD'").select("seq", "fingerprint")
    found = reads.join(refcount.snapshot(ops.select("seq", "op", "fingerprint")), "fingerprint", "left")
    return found.select("seq", "fingerprint", F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.col("ref_count").isNotNull().alias("hit"))


@query
def bucket_occupancy(spark: SparkSession, d: str) -> DataFrame:
    fps = _pages(spark, d).select("fingerprint").distinct()
    return fps.groupBy(bucket_index(F.col("fingerprint")).alias("bucket")).agg(F.count("*").alias("entries")).withColumn("over_size", F.greatest(F.col("entries") - BUCKET_SIZE, F.lit(0)))


@query
def bloom_masks(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("fingerprint").distinct().select("fingerprint", bucket_index(F.col("fingerprint")).alias("bucket"), bloom_mask(F.col("fingerprint")).alias("mask"))


@query
def bloom_filter_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return bloom.filters(refcount.snapshot(_ops(spark, d).select("seq", "op", "fingerprint")))


@query
def bloom_probe_skip_rate(spark: SparkSession, d: str) -> DataFrame:
    ops = _ops(spark, d).select("seq", "op", "fingerprint")
    probed = bloom.probes(ops.filter("op <> 'WRITE2FREE'"), refcount.snapshot(ops))
    return probed.agg(F.count("*").alias("probes"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))


@query
def route_owner_inside(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("seq", _key().alias("h"), F.coalesce(routing.owner(_key(), NEAREST), F.lit(-1)).alias("channel"))


def _routed(spark: SparkSession, d: str, t: routing.RoutingTable) -> DataFrame:
    ch = routing.channel(_key(), t)
    return _pages(spark, d).select("seq", _key().alias("h"), ch.alias("channel"), routing.node_of(ch, t).alias("node_idx"))


@query
def route_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d, NEAREST)


@query
def route_chord(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d, CHORD)


def _results(spark: SparkSession, d: str, t: routing.RoutingTable) -> DataFrame:
    dst = F.pmod("user_id", F.lit(16)).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), dst.alias("dst_node"), routing.result_channel(dst, t).alias("channel"))


@query
def route_result_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, NEAREST)


@query
def route_result_chord(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, CHORD)


@query
def route_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    at = _pages(spark, d).select("seq", _key().alias("h"), F.pmod("doc_id", F.lit(len(HOP_NODES))).cast("int").alias("src_node"))
    return routing.hops(at, "h", "src_node", HOP_NODES)


@query
def deal_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Pages in input order, dealt to four channels, two in a row to each."""
    return routing.dealt(_pages(spark, d).select("seq", "fingerprint"), F.floor(F.col("seq") / refcount.PAGE_BLOCK), [F.col("seq")], 4, 2)


@query
def node_load(spark: SparkSession, d: str) -> DataFrame:
    """Counted by fingerprint first: a node may own a third of all pages."""
    per = _pages(spark, d).groupBy("fingerprint").agg(F.count("*").alias("n"))
    return per.groupBy(_node().alias("node_idx")).agg(F.sum("n").alias("pages"), F.count("*").alias("fingerprints"))


@query
def merge_local_remote(spark: SparkSession, d: str) -> DataFrame:
    """Local and remote requests come as two streams and merge as a bag."""
    ops = _ops(spark, d).select("seq", "op", "fingerprint", F.pmod("host_data_node", F.lit(4)).cast("int").alias("src_node"))
    return ops.filter("src_node = 0").withColumn("is_local", F.lit(True)).unionByName(ops.filter("src_node <> 0 or src_node is null").withColumn("is_local", F.lit(False)))


@query
def in_order_retire(spark: SparkSession, d: str) -> DataFrame:
    done = refcount_mixed_ops(spark, d).select("seq", "op", "ref_count")
    return row_numbers(done, F.floor(F.col("seq") / refcount.SEQ_BLOCK), [F.col("seq")], "slot").select("slot", "seq", "op", "ref_count")


@query
def dedup_ratio_by_source(spark: SparkSession, d: str) -> DataFrame:
    per = _pages(spark, d).groupBy("source", "fingerprint").agg(F.count("*").alias("n"))
    sums = per.groupBy("source").agg(F.sum("n").alias("pages"), F.count("*").alias("unique_pages"))
    return sums.withColumn("bytes_saved", (F.col("pages") - F.col("unique_pages")) * DedupConfig().page_size).withColumn("dedup_ratio", F.col("pages").cast("double") / F.col("unique_pages"))


@query
def refcount_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy("fingerprint").agg(F.count("*").alias("ref_count")).groupBy("ref_count").agg(F.count("*").alias("fingerprints"))


@query
def page_lives(spark: SparkSession, d: str) -> DataFrame:
    """Pages that were ever stored, those that are live after all operations, and those whose last reference went."""
    per = refcount_mixed_ops(spark, d).groupBy("fingerprint").agg(F.max_by("ref_count", "seq").alias("n"), F.max("is_alloc").alias("stored"))
    held = F.col("n") > 0
    return per.agg(F.count(F.when(F.col("stored"), 1)).alias("unique_pages"), F.count(F.when(held, 1)).alias("live_pages"), F.count(F.when(F.col("stored") & ~held, 1)).alias("dead_pages"))


@query
def cross_source_overlap(spark: SparkSession, d: str) -> DataFrame:
    per = _pages(spark, d).groupBy("fingerprint", "source").agg(F.count("*").alias("n"))
    return per.groupBy("fingerprint").agg(F.count("source").alias("sources"), F.sum("n").alias("pages")).filter("sources > 1")


@query
def storage_op_mix(spark: SparkSession, d: str) -> DataFrame:
    return responses_full(spark, d).groupBy("op", "is_exec", "hit").agg(F.count("*").alias("ops"))


@query
def read_back_pages(spark: SparkSession, d: str) -> DataFrame:
    return storage.read_back(responses_full(spark, d))


@query
def crc32_pages(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("seq", F.crc32("page_data").alias("crc"))


@query
def crc_variants(spark: SparkSession, d: str) -> DataFrame:
    text = F.encode(F.coalesce("props", F.lit("")), "utf-8")
    return table(spark, d, "events").select("event_id", *[crc_hex(text, v).alias(v.lower().replace("/", "_").replace("-", "_")) for v in VARIANTS])


@query
def stream_refcount(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    source = f"{d}/[e]vents.parquet"  # a glob, as a stream's plain path has to be a folder
    return run_available(spark, event_ops(spark.readStream.schema(schema).parquet(source)))
