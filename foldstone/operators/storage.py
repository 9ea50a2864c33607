"""Responses, storage commands and the store of unique pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.fingerprint import bucket_index
from foldstone.operators.refcount import is_exec, mixed, with_fresh_lba


def responses(ops: DataFrame, node: Column, state: DataFrame | None = None, start: int = 1) -> DataFrame:
    """One row per operation. Erases and reads show start and data node 0, as their instructions carry none.

    state is the fingerprint table that earlier operations left, start the first address none of them used.
    """
    write = F.col("op") == "WRITE2FREE"
    full = with_fresh_lba(mixed(ops, state), state, start)
    return full.select(
        "seq",
        "fingerprint",
        "ref_count",
        "ssd_lba",
        node.cast("int").alias("node_idx"),
        F.when(write, F.col("host_lba")).otherwise(F.lit(0)).cast("long").alias("host_lba_start"),
        F.lit(1).cast("long").alias("host_lba_len"),
        F.when(write, F.col("host_data_node")).otherwise(F.lit(0)).cast("long").alias("host_data_node"),
        is_exec().alias("is_exec"),
        "op",
        (F.col("hit") | F.col("is_alloc")).alias("hit"),
    )


def ssd_commands(resp: DataFrame) -> DataFrame:
    """Storage command of each response; operations that missed give none."""
    kind = (
        F.when(F.col("op") == "WRITE2FREE", F.when(F.col("ref_count") == 1, "WRITE").otherwise("UPDATEHEADER"))
        .when(F.col("op") == "ERASEREF", F.when(F.col("ref_count") == 0, "ERASE").otherwise("UPDATEHEADER"))
        .otherwise("READ")
    )
    return resp.filter("hit").select("seq", "fingerprint", "ref_count", F.col("host_data_node").alias("ssd_node"), F.col("ssd_lba").alias("ssd_lba_start"), F.lit(1).cast("long").alias("ssd_lba_len"), "node_idx", kind.alias("ssd_op"))


def fp_table(resp: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Live entries after the operations of resp: those of state that they left alone, and what the others came to."""
    last = resp.filter("hit").groupBy("fingerprint").agg(F.max_by("ref_count", "seq").alias("ref_count"), F.max_by("ssd_lba", "seq").alias("ssd_lba"), F.max("node_idx").alias("node_idx"))
    now = last.select("fingerprint", "ref_count", "ssd_lba", bucket_index(F.col("fingerprint")).alias("bucket"), "node_idx")
    out = now.filter("ref_count > 0")
    return out if state is None else out.unionByName(state.join(now, "fingerprint", "left_anti"))


def unique_pages(pages: DataFrame) -> DataFrame:
    """First page of every fingerprint. Only (fingerprint, seq) is aggregated; other columns are joined back once."""
    first = pages.groupBy("fingerprint").agg(F.min("seq").alias("seq"))
    if set(pages.columns) == {"fingerprint", "seq"}:
        return first.select(*pages.columns)
    return pages.join(first, ["fingerprint", "seq"], "left_semi")


def read_back(resp: DataFrame) -> DataFrame:
    """(seq, fingerprint, stored_seq) of every read: the write whose page lies at the address that the read got, which is
    the one that stored the life it falls into; null for reads that miss, before the first write or after the last erase."""
    store = resp.filter("op = 'WRITE2FREE' and is_exec").select(F.col("ssd_lba").alias("_lba"), F.col("seq").alias("stored_seq"))
    reads = resp.filter("op = 'READSSD'").select("seq", "fingerprint", "ssd_lba")
    return reads.join(store, F.col("ssd_lba") == F.col("_lba"), "left").select("seq", "fingerprint", "stored_seq")
