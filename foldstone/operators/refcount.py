"""Keyed reference counts: the state after every operation.

Every operation maps a count c to max(c + delta, 0), and such maps compose: a run of operations maps c to
total + max(c, -low), where low is the least running sum (0 at most). So the operations of a fingerprint are cut into
blocks of `seq`; a window counts inside each (fingerprint, block), one row a block is composed in block order, and what
a block starts from is joined back. A fingerprint with a third of all operations is then many tasks' work. Operations
without a fingerprint have no state and give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.functions.numbering import row_numbers
from foldstone.sources.shared import stored

#: Operations that one task counts for one fingerprint: sequence numbers of one block.
SEQ_BLOCK = 1 << 22
#: Blocks of page sequence numbers, which leave room for the longest document.
PAGE_BLOCK = 1 << 30
STATE_SEQ = -1
_PARTS = ["fingerprint", "_b"]


def _block(block: int) -> Column:
    return F.floor(F.col("seq") / F.lit(block))


def _earlier_blocks() -> Window:
    return Window.partitionBy("fingerprint").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block; both sides are dealt by (fingerprint, block), so rows stay where they are."""
    b = blocks.select(F.col("fingerprint").alias("_f"), F.col("_b").alias("_k"), *[c for c in blocks.columns if c not in _PARTS])
    return rows.join(b, (rows["fingerprint"] == b["_f"]) & (rows["_b"] == b["_k"])).drop("_f", "_k")


def write_only(pages: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """ref_count of every written page in input order; the first write of a fingerprint executes."""
    rows = pages.withColumn("_b", _block(block))
    inner = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*_PARTS).orderBy("seq")))
    sizes = rows.groupBy(*_PARTS).agg(F.count("*").alias("_size"))
    before = sizes.select(*_PARTS, F.coalesce(F.sum("_size").over(_earlier_blocks()), F.lit(0)).alias("_before"))
    counted = _joined(inner, before).withColumn("ref_count", F.col("_before") + F.col("_n"))
    return counted.select(*pages.columns, "ref_count", (F.col("ref_count") == 1).alias("is_exec"))


def mixed(ops: DataFrame, state: DataFrame | None = None, block: int = SEQ_BLOCK) -> DataFrame:
    """Adds ref_count, hit, is_alloc and is_gc. Counts never fall under zero; an erase or read that misses changes nothing.

    state(fingerprint, ref_count) is what earlier operations left. ops need seq >= 0; NOP and unknown ones give no row.
    """
    delta = F.when(F.col("op") == "WRITE2FREE", 1).when(F.col("op") == "ERASEREF", -1).otherwise(0).cast("long")
    live = ops.filter(F.col("op").isin("WRITE2FREE", "ERASEREF", "READSSD")).withColumn("_d", delta)
    if state is not None:
        before = state.select("fingerprint", F.lit(STATE_SEQ).cast("long").alias("seq"), F.col("ref_count").cast("long").alias("_d"))
        live = live.unionByName(before, allowMissingColumns=True)
    sofar = Window.partitionBy(*_PARTS).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = live.withColumn("_b", _block(block)).withColumn("_s", F.sum("_d").over(sofar)).withColumn("_m", F.least(F.lit(0), F.min("_s").over(sofar)))
    ends = inner.groupBy(*_PARTS).agg(F.sum("_d").alias("_total"), F.min("_m").alias("_low"))
    at = ends.withColumn("_at", F.coalesce(F.sum("_total").over(_earlier_blocks()), F.lit(0)))
    at = at.withColumn("_least", F.least(F.lit(0), F.min(F.col("_at") + F.col("_low")).over(_earlier_blocks())))
    rows = _joined(inner, at.select(*_PARTS, (F.col("_at") - F.col("_least")).alias("_from")))
    count, earlier = F.col("_s") + F.greatest("_from", -F.col("_m")), Window.partitionBy(*_PARTS).orderBy("seq")
    counted = rows.withColumn("ref_count", count).withColumn("_prev", F.coalesce(F.lag("ref_count").over(earlier), F.col("_from")))
    return counted.filter("op is not null").select(
        *ops.columns,
        "ref_count",
        (F.col("_prev") > 0).alias("hit"),
        ((F.col("op") == "WRITE2FREE") & (F.col("_prev") == 0)).alias("is_alloc"),
        ((F.col("op") == "ERASEREF") & (F.col("_prev") == 1)).alias("is_gc"),
    )


def is_exec() -> F.Column:
    return (
        F.when(F.col("op") == "WRITE2FREE", F.col("ref_count") == 1)
        .when(F.col("op") == "ERASEREF", F.col("hit") & (F.col("ref_count") == 0))
        .otherwise(F.lit(True))
    )


def with_fresh_lba(counted: DataFrame, state: DataFrame | None = None, start: int = 1, block: int = SEQ_BLOCK) -> DataFrame:
    """ssd_lba: the n-th allocation in input order gets start + n - 1; later operations of the same life carry it; misses show 0.

    state(fingerprint, ssd_lba) holds the lives that began before. Addresses come as rows of their own among the
    operations, so those move once, by (fingerprint, block); the last address of earlier blocks is joined as in mixed().
    The counted operations are stored once, as addresses and their carrying over both start from them.
    """
    counted = stored(counted)
    firsts = counted.filter("is_alloc").select("seq", "fingerprint")
    fresh = row_numbers(firsts, _block(block), [F.col("seq")], "_lba", start=start)
    if state is not None:
        fresh = fresh.unionByName(state.select("fingerprint", F.lit(STATE_SEQ).cast("long").alias("seq"), F.col("ssd_lba").cast("long").alias("_lba")))
    rows = counted.unionByName(fresh, allowMissingColumns=True).withColumn("_b", _block(block))
    # Of an allocation and its address, the address comes first.
    sofar = Window.partitionBy(*_PARTS).orderBy("seq", F.col("_lba").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("_own", F.last("_lba", ignorenulls=True).over(sofar))
    last = rows.groupBy(*_PARTS).agg(F.max_by("_lba", F.when(F.col("_lba").isNotNull(), F.col("seq"))).alias("_end"))
    carried = last.select(*_PARTS, F.last("_end", ignorenulls=True).over(_earlier_blocks()).alias("_carried"))
    held = _joined(inner, carried).filter("_lba is null")
    lba = F.when(F.col("hit") | F.col("is_alloc"), F.coalesce("_own", "_carried")).otherwise(F.lit(0)).cast("long")
    return held.select(*counted.columns, lba.alias("ssd_lba"))


def snapshot(ops: DataFrame) -> DataFrame:
    """Live fingerprints with their final count."""
    last = mixed(ops).groupBy("fingerprint").agg(F.max_by("ref_count", "seq").alias("ref_count"))
    return last.filter("ref_count > 0")
