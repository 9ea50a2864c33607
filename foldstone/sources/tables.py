"""Sources: pages cut from texts, and operation streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.config import DedupConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_pages(content: Column, page_size: int) -> Column:
    """Array of zero-padded pages of a text; null and empty texts are one all-zero page."""
    data = F.encode(F.coalesce(content, F.lit("")), "utf-8")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(page_size))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.rpad(F.substring(data, i * page_size + 1, F.lit(page_size)), page_size, F.lit(b"\x00")),
    )


def page_chunks(df: DataFrame, key: str, content: str, keep: tuple[str, ...] = (), config: DedupConfig = DedupConfig()) -> DataFrame:
    """One row per page: key, kept columns, page_no, seq and page_data. seq orders pages by key, then position."""
    return df.select(key, *keep, F.posexplode(fixed_pages(F.col(content), config.page_size)).alias("page_no", "page_data")).withColumn(
        "seq", F.col(key) * config.pages_per_doc + F.col("page_no")
    )


def event_ops(events: DataFrame) -> DataFrame:
    """Operations from the events table: errors erase, purchases read, all else writes."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "ERASEREF").when(F.col("event_type") == "purchase", "READSSD").otherwise("WRITE2FREE").alias("op"),
        F.col("user_id").alias("host_data_node"),
        F.col("event_id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("host_lba"),
        F.sha2(F.coalesce("props", F.lit("")), 256).alias("fingerprint"),
    )
