"""Bloom filters of buckets, exact for the live entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.functions.fingerprint import bloom_mask, bucket_index


def filters(table: DataFrame) -> DataFrame:
    return table.groupBy(bucket_index(F.col("fingerprint")).alias("bucket")).agg(F.bit_or(bloom_mask(F.col("fingerprint"))).alias("bloom"), F.count("*").alias("entries"))


def probes(reads: DataFrame, table: DataFrame) -> DataFrame:
    """Each probe with whether the filter lets it skip the chain."""
    keyed = reads.withColumn("bucket", bucket_index(F.col("fingerprint"))).withColumn("mask", bloom_mask(F.col("fingerprint")))
    bloom = F.coalesce("bloom", F.lit(0))
    return keyed.join(filters(table), "bucket", "left").withColumn("skipped", bloom.bitwiseAND(F.col("mask")) != F.col("mask"))
