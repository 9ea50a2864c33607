"""Scalar functions on pages and fingerprints."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.config import DedupConfig


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


@F.pandas_udf(T.StringType())
def sha3_256_hex(data: pd.Series) -> pd.Series:
    """Catalyst has no SHA-3; Arrow batches to hashlib."""
    return data.map(lambda x: None if x is None else hashlib.sha3_256(x).hexdigest())


@F.pandas_udf(T.StringType())
def sha3_512_hex(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else hashlib.sha3_512(x).hexdigest())


def _low(fp: Column) -> Column:
    return F.conv(F.substring(fp, -8, 8), 16, 10).cast("bigint")


def bucket_index(fp: Column, config: DedupConfig = DedupConfig()) -> Column:
    """The lowest bits of the fingerprint."""
    return _low(fp).bitwiseAND(F.lit((1 << config.idx_bucket_width) - 1))


def routing_key(fp: Column, config: DedupConfig = DedupConfig()) -> Column:
    """The bits just above those of the bucket (needs width + bits <= 32)."""
    return F.shiftright(_low(fp), config.idx_bucket_width).bitwiseAND(F.lit((1 << config.routing_bits) - 1)).cast("int")


def bloom_mask(fp: Column, config: DedupConfig = DedupConfig()) -> Column:
    """OR of k one-hot masks whose positions are slices of the top k * log2(m) bits."""
    width = config.bloom_bits_log2 * config.bloom_k
    top = F.shiftright(F.conv(F.substring(fp, 1, 8), 16, 10).cast("bigint"), 32 - width)
    mask = F.lit(0).cast("bigint")
    for j in range(config.bloom_k):
        at = F.shiftright(top, j * config.bloom_bits_log2).bitwiseAND(F.lit((1 << config.bloom_bits_log2) - 1)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def ring(value: Column, bits: int) -> Column:
    return F.pmod(value, F.lit(1 << bits))
