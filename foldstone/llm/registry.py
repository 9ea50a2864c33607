"""The queries of this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import html_extract, mixing, near_dedup, nearest, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_counts
from foldstone.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tokens over which a text counts as long.
TOKEN_LIMIT = 4096
#: Target weights of the mixture: of domains, and of languages in each domain; sources share by their size.
DOMAINS = {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}
LANGUAGES = {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}
TARGETS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGUAGES.items()}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality_classifier.classify(table(spark, d, "documents"))


@query
def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


@query
def token_prefix_tables(spark: SparkSession, d: str) -> DataFrame:
    """The counts of op2 at every prefix, as they are stored."""
    return token_counts.prefix_tables(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    levels = [mixing.source_domain("source"), F.col("lang"), F.col("source")]
    mixed = mixing.mix(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), levels, weights=TARGETS)
    return mixed.select("doc_id", F.col("_level0").alias("domain"), F.col("_level1").alias("lang"), F.col("_level2").alias("source"), "n_tokens", "epoch", "leaf_offset")


@query
def op4_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, d, "documents"))


@query
def op5_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages"))


@query
def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, d, "documents"))


@query
def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"))


@query
def op9_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest.search(table(spark, d, "embeddings"))


@query
def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judged(table(spark, d, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op10_quality_rules"] = quality_rules.sql()
QUERIES["pipeline"] = corpus_pipeline.run
