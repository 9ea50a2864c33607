"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing, each on what the one before kept.

Every stage takes (spark, docs, sf_dir); run() writes each result as Parquet to the shared folder and reads it again.

A row is its id, language, source and text. Null ids, and ids that repeat with other texts, keep their rows apart in every
stage; rows alike share their fate, and of near-duplicates one row stays. Null and empty texts fail the quality rules.
Texts may be of any length and columns beyond those of `documents` may have any name but those starting with
`_pipeline`; they are carried along up to packing, which returns pieces. Ties go to the least id, then to the least digest
of the text. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from foldstone.llm.common import row_key, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Most tokens, as a multiple of the source's, that mixing takes of any source.
MAX_EPOCHS = 2
#: The vocabulary whose tokens are mixed and packed.
TOKENIZER = "byte_bpe_50k.json"
#: Names, that no table has, of a row's digest and of those that a stage picks.
ROW, PICKED = "_pipeline_row", "_pipeline_picked"


def rows(docs: DataFrame) -> DataFrame:
    """docs with ROW: rows are told apart by all that a decision depends on, so null or repeated ids mix nothing up."""
    return docs.withColumn(ROW, row_key("text", "doc_id", "lang", "source"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    named = rows(docs)
    kept = quality_rules.judged(named, ROW).filter("kept").select(F.col(ROW).alias(PICKED)).distinct()
    return named.join(kept, F.col(ROW) == F.col(PICKED), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dedup.deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first."""
    return substring_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to sources by the square root of their size; small ones come up to twice.

    Rows that repeat id, language, source and text are picked together, once in each epoch that picks one of them.
    """
    levels = [mixing.source_domain("source"), F.col("lang"), F.col("source")]
    named = rows(docs)
    picked = mixing.mix(named, public_tokenizers.path(TOKENIZER), levels, max_epochs=MAX_EPOCHS, key=ROW).select(F.col(ROW).alias(PICKED), "epoch").distinct().drop("epoch")
    return named.join(picked, F.col(ROW) == F.col(PICKED)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of 2048."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("mixing", mixture),
    ("packing", sequences),
]

#: SQL can express neither shingle classes nor tokens. tests/llm compares near-dedup as a stage with brute force, and the other
#: stages' operators; as stages, and run() as a whole, those are held to invariants only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
