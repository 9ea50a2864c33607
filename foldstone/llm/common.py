"""Shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np

#: Whether Spark removes the shuffle files of a query when it ends.
REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share. Only a session without executors of its own, as in tests,
    gets a temporary folder where none is set; a cluster's executors would not share that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp()}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end; else these stay until the driver happens to
    collect its garbage, and steps that follow one another take the disk of all together."""
    before = spark.conf.get(REMOVED, None)
    spark.conf.set(REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVED)
        else:
            spark.conf.set(REMOVED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: computed once, and lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")


def text_key(text: str) -> Column:
    """128 bits that stand for a text; equal texts are found by it without moving them."""
    return F.unhex(F.md5(utf8(text)))


def row_key(text: str, *others: str) -> Column:
    """128 bits that stand for a row: equal for rows that agree in the text and the other columns, nulls included."""
    return F.unhex(F.md5(F.concat(text_key(text), F.encode(F.to_json(F.struct(*others)), "utf-8"))))


def mixed64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
