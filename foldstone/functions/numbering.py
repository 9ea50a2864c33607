"""Row numbers and running totals that no single task has to compute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, block: Column, order: list[Column], amount: Column, to: str, within: list[str] | None = None) -> DataFrame:
    """Adds column `to`: the sum of amount over all earlier rows of the same `within` group, this row left out.

    Order: by block first, then by `order` inside a block, so block must not fall as the order rises. Rows are
    sorted inside (group, block) only; the blocks' sums, one row a block, are accumulated separately. Choose blocks
    so that one fits a task. Equal order values get numbers in an unspecified order.
    """
    keys = [F.col(c) for c in within or []]
    rows = df.withColumn("_block", block).withColumn("_amount", amount.cast("long"))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [*(within or []), "_block"]
    base = sums.select(*names, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    cond = [at[c].eqNullSafe(base[c]) for c in names]
    joined = at.join(base, cond, "inner")
    return joined.select(*[at[c] for c in df.columns], (F.col("_base") + F.col("_inner")).alias(to))


def row_numbers(df: DataFrame, block: Column, order: list[Column], to: str, within: list[str] | None = None, start: int = 1) -> DataFrame:
    out = running_total(df, block, order, F.lit(1), to, within)
    return out.withColumn(to, F.col(to) + start) if start else out
