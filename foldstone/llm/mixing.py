"""Mixing sources to target weights (operator 3): hierarchical budgets over a domain - language - source tree.

A token budget is dealt down the tree by weight. What a node cannot use (its supply is `max_epochs` times its tokens)
goes to its siblings first, by their weights, and only what the whole family cannot use goes to the parent's siblings:
each level is filled up to the children's total supplies, so a shortage leaves a family only when all of it is full.
Of a family sorted by supply over weight, the full children are those up to a place, which running sums find, and the
others share the rest: a window over the family's nodes, without a bound on their number and without the driver. Nodes
without a given weight weigh as their tokens to the power `temper`, as a share of their family's.

A leaf's quota is whole epochs of all its documents, and of one more epoch the first documents in that epoch's seeded
order whose tokens before them are under the rest: a token-prefix, one document longer than the rest at most. Prefix
sums are taken in hash-range blocks, so a leaf with a third of all rows is many tasks' work. Rows get their place by a
hash of key and text, so rows without a key are spread as well.

Null and empty texts have 0 tokens: they come with every whole epoch, and in a part by their place in the order. Texts
may be of any length; one longer than the rest is taken if it begins under it. Null domains, languages or sources are a
node of their own. Repeated rows count each and get neighbouring places, ties among them in any order. An empty table
gives an empty result. Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.functions.numbering import running_total
from foldstone.llm.common import stored
from foldstone.llm.packing import writer

#: Rows that one task sums.
SUM_BLOCK = 100_000


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _shares(nodes: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """nodes (supply, weight, budget of the family) with quota: the family's budget by weight, no node over its supply."""
    able = (F.col("supply") > 0) & (F.col("weight") > 0)
    full_size = nodes.withColumn("_s", F.when(able, F.col("supply").cast("double")).otherwise(0.0)).withColumn("_w", F.when(able, F.col("weight")).otherwise(0.0))
    all_of = Window.partitionBy(*family)
    by = all_of.orderBy(F.when(able, F.col("_s") / F.col("_w")).asc_nulls_first(), *order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.least("budget", F.sum("_s").over(all_of)) - F.coalesce(F.sum("_s").over(before), F.lit(0.0))
    rest = F.sum("_w").over(all_of) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = full_size.withColumn("_left", left).withColumn("_rest", rest).withColumn("_level", F.when(F.col("_rest") > 0, F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_rest")))
    full = level.withColumn("_full", F.col("_s") * (1 - 1e-12) <= F.col("_w") * F.coalesce("_level", F.lit(0.0)))
    # Beyond the first node that is not full the level only falls, so it is the greatest of theirs.
    share = F.when(F.col("_full"), F.col("_s")).otherwise(F.col("_w") * F.max(F.when(~F.col("_full"), F.col("_level"))).over(all_of))
    return full.withColumn("quota", F.when(able, share).otherwise(0.0)).drop("_s", "_w", "_left", "_rest", "_level", "_full")


def quotas(leaves: DataFrame, names: list[str], budget: float, weights: Mapping[tuple, float] | None = None, temper: float = 0.5, max_epochs: int = 2) -> DataFrame:
    """leaves(names, t: tokens) with the quota of each; weights by path of any node."""
    spark = leaves.sparkSession
    given = weights or {}
    dealt: DataFrame | None = None
    for depth in range(1, len(names) + 1):
        path, family = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*path).agg((F.sum("t") * max_epochs).alias("supply"))
        mine = [(*k, float(v)) for k, v in given.items() if len(k) == depth]
        kinds = ", ".join([*(f"_g{i} string" for i in range(depth)), "_given double"])
        known = spark.createDataFrame(mine, kinds)
        nodes = nodes.join(known, _same(path, [f"_g{i}" for i in range(depth)]), "left").drop(*[f"_g{i}" for i in range(depth)])
        power = F.when(F.col("supply") > 0, F.pow(F.col("supply").cast("double"), F.lit(float(temper)))).otherwise(0.0)
        total = F.sum(power).over(Window.partitionBy(*family).orderBy(*path).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        nodes = nodes.withColumn("weight", F.coalesce("_given", power / F.when(total > 0, total).otherwise(1.0))).drop("_given")
        if dealt is None:
            nodes = nodes.withColumn("budget", F.lit(float(budget)))
        else:
            above = dealt.select(*[F.col(n).alias(f"_p{i}") for i, n in enumerate(family)], F.col("quota").alias("budget"))
            nodes = nodes.join(above, _same(family, [f"_p{i}" for i in range(depth - 1)])).drop(*[f"_p{i}" for i in range(depth - 1)])
        dealt = _shares(nodes, family, path).select(*path, "quota")
    assert dealt is not None
    out = dealt.select(*[F.col(n).alias(f"_q{i}") for i, n in enumerate(names)], "quota")
    return leaves.join(out, _same(names, [f"_q{i}" for i in range(len(names))])).drop(*[f"_q{i}" for i in range(len(names))])


def counted(docs: DataFrame, tokens: Column | str, levels: list[Column], names: list[str], key: str, text: str) -> DataFrame:
    """_key, _row, n_tokens and levels of every row; tokens is an expression, or the file of a byte-level BPE that counts."""
    narrow = [F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"), *[c.cast("string").alias(n) for c, n in zip(levels, names, strict=True)]]
    if isinstance(tokens, Column):
        return docs.select(*narrow, tokens.cast("long").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = writer(tokens).ids
        for batch in batches:
            n = [len(ids(v.as_py() or "")) // 4 for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    with_text = docs.select(*narrow, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_text.schema[:-1])
    return with_text.mapInArrow(run, f"{kinds}, n_tokens long")


def mix(
    docs: DataFrame,
    tokens: Column | str,
    levels: list[Column],
    budget_share: float = 1.0,
    weights: Mapping[tuple, float] | None = None,
    temper: float = 0.5,
    max_epochs: int = 2,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """key, n_tokens, _level0.., epoch and leaf_offset (tokens before it in its epoch's part, null in whole epochs) of each selected document."""
    names = [f"_level{i}" for i in range(len(levels))]
    rows = stored(counted(docs, tokens, levels, names, key, text), "mix-rows")
    leaves = stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "leaves")
    total, count = leaves.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    quota = F.round("quota").cast("long")
    whole = F.when(F.col("t") > 0, F.least(F.floor(quota / F.col("t")), F.lit(max_epochs))).otherwise(1).cast("int")
    plan = quotas(leaves, names, budget_share * total, weights, temper, max_epochs).withColumn("_whole", whole)
    plan = plan.select(*[F.col(n).alias(f"_p{i}") for i, n in enumerate(names)], "_whole", F.when(F.col("t") > 0, quota - F.col("_whole") * F.col("t")).otherwise(0).cast("long").alias("_rest"))
    columns = ["_key", "_row", "n_tokens", *names]
    planned = rows.join(stored(plan, "plan"), _same(names, [f"_p{i}" for i in range(len(names))])).select(*columns, "_whole", "_rest")
    out = ["_key", "n_tokens", *names]
    repeated = planned.filter("_whole > 0").select(*out, F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("epoch"), F.lit(None).cast("long").alias("leaf_offset"))
    shift = 64 - max(1, (max(64, count // SUM_BLOCK) - 1).bit_length())
    part = planned.filter("_rest > 0").withColumn("_at", F.xxhash64("_row", F.lit(seed), "_whole"))
    summed = running_total(part, F.shiftright("_at", shift), [F.col("_at"), F.col("_key"), F.col("n_tokens")], F.col("n_tokens"), "leaf_offset", names)
    prefix = summed.filter("leaf_offset < _rest").select(*out, F.col("_whole").alias("epoch"), "leaf_offset")
    return repeated.unionByName(prefix).withColumnRenamed("_key", key)


def word_tokens(text: str) -> Column:
    """Words of a text, for mixing by words: no tokenizer is needed for that."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def source_domain(source: str) -> Column:
    """Domain of a source of the synthetic corpus: its number modulo 4; others have the domain `other`."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))
