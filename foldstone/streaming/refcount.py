"""Reference counts over micro-batches: keyed state of (running sum, running minimum)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldstone.config import LIVE_OPS
from foldstone.sources.shared import shared_folder

OUT = "seq long, op string, fingerprint string, ref_count long, hit boolean"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, low = state.get if state.exists else (0, 0)
    pdf = pd.concat(list(parts)).sort_values("seq")
    delta = pdf["op"].map({"WRITE2FREE": 1, "ERASEREF": -1}).fillna(0).astype("int64")
    s = total + delta.cumsum()
    m = s.cummin().clip(upper=low)
    count = s - m
    before = count.shift(fill_value=total - low)
    if count.iloc[-1]:
        state.update((int(s.iloc[-1]), int(m.iloc[-1])))
    elif state.exists:
        state.remove()  # a count of nothing is where a fingerprint starts
    yield pdf.assign(ref_count=count, hit=before > 0)[["seq", "op", "fingerprint", "ref_count", "hit"]]


def counted_stream(ops: DataFrame) -> DataFrame:
    """ops: a streaming frame in which no later batch holds a smaller seq of the same fingerprint. As in a batch, NOP and
    unknown operations, and those without a fingerprint, give no row; a fingerprint whose count is 0 keeps no state."""
    live = ops.filter(F.col("op").isin(*LIVE_OPS) & F.col("fingerprint").isNotNull())
    return live.select("seq", "op", "fingerprint").groupBy("fingerprint").applyInPandasWithState(_step, OUT, "total long, low long", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, ops: DataFrame) -> DataFrame:
    """Runs the stream over what is there, and reads its parquet sink again."""
    top = shared_folder(spark)
    query: Any = counted_stream(ops).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/out")

