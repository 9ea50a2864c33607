"""The engine with state that outlives a batch: fingerprint table, unique pages, responses and storage commands.

Every table lives in one folder that all executors share. A batch writes its tables under a new name and becomes visible
by one row appended to the log, so a batch that fails or is repeated leaves nothing behind that counts. One batch at a
time: there is a single writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foldstone.config import NEAREST, DedupConfig, RoutingTable
from foldstone.functions.fingerprint import routing_key
from foldstone.operators import routing, storage
from foldstone.schemas import FP_TABLE

LOG = "batch long, path string, next_lba long"


class DedupEngine:
    def __init__(self, spark: SparkSession, folder: str, config: DedupConfig = DedupConfig(), table: RoutingTable = NEAREST) -> None:
        """Continues the state in `folder`; call clear() once on a new one."""
        self.spark, self.folder, self.config, self.routing = spark, folder, config, table

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def _last(self) -> Row:
        return self._log().orderBy(F.col("batch").desc()).limit(1).first()

    def _append(self, batch: int, path: str | None, next_lba: int) -> None:
        self.spark.createDataFrame([(batch, path, next_lba)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _node(self) -> Column:
        key = routing_key(F.col("fingerprint"), self.config)
        return routing.node_of(routing.channel(key, self.routing), self.routing)

    def clear(self) -> None:
        """An empty table; addresses start again at 1. Tables of earlier batches stay on disk but count no more."""
        self.spark.createDataFrame([(0, None, 1)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log")

    def table(self) -> DataFrame:
        """Live fingerprints: count, address, bucket and owner."""
        path = self._last()["path"]
        return self.spark.createDataFrame([], FP_TABLE) if path is None else self.spark.read.schema(FP_TABLE).parquet(f"{path}/table")

    def run(self, ops: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """Responses to ops(seq >= 0, op, host_lba, host_data_node, fingerprint), after all earlier batches.

        pages(seq, page_data), if given, holds the bytes of writes; only those of pages stored for the first time are
        kept, under their address. Storage commands are written beside the responses.
        """
        last, path = self._last(), f"{self.folder}/{uuid.uuid4().hex}"
        state = self.table()
        storage.responses(ops, self._node(), state, last["next_lba"]).write.parquet(f"{path}/responses")
        resp = self.spark.read.parquet(f"{path}/responses")
        storage.ssd_commands(resp).write.parquet(f"{path}/commands")
        storage.fp_table(resp, state).write.parquet(f"{path}/table")
        if pages is not None:
            new = resp.filter("op = 'WRITE2FREE' and is_exec").select("seq", "ssd_lba", "fingerprint")
            pages.select("seq", "page_data").join(new, "seq").drop("seq").write.parquet(f"{path}/pages")
        used = resp.agg(F.max("ssd_lba").alias("lba")).first()["lba"] or 0
        self._append(last["batch"] + 1, path, max(last["next_lba"], used + 1))
        return resp

    def commands(self) -> DataFrame:
        """Storage commands of the last batch."""
        return self.spark.read.parquet(f"{self._last()['path']}/commands")

    def pages(self) -> DataFrame:
        """(fingerprint, ssd_lba, page_data) of the pages that are live now, of all batches that kept bytes."""
        paths = [r["path"] for r in self._log().filter("path is not null").select("path").collect()]  # one row a batch
        schema = "page_data binary, ssd_lba long, fingerprint string"
        kept = self.spark.read.schema(schema).option("ignoreMissingFiles", "true")
        found = kept.parquet(*[f"{p}/[p]ages" for p in paths]) if paths else self.spark.createDataFrame([], schema)
        return found.join(self.table().select("fingerprint", "ssd_lba"), ["fingerprint", "ssd_lba"], "left_semi").select("fingerprint", "ssd_lba", "page_data")
