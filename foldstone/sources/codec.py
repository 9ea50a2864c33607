"""Optional binary codec for 512-bit instruction and response words (little bit offsets, opcode in the top two bits)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from foldstone.config import OPS

_LOW = (1 << 32) - 1


def pack_instruction(op: str, start: int = 0, length: int = 0, node: int = 0, fingerprint: str | None = None) -> bytes:
    body = int(fingerprint, 16) if fingerprint else (length & _LOW) | (start & _LOW) << 32 | (node & _LOW) << 64
    return (body | OPS.index(op) << 510).to_bytes(64, "little")


def unpack_instruction(word: bytes) -> dict:
    bits = int.from_bytes(word, "little")
    op = OPS[bits >> 510]
    if op in ("ERASEREF", "READSSD"):
        return {"op": op, "start": 0, "length": 1, "node": 0, "fingerprint": f"{bits & (1 << 256) - 1:064x}"}
    write = op == "WRITE2FREE"
    return {"op": op, "start": (bits >> 32 & _LOW) * write, "length": (bits & _LOW) * write, "node": (bits >> 64 & _LOW) * write, "fingerprint": None}


def pack_response(fingerprint: str, ref_count: int, ssd_lba: int, node_idx: int, start: int, length: int, node: int, is_exec: bool, op: str) -> bytes:
    bits = int(fingerprint, 16)
    for at, v in ((256, ref_count), (288, ssd_lba), (320, node_idx), (352, start), (384, length), (416, node)):
        bits |= (v & _LOW) << at
    return (bits | int(is_exec) << 509 | OPS.index(op) << 510).to_bytes(64, "little")


def decode_instructions(words: DataFrame) -> DataFrame:
    """words(seq, word binary) to flat instruction columns; invalid and NOP words give no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"seq": s, **unpack_instruction(bytes(w))} for s, w in zip(part["seq"], part["word"], strict=True) if w is not None and len(w) == 64]
            yield pd.DataFrame([r for r in rows if r["op"] != "NOP"], columns=["seq", "op", "start", "length", "node", "fingerprint"])

    return words.select("seq", "word").mapInPandas(run, "seq long, op string, start long, length long, node long, fingerprint string")


def split_stream(data: bytes, page_size: int = 4096) -> Iterator[tuple[dict, list[bytes]]]:
    """Instructions of one merged host stream, each with the pages that follow it. A write of no pages takes none."""
    at = 0
    while at + 64 <= len(data):
        instr = unpack_instruction(data[at : at + 64])
        at += 64
        n = instr["length"] if instr["op"] == "WRITE2FREE" else 0
        if instr["op"] != "NOP":
            yield instr, [data[at + i * page_size : at + (i + 1) * page_size].ljust(page_size, b"\0") for i in range(n)]
        at += n * page_size


def host_streams(spark: SparkSession, path: str, page_size: int = 4096) -> DataFrame:
    """Merged host streams, one file each: (path, instr, page_no, op, host_lba, host_data_node, fingerprint, page_data).

    A write gives a row for each of its pages, at consecutive addresses modulo 2^32, and none if it has no pages; its
    fingerprint is null until the page is hashed. Files are read in parallel, each by one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                for i, (instr, pages) in enumerate(split_stream(bytes(content), page_size)):
                    cut: list[bytes | None] = [*pages] if instr["op"] == "WRITE2FREE" else [None]
                    rows = [(name, i, k, instr["op"], instr["start"] + k & _LOW, instr["node"], instr["fingerprint"], p) for k, p in enumerate(cut)]
                    yield pd.DataFrame(rows, columns=["path", "instr", "page_no", "op", "host_lba", "host_data_node", "fingerprint", "page_data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, instr long, page_no int, op string, host_lba long, host_data_node long, fingerprint string, page_data binary")
