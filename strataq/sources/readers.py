"""Readers for files that describe trees, batches, events and measurements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "path string, ordinal int, op string, key string, value binary"


def tree(spark: SparkSession, path: str, prune: list[str] | None = None) -> DataFrame:
    """Files below a folder with size, time, content and content id; pruned names are left out at any depth."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for name in prune or []:
        rows = rows.filter(~F.array_contains(F.split("path", "/"), name))
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("oid"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest lines: id, size, path (which may hold tabs); other lines are left out."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).filter(F.size(parts) == 3).select(F.get(parts, 0).alias("oid"), F.get(parts, 1).try_cast("long").alias("size"), F.get(parts, 2).alias("path")).filter("size IS NOT NULL")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark samples, one JSON object a line."""
    return spark.read.schema("workload string, side string, sample int, elapsed_ns long").json(path)


def events_since(events: DataFrame, cursor: int, order: str = "event_id") -> DataFrame:
    """Events after a cursor; ``strataq.operators.capture.journal_verdict`` says whether they are complete."""
    return events.filter(F.col(order) > cursor)


def batches(spark: SparkSession, path: str, most: int = 64) -> DataFrame:
    """Binary batch files: a 32-bit count, then for each change an op byte (1 put, 2 delete), and 32-bit lengths before key and value, all little-endian."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                data, at = bytes(data), 4
                count = int.from_bytes(data[:4], "little")
                if not 1 <= count <= most:
                    raise ValueError(f"{path}: a batch has 1 to {most} changes")
                for i in range(count):
                    op, at = data[at], at + 1
                    size, at = int.from_bytes(data[at : at + 4], "little"), at + 4
                    key, at = data[at : at + size].decode(), at + size
                    value = None
                    if op == 1:
                        size, at = int.from_bytes(data[at : at + 4], "little"), at + 4
                        value, at = data[at : at + size], at + size
                    elif op != 2:
                        raise ValueError(f"{path}: unknown op {op}")
                    out.append((path, i, "put" if op == 1 else "delete", key, value))
                if at != len(data):
                    raise ValueError(f"{path}: {len(data) - at} bytes too many")
            yield pd.DataFrame(out, columns=["path", "ordinal", "op", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, BATCH)
