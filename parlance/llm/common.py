"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.session import materialise

SPACE = "\\x20\\x09-\\x0D"
WORDS = re.compile(f"[^{SPACE}]+")
CHUNK_CHARS = 4_000_000
SAMPLE_CHARS = 20_000_000

__all__ = ["SPACE", "WORDS", "CHUNK_CHARS", "SAMPLE_CHARS", "table", "key_hash", "held_out", "whole_text", "materialise", "text_chunks", "chunk_count",
           "labelled_sample"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def key_hash(key: str = "doc_id") -> Column:
    """CRC-32 of the key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    return key_hash(key) % modulus == remainder


def chunk_count(rows: int, least: int = 500) -> int:
    """Chunks for an ordered pass over a group that may hold all rows: as many as each has rows, so neither grows with the input
    faster than its root."""
    return max(1, rows // max(least, math.isqrt(rows)))


def text_chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts into runs (start, end) of about ``limit`` characters, so that long texts bound the memory."""
    start = size = end = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= limit:
            yield start, end
            start, size = end, 0
    if start < end:
        yield start, end


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key_remainder: Column,
                    chars: int = SAMPLE_CHARS) -> Iterator[tuple[str, int]]:
    """Whole texts with their 0/1 label, of each at most ``per_class`` ids and ``chars`` characters, by hashed id.

    Only this bounded sample reaches the driver, and each text is let go once it was handed out. Of several texts of an id the
    first in order counts; labels given twice for an id count once, the larger one.
    """
    ids = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~key_remainder)
           .groupBy("doc_id").agg(F.max(label).alias("_label")))
    picked = None
    for value in (0, 1):
        part = ids.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = (docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(picked), "doc_id")
             .groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")))
    so_far = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("_chars", F.sum(F.length("_text")).over(so_far)).filter(F.col("_chars") <= chars).select("doc_id", "_text", "_label").collect()
    rows.sort(key=lambda r: r["doc_id"], reverse=True)
    while rows:
        _, text, value = rows.pop()
        yield text, value
