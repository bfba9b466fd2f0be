"""Token counts by section: whole texts are encoded once, and each token goes to the section its characters lie in.

A section is a line with its line break; the rule for tokens that cross a border is: the section holding most of the
token's UTF-8 bytes takes it, among equals the first. Counts over the sections of a document thus add up to its tokens.

Null and empty texts have one empty section and no tokens. Rows are handled one by one, so repeated rows repeat.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import whole_text
from parlance.llm.tokens import RANKS, VOCABULARY, encoder

COLUMNS = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>, ids_crc32 long"


def sections(raw: bytes) -> np.ndarray:
    """Byte positions where sections start, and the end."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate(([0], breaks))
    if len(starts) > 1 and starts[-1] == len(raw):
        starts = starts[:-1]
    return np.append(starts, len(raw))


def attribute(borders: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border, from the tokens' sizes in order."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    section = np.searchsorted(borders[:-1], starts, "right") - 1
    last = np.searchsorted(borders[:-1], ends - 1, "right") - 1
    crossing = np.flatnonzero(last > section)
    for k in crossing.tolist():
        inner = borders[section[k] + 1:last[k] + 1]
        shares = np.diff(np.concatenate(([starts[k]], inner, [ends[k]])))
        section[k] += int(shares.argmax())
    return np.bincount(section, minlength=len(borders) - 1), len(crossing)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Per document its tokens, its sections, the tokens of each section in order, and a checksum of the ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column("text"):
                text = value.as_py()
                ids = encode(text)
                borders = sections(text.encode("utf-8", "surrogatepass"))
                found, crossing = attribute(borders, encode.sizes[np.frombuffer(ids, "<u4")])
                for column, x in zip(out, (len(ids) // 4, len(found), crossing, found, zlib.crc32(ids))):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds))],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(count, COLUMNS)
