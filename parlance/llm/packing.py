"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. How many pieces have each length is a table of at most
``capacity`` rows, whatever the corpus. Over it a bitset subset-sum finds the fullest combination that holds the longest
length left; the combination is taken as often as the counts allow, so that the plan has a row per distinct combination.
The pieces, numbered per length, then look up their places in the plan on the executors.

Empty or null texts give one piece holding the end id. Repeated rows are packed each. An empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import chunk_count, materialise, whole_text
from parlance.llm.tokens import RANKS, VOCABULARY, encoder
from parlance.operators.ordered import running_total

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
           ranks: str = RANKS) -> DataFrame:
    """One row per piece. Only documents above ``capacity`` are cut; the first piece takes what is left over."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                view, at, k, n = memoryview(ids), 0, 0, len(ids) // 4
                upto = n % capacity or capacity
                while at < n:
                    for column, value in zip(out, (doc_id, k, at, upto - at, zlib.crc32(view[4 * at:4 * upto]))):
                        column.append(value)
                    at, upto, k = upto, upto + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as they can, longer lengths first among equals."""
    items = []
    for length in sorted(counts):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            items.append((length, min(step, left)))
            left -= step
            step *= 2
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length, times in items:
        reach.append((reach[-1] | reach[-1] << length * times) & mask)
    at, chosen = reach[-1].bit_length() - 1, {}
    for k in range(len(items), 0, -1):
        length, times = items[k - 1]
        rest = at - length * times
        if rest >= 0 and reach[k - 1] >> rest & 1:
            chosen[length] = chosen.get(length, 0) + times
            at = rest
    return chosen


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is taken, until no piece is left."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        rest = {k: n - (k == seed) for k, n in left.items() if n - (k == seed) > 0}
        one = fullest(rest, capacity - seed)
        one[seed] = one.get(seed, 0) + 1
        times = min(left[k] // n for k, n in one.items())
        for k, n in one.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((one, times))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces a sequence, first sequence, first offset), by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for one, times in plan:
        offset = 0
        for length in sorted(one, reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), one[length], sequence, offset))
            used[length] = used.get(length, 0) + one[length] * times
            offset += length * one[length]
        sequence += times
    return {k: np.array(rows, np.int64) for k, rows in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
         ranks: str = RANKS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: sequences are filled from 0 without gaps."""
    cut = materialise(pieces(docs, capacity, end_id, vocabulary, ranks), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = chunk_count(sum(counts.values()))
    numbered = running_total(cut, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)),
                             ["doc_id", "piece"], F.lit(1), "_nth")
    places = docs.sparkSession.sparkContext.broadcast(slots(packing_plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_nth").to_numpy() - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == value), table[value]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * value
            kept = [c for c in batch.schema.names if c != "_nth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                                             [*kept, "sequence_id", "offset"])

    return (numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "_nth")
            .mapInArrow(place, f"{PIECES}, sequence_id long, offset long"))
