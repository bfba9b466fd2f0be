"""Word-level difference of two message versions as an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.model import DIFF_TYPE

TOKEN = re.compile(r"\s+|\S+")


def diff_runs(old: list[str], new: list[str]) -> list[dict]:
    """Runs of kept, removed and added tokens along a longest common subsequence.

    Where both steps keep the subsequence equally long, the removal comes first.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    runs: list[dict] = []
    _extend(runs, "keep", old[:head])
    a, b = old[head:], new[head:]
    rows = _suffix_steps(a, b)
    here, below = next(rows), next(rows, 0)

    def common(steps: int, j: int) -> int:
        return (steps & ((1 << (len(b) - j)) - 1)).bit_count()

    i = j = 0
    gone: list[str] = []
    come: list[str] = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            _extend(runs, "del", gone)
            _extend(runs, "ins", come)
            _extend(runs, "keep", [a[i]])
            gone, come = [], []
            i, j, here, below = i + 1, j + 1, below, next(rows, 0)
        elif j == len(b) or (i < len(a) and common(below, j) >= common(here, j + 1)):
            gone.append(a[i])
            i, here, below = i + 1, below, next(rows, 0)
        else:
            come.append(b[j])
            j += 1
    _extend(runs, "del", gone)
    _extend(runs, "ins", come)
    return runs


ROWS_HELD = 64


def _suffix_steps(a: list[str], b: list[str]) -> Iterator[int]:
    """For every suffix of ``a``, the longest first, the positions where its common subsequence with ever longer suffixes of
    ``b`` grows, as bits counted from the end of ``b`` (bit-parallel row updates on whole integers).

    Rows follow from the shortest suffix up but are needed from the longest down. So the row in the middle is found first,
    then the upper half from it, then the lower half: at any time one row for each halving is held, and the rows of the
    smallest part, however long the texts are.
    """
    found: dict[str, int] = {}
    for k, token in enumerate(reversed(b)):
        found[token] = found.get(token, 0) | 1 << k
    full = (1 << len(b)) - 1

    def before(flat: int, token: str) -> int:
        hits = flat & found.get(token, 0)
        return ((flat + hits) | (flat - hits)) & full

    def part(low: int, high: int, flat: int) -> Iterator[int]:
        if high - low <= ROWS_HELD:
            held = []
            for i in range(high - 1, low - 1, -1):
                flat = before(flat, a[i])
                held.append(full & ~flat)
            yield from reversed(held)
            return
        middle, between = (low + high) // 2, flat
        for i in range(high - 1, middle - 1, -1):
            between = before(between, a[i])
        yield from part(low, middle, between)
        yield from part(middle, high, flat)

    yield from part(0, len(a), full)
    yield 0


def _extend(runs: list[dict], op: str, tokens: list[str]) -> None:
    if not tokens:
        return
    if runs and runs[-1]["op"] == op:
        runs[-1]["text"] += "".join(tokens)
    else:
        runs.append({"op": op, "text": "".join(tokens)})


def _diffs(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff_runs(TOKEN.findall(a or ""), TOKEN.findall(b or "")) for a, b in zip(old, new)])


# Runs between two texts, by words and the white space between them. Declared non-deterministic so that
# exploding the runs does not make Spark compute them a second time for a filter in front of the spread.
text_diff = F.pandas_udf(_diffs, DIFF_TYPE).asNondeterministic()


# Pairs of about so many bytes to a task: a comparison grows with the product of two lengths, moving texts with their sum.
TASK_BYTES = 4 << 20


def tasks_for(pairs: DataFrame, old: str, new: str) -> int:
    """Tasks to compare all pairs in, by the bytes of their texts, or for all cores at least. The bytes are added up, as the
    estimated size of a join is the product of its sides."""
    size = pairs.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in (old, new)))).first()[0] or 0
    return max(4 * pairs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)


def edit_diffs(pairs: DataFrame, old: str, new: str, name: str = "runs") -> DataFrame:
    """Add the runs between two text columns. The comparison costs far more than moving the texts, and input splits differ
    widely in that cost, so the pairs are spread evenly first."""
    return pairs.repartition(tasks_for(pairs, old, new)).withColumn(name, text_diff(old, new))
