"""Mixing sources to target weights along a curriculum.

Every source has a weight that changes with training time, a piecewise linear schedule. Its integral, scaled to the
source's target, is the source's cumulative demand. A source supplies its documents in the order of their hashed ids, as
one stream of words that starts anew until the target is reached; the document at the end is taken in part. A document
whose copy starts at word ``c`` of the stream is due when the demand reaches ``c``: the schedule's integral is inverted,
segment by segment, and the demand of all sources up to that time is its position in training.

Null texts and texts without words have size 0 and take no words. A null source is a source of its own, after all others.
Repeated rows are documents of their own. An empty table gives no rows.
Copies due at one position have no set order among each other. Texts of any length are counted whole. ``training_order`` hands
all columns on as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import SPACE, chunk_count, materialise
from parlance.operators.ordered import running_total

CYCLE = (3, 1, 2)
SHARE_NUMERATOR, SHARE_DENOMINATOR = 3, 2
MOST_REPEATS = 2
# (training time, multiple of the source's weight) at the corners, by weight class: fading, even and growing sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cycle=CYCLE) -> DataFrame:
    """Per source: rank, weight, words and target; ``sized`` has (_source, _size).

    The level that a unit of weight reaches rises until no source above its bound is left: each round looks at the
    sources still below theirs, as sums over the table of sources, and ends when no further source meets its bound.
    """
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("_words"))
    by_name = F.struct(F.col("_source").isNull().cast("int").alias("last"), F.col("_source").alias("name"))
    table = materialise(_ranked(sums, by_name).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_rank") % len(cycle) + 1).cast("int"))), "sources")
    cap = F.col("_words") * MOST_REPEATS
    level = 0.0
    while True:
        full = cap <= F.col("_weight") * F.lit(level)
        row = table.agg(F.sum("_words").alias("all"), F.sum(F.when(full, cap)).alias("full"),
                        F.sum(F.when(~full, F.col("_weight"))).alias("open")).first()
        if not row["open"] or row["all"] is None:
            break
        rest = (SHARE_NUMERATOR * row["all"] - SHARE_DENOMINATOR * (row["full"] or 0)) / SHARE_DENOMINATOR
        if rest / row["open"] <= level:
            break
        level = rest / row["open"]
    target = F.least(cap.cast("double"), F.col("_weight") * F.lit(level))
    return table.withColumn("_target", target)


def _ranked(sums: DataFrame, by_name: Column) -> DataFrame:
    """Rank from 0 by code point, nulls last: ranges are sorted apart, and only their sizes are added up."""
    ranged = sums.withColumn("_order", by_name).repartitionByRange(F.col("_order"))
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "source-ranges")
    before = {}
    at = 0
    for row in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before[row["_part"]], at = at, at + row["n"]
    offset = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")),
                        F.lit(0)) if before else F.lit(0)
    inside = Window.partitionBy("_part").orderBy("_order")
    return ranged.withColumn("_rank", (F.row_number().over(inside) - 1 + offset).cast("long")).drop("_order", "_part")


def _corners(schedule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, weights and integrals at the corners of a schedule, scaled to a whole integral of 1."""
    time, weight = (np.array(x, float) for x in zip(*schedule))
    parts = np.diff(time) * (weight[1:] + weight[:-1]) / 2
    return time, weight / parts.sum(), np.concatenate(([0.0], np.cumsum(parts) / parts.sum()))


def integral(at: np.ndarray, schedule) -> np.ndarray:
    """The share of a source's demand that has come up by some times."""
    time, weight, done = _corners(schedule)
    k = np.clip(np.searchsorted(time, at, "right") - 1, 0, len(time) - 2)
    length = np.diff(time)[k]
    s = np.clip((at - time[k]) / length, 0, 1)
    return done[k] + length * s * (weight[k] + (weight[k + 1] - weight[k]) * s / 2)


def inverse(share: np.ndarray, schedule) -> np.ndarray:
    """The times at which the integral reaches some shares: the root of a quadratic in each segment."""
    time, weight, done = _corners(schedule)
    k = np.clip(np.searchsorted(done, share, "right") - 1, 0, len(time) - 2)
    length = np.diff(time)[k]
    part = np.clip(share - done[k], 0, None) / length
    root = np.sqrt(np.maximum(weight[k] ** 2 + 2 * (weight[k + 1] - weight[k]) * part, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(part > 0, 2 * part / (weight[k] + root), 0.0)
    return time[k] + length * np.clip(s, 0, 1)


def curriculum(docs: DataFrame, cycle=CYCLE, schedules=SCHEDULES, payload: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies and positions.

    ``positions`` holds the training position of each copy, so it is empty for documents the mix leaves out. ``payload``
    is carried along as ``payload``.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"),
               words().alias("_size")]
    sized = docs.select(*columns)
    if payload is None:
        sized = materialise(sized, "sized")
        rows, n = sized, sized.count()
        targets = source_targets(sized, cycle)
    else:
        slim = materialise(sized, "sized")
        rows, n = docs.select(*columns, payload.alias("payload")), slim.count()
        targets = source_targets(slim, cycle)
    targets = materialise(targets, "targets")
    classes = targets.groupBy((F.col("_rank") % len(schedules)).alias("k")).agg(F.sum("_target").alias("t")).collect()
    demand = {r["k"]: r["t"] for r in classes}
    rows = rows.join(targets.select(F.col("_source").alias("_name"), "_rank", "_words", "_target"),
                     F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    # The order within a source is that of the hashed id; chunks are ranges of the hash.
    chunks = chunk_count(n)
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("_hash", hashed)
    chunk = F.floor(F.conv(F.substring("_hash", 1, 7), 16, 10).cast("long") * chunks / F.lit(1 << 28))
    rows = running_total(rows, ["_rank"], chunk, ["_hash", "doc_id", "_size"], F.col("_size"), "_upto")
    before = F.col("_upto") - F.col("_size")
    goal = F.round("_target").cast("long")
    taken = sum((F.greatest(F.least(F.col("_size"), goal - F.lit(k) * F.col("_words") - before), F.lit(0))
                 for k in range(MOST_REPEATS)), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("taken", taken.cast("long"))

    @F.pandas_udf("long")
    def position(kind: pd.Series, share: pd.Series) -> pd.Series:
        out = np.zeros(len(kind))
        for c, schedule in enumerate(schedules):
            here = (kind == c).to_numpy()
            time = inverse(share.to_numpy()[here], schedule)
            out[here] = sum(demand.get(j, 0.0) * integral(time, other) for j, other in enumerate(schedules))
        return pd.Series(np.floor(out).astype(np.int64))

    def due(k: int) -> Column:
        share = (F.lit(k) * F.col("_words") + F.col("_before")) / F.nullif(F.col("_target"), F.lit(0.0))
        return position((F.col("_rank") % len(schedules)).cast("int"), F.coalesce(share, F.lit(0.0)))

    # A copy of which less than half is taken stands in the word counts alone.
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("_size"))).cast("int")
    kept = ["payload"] if payload is not None else []
    return (rows.withColumn("copies", copies)
            .withColumn("positions", F.slice(F.array(*[due(k) for k in range(MOST_REPEATS)]), F.lit(1), F.col("copies")))
            .select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"),
                    F.col("_target").alias("target"), "taken", "copies", "positions", *kept))


def training_order(docs: DataFrame, cycle=CYCLE, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus: each document as often as it is copied, range-sorted by training position."""
    mixed = curriculum(docs, cycle, schedules, F.struct(*docs.columns))
    return (mixed.select(F.explode("positions").alias("_position"), "payload").orderBy("_position")
            .select(*[F.col("payload")[c].alias(c) for c in docs.columns]))
