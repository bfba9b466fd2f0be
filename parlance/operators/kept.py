"""Aggregates that are kept up to date: what a change adds and takes away is folded into stored tables.

``cells`` count messages by (chat, sender, direction, UTC day), ``files`` count media by (chat, kind, direction), and both fold:
rows that enter count once, rows that leave count minus once, and cells that reach zero vanish. Earliest and latest times don't
fold when rows leave; ``bounds`` holds them per chat, and only chats in which a leaving row stood on a bound are looked up again
in the messages. Overview, media statistics, day counts and unread counts come from these small tables alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.times import local_day
from parlance.model import MEDIA_KINDS, VISIBLE_MEDIA_STATUS
from parlance.operators import overview
from parlance.session import materialise

CELL = ["chat_id", "sender_person_id", "is_me", "day"]
COUNTS = ["n", "shown", "unread", "shown_unread"]
FILE_CELL, FILE_COUNTS = ["chat_id", "kind", "is_me"], ["n", "bytes"]
BOUNDS = {"first": F.min, "last": F.max, "last_new": F.max}


@dataclass
class Kept:
    """Stored tables of the aggregates, small beside the messages."""

    cells: DataFrame
    files: DataFrame
    bounds: DataFrame

    def stored(self) -> Kept:
        """Written and read again, to go on from."""
        return Kept(materialise(self.cells, "cells"), materialise(self.files, "files"), materialise(self.bounds, "bounds"))


def _shown() -> Column:
    return F.col("media_status").isin(*VISIBLE_MEDIA_STATUS)


def _new() -> Column:
    return F.col("sync_state") == "new"


def message_cells(messages: DataFrame, sign: int = 1) -> DataFrame:
    def counted(condition: Column) -> Column:
        return (F.count_if(condition) * sign).cast("bigint")

    return messages.groupBy("chat_id", "sender_person_id", "is_me", local_day(F.col("ts"), "UTC").alias("day")).agg(
        counted(F.lit(True)).alias("n"), counted(_shown()).alias("shown"), counted(_new()).alias("unread"), counted(_shown() & _new()).alias("shown_unread"))


def file_cells(media: DataFrame, owners: DataFrame, sign: int = 1) -> DataFrame:
    """Media with a file of the messages ``owners`` (id, chat_id, is_me)."""
    counts = overview.media_counts(owners, media)
    return counts.select(*FILE_CELL, *[(F.col(c) * sign).cast("bigint").alias(c) for c in FILE_COUNTS])


def time_bounds(messages: DataFrame) -> DataFrame:
    """Per chat the earliest and latest time of visible messages and the latest of unread ones."""
    shown, new = F.when(_shown(), F.col("ts")), F.when(_new(), F.col("ts"))
    return messages.groupBy("chat_id").agg(F.min(shown).alias("first"), F.max(shown).alias("last"), F.max(new).alias("last_new"))


def start(messages: DataFrame, media: DataFrame) -> Kept:
    return Kept(message_cells(messages), file_cells(media, messages), time_bounds(messages))


def folded(stored: DataFrame, changes: list[DataFrame], keys: list[str], counts: list[str]) -> DataFrame:
    rows = stored
    for change in changes:
        rows = rows.unionByName(change)
    some = F.lit(False)
    for c in counts:
        some = some | (F.col(c) != 0)
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in counts]).filter(some)


def moved_bounds(bounds: DataFrame, entering: DataFrame, leaving: DataFrame, messages: DataFrame) -> DataFrame:
    """Bounds after rows entered and left; ``messages`` is the archive after the change, read for the touched chats only."""
    names = list(BOUNDS)
    gone = time_bounds(leaving).select("chat_id", *[F.col(c).alias(f"_{c}") for c in names])
    on_bound = F.lit(False)
    for c in names:
        on_bound = on_bound | F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    loose = materialise(bounds.join(gone, "chat_id").filter(on_bound).select("chat_id"), "loose-bounds")
    again = time_bounds(messages.join(loose, "chat_id", "left_semi"))
    rows = bounds.join(loose, "chat_id", "left_anti").unionByName(time_bounds(entering).join(loose, "chat_id", "left_anti")).unionByName(again)
    held = rows.groupBy("chat_id").agg(*[f(c).alias(c) for c, f in BOUNDS.items()])
    return held.filter(F.coalesce(*names).isNotNull())


def after(kept: Kept, entering: DataFrame, leaving: DataFrame, messages: DataFrame, media_in: DataFrame, media_out: DataFrame) -> Kept:
    """The kept tables after a change.

    ``entering`` and ``leaving`` are message rows; a changed row leaves as it was and enters as it is. ``media_in`` and
    ``media_out`` are media rows with their owner's chat_id and is_me, given where media or their owners come or go.
    """
    def of(media: DataFrame, sign: int) -> DataFrame:
        owners = media.select(F.col("message_id").alias("id"), "chat_id", "is_me").distinct()
        return file_cells(media.drop("chat_id", "is_me"), owners, sign)

    return Kept(
        folded(kept.cells, [message_cells(entering), message_cells(leaving, -1)], CELL, COUNTS),
        folded(kept.files, [of(media_in, 1), of(media_out, -1)], FILE_CELL, FILE_COUNTS),
        moved_bounds(kept.bounds, entering, leaving, messages))


def owned(media: DataFrame, messages: DataFrame) -> DataFrame:
    """Media of some messages with their owner's chat_id and is_me."""
    return media.join(messages.select(F.col("id").alias("message_id"), "chat_id", "is_me"), "message_id")


# --- what the aggregates say ---------------------------------------------------------------------------


def activity(kept: Kept, persons: DataFrame) -> DataFrame:
    """``overview.chat_activity`` from the kept tables."""
    by_sender = kept.cells.groupBy("chat_id", "sender_person_id").agg(
        F.sum("shown").alias("total"), F.sum(F.when(F.col("is_me"), F.col("shown")).otherwise(0)).alias("me"),
        F.sum("shown_unread").alias("new_count"), F.sum(F.when(~F.col("is_me"), F.col("n")).otherwise(0)).alias("_sent"))
    faces = persons.filter(F.col("avatar_src").isNotNull()).select(F.col("id").alias("sender_person_id"), "avatar_src")
    candidate = F.when(F.col("avatar_src").isNotNull() & (F.col("_sent") > 0), F.struct("_sent", -F.col("sender_person_id")))
    counts = by_sender.join(faces, "sender_person_id", "left").groupBy("chat_id").agg(
        *[F.sum(c).alias(c) for c in ("total", "me", "new_count")], F.max_by("avatar_src", candidate).alias("chat_avatar"))
    return counts.join(kept.bounds.select("chat_id", "first", "last"), "chat_id", "left").withColumn("them", F.col("total") - F.col("me"))


def media_stats(kept: Kept) -> DataFrame:
    """``overview.media_stats`` from the kept tables."""
    columns = []
    for kind in MEDIA_KINDS:
        here = F.col("kind") == kind
        for name, condition, value in ((f"{kind}_me", here & F.col("is_me"), "n"), (f"{kind}_them", here & ~F.col("is_me"), "n"), (f"{kind}_bytes", here, "bytes")):
            columns.append(F.sum(F.when(condition, F.col(value)).otherwise(0)).alias(name))
    return kept.files.groupBy("chat_id").agg(*columns, F.sum("bytes").alias("bytes_total"))


def day_counts(kept: Kept) -> DataFrame:
    """``overview.day_counts`` in UTC."""
    return kept.cells.groupBy("chat_id", "day").agg(F.sum("shown").alias("n")).filter("n > 0")


def update_counts(kept: Kept) -> DataFrame:
    """``overview.update_counts``."""
    unread = kept.cells.groupBy("chat_id").agg(F.sum("unread").alias("new")).filter("new > 0")
    return unread.join(kept.bounds.select("chat_id", F.col("last_new").alias("last")), "chat_id")
