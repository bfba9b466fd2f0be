"""Joins of the maintenance jobs: what is new, what changed, what a set of chats uses alone.

No side is broadcast by hint: Spark broadcasts a side it estimates below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.model import APPLE_LIVE_PREFIX

ANCHOR = ["source", "external_id"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over as many tasks as ``spark.sql.shuffle.partitions`` says.

    An aggregate with nearly as many groups as rows gains nothing ahead of its shuffle, but holds all groups of a scan task, and
    Spark merges what it shuffles on its own into few tasks. Here a task's share stays small as the input and that setting grow.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def media_of_messages(media: DataFrame, messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Media with the message they belong to and the slug of its chat."""
    owners = messages.select(F.col("id").alias("message_id"), "chat_id", "ts", "is_me", "media_status")
    slugs = chats.select(F.col("id").alias("chat_id"), "slug")
    return media.join(owners, "message_id").join(slugs, "chat_id")


def with_live_anchor(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Messages with the external id of their live Apple anchor, NULL for other messages."""
    live = refs.filter(F.col("source").startswith(APPLE_LIVE_PREFIX)).select(
        F.col("message_id").alias("id"), F.col("external_id").alias("apple_rowid"))
    return messages.join(live, "id", "left")


def unseen(canonical: DataFrame, refs: DataFrame) -> DataFrame:
    """Canonical rows without an anchor in the archive."""
    return canonical.join(refs.select(*ANCHOR), ANCHOR, "left_anti")


def once_per_anchor(canonical: DataFrame, prefer: str = "external_id") -> DataFrame:
    """One row per anchor where a run delivers an id twice; the lowest ``prefer`` stays, among equals the lowest row.

    Rows without an external id have no anchor and all stay.
    """
    rest = [c for c in canonical.columns if c not in ANCHOR]
    named = canonical.filter(F.col("external_id").isNotNull())
    kept = named.groupBy(*ANCHOR).agg(F.min(F.struct(F.col(prefer).alias("_first"), F.struct(*rest).alias("_row"))).alias("_kept"))
    one = kept.select(*ANCHOR, "_kept._row.*").select(*canonical.columns)
    return one.unionByName(canonical.filter(F.col("external_id").isNull()))


def changed(canonical: DataFrame, stored: DataFrame, fields: tuple[str, ...] = ("text", "retracted", "edits")) -> DataFrame:
    """Canonical rows whose stored version differs in one of the fields (NULL equals NULL)."""
    before = stored.select("id", *ANCHOR, *[F.col(f).alias(f"_old_{f}") for f in fields])
    differs = None
    for field in fields:
        one = ~F.col(field).eqNullSafe(F.col(f"_old_{field}"))
        differs = one if differs is None else differs | one
    return canonical.join(before, ANCHOR).filter(differs).drop(*[f"_old_{f}" for f in fields])


def used_only_by(media: DataFrame, messages: DataFrame, chat_ids: DataFrame, key: str = "src") -> DataFrame:
    """Values of ``key`` (file path or content hash) used by the given chats, with ``exclusive``.

    One pass: uses are counted per (value, message) before they meet the messages, and a file that very
    many messages share ends in a partial aggregate instead of a join of all its uses. Uses are dealt for each
    of both steps, so that no task holds more groups than its share.
    """
    chosen = chat_ids.select("chat_id").distinct().withColumn("_in", F.lit(True))
    owners = messages.select(F.col("id").alias("message_id"), "chat_id").join(chosen, "chat_id", "left")
    uses = dealt(media.filter(F.col(key).isNotNull()).select("message_id", key, "bytes"), "message_id", key).groupBy(
        "message_id", key).agg(F.max("bytes").alias("bytes"))
    inside = F.coalesce("_in", F.lit(False))
    return (
        dealt(uses, "message_id").join(owners.select("message_id", "_in"), "message_id", "left")
        .groupBy(key).agg(F.bool_or(inside).alias("_used"), F.bool_and(inside).alias("exclusive"),
                          F.max("bytes").alias("bytes"))
        .filter("_used").drop("_used")
    )
