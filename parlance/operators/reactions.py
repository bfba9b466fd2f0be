"""Folding of reaction events into the reactions a message still carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.labels import (
    TAPBACK_REMOVE, is_tapback_add, is_tapback_remove, tapback_emoji, tapback_label,
)


def target_guid(associated_guid: Column) -> Column:
    """The part after the last slash, NULL when nothing is left."""
    return F.nullif(F.element_at(F.split(associated_guid, "/"), -1), F.lit(""))


def _scope(rows: DataFrame) -> list[str]:
    """Chat ids are unique within one store file."""
    return [c for c in ("store", "chat_id") if c in rows.columns]


def tapback_events(messages: DataFrame) -> DataFrame:
    """Reaction rows of a vendor message scan: (store,) chat_id, target, tapback, added, sender, ts, at, at_id."""
    kind = F.col("associated_message_type")
    add, take = is_tapback_add(kind), is_tapback_remove(kind)
    return (
        messages.filter(add | take)
        .select(*_scope(messages), target_guid(F.col("associated_message_guid")).alias("target"),
                F.when(add, kind).otherwise(kind - TAPBACK_REMOVE).cast("int").alias("tapback"),
                add.alias("added"), "sender", "ts", F.col("date").alias("at"), F.col("rowid").alias("at_id"))
        .filter(F.col("target").isNotNull())
    )


def last_event(events: DataFrame, per_sender: bool = False, keep_order: bool = False) -> DataFrame:
    """State of each (chat, target, type): its last event in (at, at_id) order.

    ``max_by`` combines partial results, so a target with any number of events stays cheap, and the
    outcome does not depend on the order rows arrive in.
    """
    keys = [*_scope(events), "target", "tapback"] + (["sender"] if per_sender else [])
    carried = [c for c in ("added", "sender", "ts", *(("at", "at_id") if keep_order else ())) if c not in keys]
    last = F.max_by(F.struct(*carried), F.struct("at", "at_id"))
    return events.groupBy(*keys).agg(last.alias("_last")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in carried])


def live_reactions(events: DataFrame, per_sender: bool = False) -> DataFrame:
    """Reactions still in place, one row each, with emoji and label."""
    return last_event(events, per_sender).filter("added").drop("added").withColumns(
        {"emoji": tapback_emoji(F.col("tapback")), "label": tapback_label(F.col("tapback"))})


def folded_reactions(events: DataFrame) -> DataFrame:
    """One array per (chat, target) in type order; the six types bound its length."""
    record = F.struct("tapback", F.struct("emoji", "label", "sender", "ts").alias("r"))
    return live_reactions(events).groupBy(*_scope(events), "target").agg(
        F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("reactions"))
