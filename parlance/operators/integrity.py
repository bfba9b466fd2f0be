"""Consistency of the stored archive: origins against anchors, and references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPLE_PREFIX = "imessage"
# Child table, column and parent table of every reference.
REFERENCES = [
    ("handle", "person_id", "person"), ("person_alias", "person_id", "person"), ("device", "owner_person_id", "person"),
    ("chat", "device_id", "device"), ("chat_source", "chat_id", "chat"), ("chat_participant", "chat_id", "chat"),
    ("chat_participant", "person_id", "person"), ("message", "chat_id", "chat"), ("message", "sender_person_id", "person"),
    ("source_ref", "message_id", "message"), ("media", "message_id", "message"),
]


def origin_violations(chats: DataFrame, chat_sources: DataFrame, messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Per chat and source: anchors that do not belong to the chat's service."""
    origins = chats.select(F.col("id").alias("chat_id"), "slug", "origin")
    apple = F.col("source").startswith(APPLE_PREFIX)
    wrong_for_whatsapp = (F.col("origin") == "whatsapp") & apple
    wrong_for_apple = (F.col("origin") == "apple") & ~apple
    anchored = chat_sources.groupBy("chat_id", "source").agg(F.count(F.lit(1)).alias("n")).join(origins, "chat_id")
    # Only Apple anchors can be wrong on messages, and they are counted per chat before meeting the chats.
    owners = messages.select(F.col("id").alias("message_id"), "chat_id")
    referenced = refs.filter(apple).join(owners, "message_id").groupBy("chat_id", "source").agg(
        F.count(F.lit(1)).alias("n")).join(origins, "chat_id")

    def violations(rows: DataFrame, check: str) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), "slug", "source", "n")

    return (
        violations(anchored.filter(wrong_for_whatsapp), "whatsapp chat with apple anchor")
        .unionByName(violations(referenced.filter(wrong_for_whatsapp), "whatsapp message with apple anchor"))
        .unionByName(violations(anchored.filter(wrong_for_apple), "apple chat with other anchor"))
    )


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References without a target: child, column, value and number of rows.

    Values are counted first, so a missing parent of very many rows is one row in the anti join.
    """
    out = None
    for child, column, parent in REFERENCES:
        if child not in tables or parent not in tables:
            continue
        values = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
            F.count(F.lit(1)).alias("n"))
        lost = values.join(tables[parent].select(F.col("id").alias("value")), "value", "left_anti")
        rows = lost.select(F.lit(child).alias("child"), F.lit(column).alias("column_name"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
