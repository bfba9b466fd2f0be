"""Vendor rows to canonical messages, as joins and expressions over whole stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.decode import attributed_text, edit_history
from parlance.functions.labels import balloon_label, is_tapback_add, is_tapback_remove
from parlance.functions.text import choose, clean_text, empty_to_null
from parlance.functions.times import whatsapp_seconds
from parlance.model import ATTACHMENT, CANONICAL_COLUMNS, EDIT, REACTION
from parlance.operators import drift, reactions
from parlance.sources import contracts, stores

NO_APPS = "array<string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


# --- Apple ------------------------------------------------------------------------------------------


def apple_rows(store: dict[str, DataFrame], me_name: str) -> DataFrame:
    """Message rows that show something: no reactions, a date, and text, files or an app label.

    The text is cleaned and, where its column is empty, decoded; ``error`` names a misshapen edit blob.
    The decoders see a blob only where it is needed and NULL elsewhere, after all rows that can be told
    without them are gone; the other columns stay in the JVM, and the store is scanned once.
    """
    kind = F.col("associated_message_type")
    rows = stores.apple_messages(store).filter(~is_tapback_add(kind) & ~is_tapback_remove(kind) & F.col("ts").isNotNull())
    rows = rows.withColumn("_clean", clean_text(F.col("text"))).drop("text")
    rows = rows.withColumn("_blob", F.when((F.col("_clean") == "") & (kind == 0), F.col("attributedBody"))).drop("attributedBody")
    rows = rows.withColumn("_decoded", attributed_text("_blob")).drop("_blob")
    has_files = F.coalesce("cache_has_attachments", F.lit(0)) != 0
    rows = rows.withColumns({
        "body": F.when(F.col("_clean") == "", F.coalesce("_decoded", F.lit(""))).otherwise(F.col("_clean")), "has_files": has_files,
    }).drop("_clean", "_decoded")
    rows = rows.withColumn("label", F.when((F.col("body") == "") & ~F.col("has_files"), balloon_label(F.col("balloon_bundle_id"))))
    shown = rows.filter((F.col("body") != "") | F.col("has_files") | F.col("label").isNotNull())
    history = shown.withColumn("_history", edit_history("message_summary_info")).drop("message_summary_info")
    return history.withColumns({
        "edits": F.coalesce("_history.edits", _none(EDIT)), "error": F.col("_history.error"), "sender": _apple_sender(me_name),
    }).drop("_history")


def _apple_sender(me_name: str) -> Column:
    return F.when(F.col("is_from_me") != 0, F.lit(me_name)).otherwise(F.coalesce("sender_handle", F.lit("")))


def apple_canonical(store: dict[str, DataFrame], source: str | Column | dict[str, str], me_name: str) -> DataFrame:
    """Canonical rows of all chats, with reactions folded onto their targets."""
    # Reactions need neither text nor blobs: their own scan reads narrow columns of the reaction rows only.
    scan = stores.apple_messages(store).withColumn("sender", _apple_sender(me_name))
    folded = reactions.folded_reactions(reactions.tapback_events(scan))
    folded = folded.select(stores.STORE, "chat_id", F.col("target").alias("guid"), "reactions")
    files = stores.attachment_lists(stores.apple_attachments(store))
    rows = apple_rows(store, me_name).filter(F.col("error").isNull())
    return (
        rows.join(folded, [stores.STORE, "chat_id", "guid"], "left").join(files, [stores.STORE, "rowid"], "left")
        .select(
            stores.per_store(source).alias("source"), F.col("chat_id").cast("string").alias("chat_external_id"),
            F.col("rowid").cast("string").alias("external_id"), "ts", F.col("sender").alias("sender_raw"),
            (F.coalesce("is_from_me", F.lit(0)) != 0).alias("is_me"), empty_to_null(F.col("body")).alias("text"),
            (F.coalesce("date_retracted", F.lit(0)) != 0).alias("retracted"), "edits",
            F.coalesce("reactions", _none(REACTION)).cast(f"array<{REACTION}>").alias("reactions"),
            F.when(F.col("label").isNotNull(), F.array("label")).otherwise(F.array().cast(NO_APPS)).alias("apps"),
            F.coalesce(F.when(F.col("has_files"), F.col("attachments")), _none(ATTACHMENT)).alias("attachments"))
        .select(*CANONICAL_COLUMNS)
    )


def apple_failures(store: dict[str, DataFrame], source: str | Column | dict[str, str], me_name: str, seen_at: int) -> DataFrame:
    """Rows whose edit blob has an unexpected shape, as drift events."""
    rows = apple_rows(store, me_name).withColumn("source", stores.per_store(source))
    return drift.parse_failures(rows, contracts.APPLE_VERSION, "message", F.col("error"),
                                F.concat(F.lit("edit history of row "), "rowid"), seen_at)


# --- WhatsApp ---------------------------------------------------------------------------------------


def message_kind(code: Column) -> Column:
    """Kind of a message code; NULL and unknown codes count as text."""
    return choose(F.coalesce(code, F.lit(0)), contracts.MESSAGE_KINDS, "text")


def whatsapp_senders(store: dict[str, DataFrame], me_name: str) -> DataFrame:
    """Messages with their session, kind and the sender by chat type."""
    sessions = stores.whatsapp_sessions(store).select(stores.STORE, F.col("Z_PK").alias("session"), "is_group", "partner")
    members = stores.keyed(store["ZWAGROUPMEMBER"]).select(
        stores.STORE, F.col("Z_PK").alias("group_member"), F.col("ZCHATSESSION").alias("session"),
        empty_to_null(F.col("ZMEMBERJID")).alias("member_jid"))
    from_jid = F.coalesce("from_jid", F.lit(""))
    sender = (
        F.when(F.coalesce("is_from_me", F.lit(0)) != 0, F.lit(me_name))
        .when(F.col("is_group"), F.coalesce("member_jid", from_jid))
        .otherwise(F.coalesce(empty_to_null(F.col("partner")), from_jid))
    )
    return (
        stores.whatsapp_messages(store).join(sessions, [stores.STORE, "session"])
        .join(members, [stores.STORE, "group_member", "session"], "left")
        .withColumns({"sender": sender, "kind": message_kind(F.col("msg_type")), "ts": whatsapp_seconds(F.col("msg_date")),
                      "body": clean_text(F.col("text"))})
    )


def whatsapp_canonical(store: dict[str, DataFrame], source: str | Column | dict[str, str], me_name: str) -> DataFrame:
    """Canonical rows of all sessions."""
    kind = F.col("kind")
    rows = whatsapp_senders(store, me_name).join(stores.whatsapp_media(store), [stores.STORE, "pk"], "left")
    carries_file = kind.isin(*contracts.MIME_BY_KIND, "media")
    path = F.when(carries_file, empty_to_null(F.col("local_path")))
    place = F.when(F.col("lat").isNotNull(), F.format_string("📍 Location (%.5f, %.5f)", "lat", "lon")).otherwise(
        contracts.LOCATION_LABEL)
    label = (
        F.when(kind.isin(*contracts.LABEL_BY_KIND) & F.col("media_pk").isNull(), choose(kind, contracts.LABEL_BY_KIND))
        .when(kind == "location", place).when(kind == "contact", contracts.CONTACT_LABEL).when(kind == "call", contracts.CALL_LABEL)
    )
    attachment = F.struct(
        path.alias("source_ref"), F.coalesce(choose(kind, contracts.MIME_BY_KIND), F.lit("")).alias("mime"),
        F.coalesce("media_title", F.lit("")).alias("filename"), (kind == "sticker").alias("is_sticker"),
        F.lit("").alias("emoji_desc")).cast(ATTACHMENT)
    shaped = rows.withColumns({"_path": path, "_label": label, "_attachment": attachment, "_deleted": kind == "deleted"})
    kept = shaped.filter(
        F.col("ts").isNotNull()
        & (F.col("_deleted") | (F.col("body") != "") | F.col("_path").isNotNull() | F.col("_label").isNotNull()))
    stanza = F.coalesce(empty_to_null(F.col("stanza_id")), F.col("pk").cast("string"))
    return kept.select(
        stores.per_store(source).alias("source"), F.col("session").cast("string").alias("chat_external_id"), stanza.alias("external_id"),
        "ts", F.col("sender").alias("sender_raw"), (F.coalesce("is_from_me", F.lit(0)) != 0).alias("is_me"),
        empty_to_null(F.col("body")).alias("text"), F.col("_deleted").alias("retracted"), _none(EDIT).alias("edits"),
        _none(REACTION).alias("reactions"),
        F.when(F.col("_label").isNotNull(), F.array("_label")).otherwise(F.array().cast(NO_APPS)).alias("apps"),
        F.when(F.col("_path").isNotNull(), F.array("_attachment")).otherwise(_none(ATTACHMENT)).alias("attachments"),
    ).select(*CANONICAL_COLUMNS)


def whatsapp_failures(store: dict[str, DataFrame], source: str | Column | dict[str, str], seen_at: int) -> DataFrame:
    """Messages without a time, as drift events."""
    rows = stores.whatsapp_messages(store).withColumn("source", stores.per_store(source))
    return drift.parse_failures(
        rows, contracts.WHATSAPP_VERSION, "ZWAMESSAGE", F.when(F.col("msg_date").isNull(), "NULL"),
        F.concat(F.lit("message "), "pk", F.lit(" has no time")), seen_at, column="ZMESSAGEDATE")


def misfit_events(store: dict[str, DataFrame], source: str | Column | dict[str, str], version: int, seen_at: int) -> DataFrame:
    """Values the source could not read as their column's type, as drift events, one per kind of misfit and table."""
    rows = stores.misfits(store).groupBy(stores.STORE, "table_name", "misfit").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("source", stores.per_store(source)).withColumnRenamed("table_name", "_table")
    events = drift.parse_failures(rows, version, "", F.col("misfit"), F.concat(F.col("n").cast("string"), F.lit(" rows of "), "_table"), seen_at)
    return events.withColumn("table_name", F.substring_index("detail", " ", -1))


def enum_events(store: dict[str, DataFrame], source: str | Column | dict[str, str], version: int, enums: dict, seen_at: int) -> DataFrame:
    """Unknown values of every enumerated column of a store."""
    out = None
    for (table, column), allowed in enums.items():
        found = drift.unknown_values(stores.keyed(store[table]), stores.per_store(source), version, table, column, allowed, seen_at)
        out = found if out is None else out.unionByName(found)
    return out


def counts_by_chat(canonical: DataFrame, chats: DataFrame, min_messages: int = 10) -> DataFrame:
    """Discovery: messages per source chat, at least ``min_messages``, busiest first."""
    counts = canonical.groupBy(F.col("chat_external_id").alias("source_id")).agg(F.count(F.lit(1)).alias("total"))
    return (
        chats.join(counts, "source_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
        .filter(F.col("total") >= min_messages).orderBy(F.desc("total"), "source_id")
    )
