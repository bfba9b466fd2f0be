"""Vendor message stores as DataFrames with a fixed set of columns.

A store is read through ``sqlite_ro`` (or any DataFrame reader). Columns a version of the store lacks
become typed NULLs, so that every later step sees one schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import empty_to_null, strip
from parlance.functions.times import apple_seconds
from parlance.model import ATTACHMENT, schema
from parlance.sources import sqlite_ro
from parlance.sources.contracts import DIRECT_STYLE, GROUP_SESSION

APPLE_SCHEMAS = {
    "message": "ROWID bigint, guid string, text string, attributedBody binary, handle_id bigint, date bigint, "
               "is_from_me bigint, cache_has_attachments bigint, associated_message_type bigint, "
               "associated_message_guid string, balloon_bundle_id string, message_summary_info binary, "
               "date_edited bigint, date_retracted bigint",
    "chat": "ROWID bigint, chat_identifier string, service_name string, display_name string, style bigint",
    "handle": "ROWID bigint, id string",
    "attachment": "ROWID bigint, filename string, mime_type string, transfer_name string, is_sticker bigint, "
                  "uti string, emoji_image_short_description string",
    "chat_message_join": "chat_id bigint, message_id bigint",
    "message_attachment_join": "message_id bigint, attachment_id bigint",
}
WHATSAPP_SCHEMAS = {
    "ZWAMESSAGE": "Z_PK bigint, ZSTANZAID string, ZMESSAGEDATE double, ZTEXT string, ZFROMJID string, "
                  "ZISFROMME bigint, ZMESSAGETYPE bigint, ZCHATSESSION bigint, ZGROUPMEMBER bigint, "
                  "ZGROUPEVENTTYPE bigint",
    "ZWACHATSESSION": "Z_PK bigint, ZSESSIONTYPE bigint, ZCONTACTJID string, ZPARTNERNAME string",
    "ZWAMEDIAITEM": "Z_PK bigint, ZMESSAGE bigint, ZMEDIALOCALPATH string, ZTITLE string, ZVCARDSTRING string, "
                    "ZVCARDNAME string, ZLATITUDE double, ZLONGITUDE double, ZMOVIEDURATION bigint",
    "ZWAGROUPMEMBER": "Z_PK bigint, ZCHATSESSION bigint, ZMEMBERJID string",
}
# Fixed value: app payloads that are no attachments.
PAYLOAD_SUFFIX = "pluginPayloadAttachment"


STORE = "store"


def read_store(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """All tables of a store from its SQLite file or files.

    Row ids are unique in one file only, so the rows of a pattern or a list of files carry their file; ``_corrupt`` names
    values that did not fit.
    """
    sqlite_ro.register(spark)
    extra = f", {sqlite_ro.CORRUPT_COLUMN} string" + (f", {sqlite_ro.FILE_COLUMN} string" if set(path) & set("*?[,") else "")
    return {
        table: spark.read.format(sqlite_ro.FORMAT).schema(schema(ddl + extra)).option("path", path).option("table", table).load()
        for table, ddl in schemas.items()
    }


def keyed(df: DataFrame) -> DataFrame:
    """Rows with ``store``, the file they come from; all rows of tables without files are one store."""
    if STORE in df.columns:
        return df
    file = F.coalesce(F.col(sqlite_ro.FILE_COLUMN), F.lit("")) if sqlite_ro.FILE_COLUMN in df.columns else F.lit("")
    return df.withColumn(STORE, file).drop(sqlite_ro.FILE_COLUMN, sqlite_ro.CORRUPT_COLUMN)


def store_tag(store: Column | None = None) -> Column:
    """Short mark of a file's path."""
    return F.substring(F.md5((F.col(STORE) if store is None else store).cast("binary")), 1, 8)


def per_store(name: str | Column | dict[str, str]) -> Column:
    """A source or device per store: a name for all rows, a column, or names by file.

    A plain name stands for one device. Rows of files are then told apart by a mark of their file.
    """
    if isinstance(name, Column):
        return name
    if isinstance(name, dict):
        pairs = [F.lit(x) for pair in name.items() for x in pair]
        return F.element_at(F.create_map(*pairs), F.col(STORE))
    return F.when(F.col(STORE) == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name}/"), store_tag()))


def misfits(store: dict[str, DataFrame]) -> DataFrame:
    """(store, table_name, misfit) of rows with values that do not fit their column, from all tables."""
    out = None
    for name, df in store.items():
        if sqlite_ro.CORRUPT_COLUMN in df.columns:
            bad = df.filter(F.col(sqlite_ro.CORRUPT_COLUMN).isNotNull())
            file = F.col(sqlite_ro.FILE_COLUMN) if sqlite_ro.FILE_COLUMN in df.columns else F.lit("")
            rows = bad.select(file.alias(STORE), F.lit(name).alias("table_name"), F.col(sqlite_ro.CORRUPT_COLUMN).alias("misfit"))
            out = rows if out is None else out.unionByName(rows)
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the wanted columns, missing ones as NULL."""
    present = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f.name) if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema(ddl)
    ])


def conform_store(tables: dict[str, DataFrame], schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: conform(tables[name], ddl) for name, ddl in schemas.items()}


# --- Apple ------------------------------------------------------------------------------------------


def apple_chats(store: dict[str, DataFrame], device: str | Column | dict[str, str], source: str | Column | dict[str, str] | None = None) -> DataFrame:
    """Chat specs: first non-empty of display name, identifier and ``chat_<rowid>``; with ``source`` where it is given."""
    slug = F.concat(per_store(device), F.lit("/chat_"), "ROWID")
    name = F.coalesce(empty_to_null(F.col("display_name")), empty_to_null(F.col("chat_identifier")),
                      F.concat(F.lit("chat_"), "ROWID"))
    return keyed(store["chat"]).select(
        *_named(source), slug.alias("slug"), name.alias("title"), F.col("ROWID").cast("string").alias("source_id"),
        F.col("chat_identifier").alias("subtitle"),
        (F.coalesce("style", F.lit(0)) != DIRECT_STYLE).alias("is_group"), F.lit("apple").alias("origin"))


def apple_messages(store: dict[str, DataFrame]) -> DataFrame:
    """Every message row of every chat, with its sender handle and Unix second."""
    links = keyed(store["chat_message_join"]).select(STORE, F.col("message_id").alias("ROWID"), "chat_id")
    handles = keyed(store["handle"]).select(STORE, F.col("ROWID").alias("handle_id"), F.col("id").alias("sender_handle"))
    return (
        keyed(store["message"]).join(links, [STORE, "ROWID"]).join(handles, [STORE, "handle_id"], "left")
        .withColumnRenamed("ROWID", "rowid").withColumn("ts", apple_seconds(F.col("date")))
        .withColumn("associated_message_type", F.coalesce("associated_message_type", F.lit(0)))
    )


def apple_attachments(store: dict[str, DataFrame]) -> DataFrame:
    """Attachment rows of messages without app payloads, missing texts as ''."""
    files = keyed(store["attachment"]).withColumnRenamed("ROWID", "attachment_id")
    payload = F.coalesce(F.col("transfer_name").endswith(PAYLOAD_SUFFIX), F.lit(False))

    def text(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    return keyed(store["message_attachment_join"]).join(files, [STORE, "attachment_id"]).filter(~payload).select(
        STORE, F.col("message_id").alias("rowid"), "attachment_id", text("filename").alias("source_ref"),
        text("mime_type").alias("mime"), text("transfer_name").alias("filename"),
        (F.coalesce("is_sticker", F.lit(0)) != 0).alias("is_sticker"),
        text("emoji_image_short_description").alias("emoji_desc"), text("uti").alias("uti"))


def attachment_lists(attachments: DataFrame) -> DataFrame:
    """One array per message, in attachment order."""
    record = F.struct("attachment_id", F.struct("source_ref", "mime", "filename", "is_sticker", "emoji_desc")
                      .cast(ATTACHMENT).alias("a"))
    return attachments.groupBy(STORE, "rowid").agg(
        F.transform(F.array_sort(F.collect_list(record)), lambda x: x["a"]).alias("attachments"))


# --- WhatsApp ---------------------------------------------------------------------------------------


def whatsapp_sessions(store: dict[str, DataFrame]) -> DataFrame:
    """Sessions with ``is_group`` and the one identity of a direct chat's partner.

    A direct chat may carry its partner under a phone address first and another id later; a proper name,
    else the session's own address, stands for both.
    """
    partner = empty_to_null(strip(F.coalesce("ZPARTNERNAME", F.lit(""))))
    group = F.coalesce(F.col("ZSESSIONTYPE") == GROUP_SESSION, F.lit(False))
    one = F.when(group, F.lit(None)).when(~partner.contains("@"), partner).otherwise(empty_to_null(F.col("ZCONTACTJID")))
    return keyed(store["ZWACHATSESSION"]).withColumns({"is_group": group, "partner": one})


def whatsapp_chats(store: dict[str, DataFrame], device: str | Column | dict[str, str], source: str | Column | dict[str, str] | None = None) -> DataFrame:
    fallback = F.concat(F.lit("chat_"), "Z_PK")
    jid = empty_to_null(F.col("ZCONTACTJID"))
    return whatsapp_sessions(store).select(
        *_named(source), F.concat(per_store(device), F.lit("/"), fallback).alias("slug"),
        F.coalesce(empty_to_null(F.col("ZPARTNERNAME")), jid, fallback).alias("title"),
        F.col("Z_PK").cast("string").alias("source_id"), jid.alias("subtitle"), "is_group",
        F.lit("whatsapp").alias("origin"))


def whatsapp_media(store: dict[str, DataFrame]) -> DataFrame:
    """At most one media row per message, the one with the lowest key."""
    fields = ["Z_PK", "ZMEDIALOCALPATH", "ZTITLE", "ZLATITUDE", "ZLONGITUDE", "ZVCARDSTRING", "ZVCARDNAME", "ZMOVIEDURATION"]
    return keyed(store["ZWAMEDIAITEM"]).filter(F.col("ZMESSAGE").isNotNull()).groupBy(STORE, "ZMESSAGE").agg(
        F.min(F.struct(*fields)).alias("_m")).select(
        STORE, F.col("ZMESSAGE").alias("pk"), F.col("_m.Z_PK").alias("media_pk"), F.col("_m.ZMEDIALOCALPATH").alias("local_path"),
        F.col("_m.ZTITLE").alias("media_title"), F.col("_m.ZLATITUDE").alias("lat"), F.col("_m.ZLONGITUDE").alias("lon"))


def whatsapp_messages(store: dict[str, DataFrame]) -> DataFrame:
    return keyed(store["ZWAMESSAGE"]).select(
        STORE, F.col("Z_PK").alias("pk"), F.col("ZSTANZAID").alias("stanza_id"), F.col("ZMESSAGEDATE").alias("msg_date"),
        F.col("ZTEXT").alias("text"), F.col("ZFROMJID").alias("from_jid"), F.col("ZISFROMME").alias("is_from_me"),
        F.col("ZMESSAGETYPE").alias("msg_type"), F.col("ZCHATSESSION").alias("session"),
        F.col("ZGROUPMEMBER").alias("group_member"), F.col("ZGROUPEVENTTYPE").alias("group_event_type"))


def _named(source: str | Column | dict[str, str] | None) -> list[Column]:
    return [] if source is None else [per_store(source).alias("source")]
