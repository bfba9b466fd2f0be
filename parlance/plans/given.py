"""The archive and vendor tables as projections of the given tables.

Each function takes (spark, folder). All formulas are integer and string arithmetic; ``given_sql``
states the same relations as SQL views for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.times import ntz_seconds
from parlance.model import EDIT


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_seconds() -> Column:
    return ntz_seconds(F.col("ts"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("nation"))


# --- people and devices ---------------------------------------------------------------------------


def person(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.concat(F.lit("media/avatars/"), k % 16, F.lit("/"), k, F.lit(".png"))
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("display_name"), F.when(k % 3 == 0, path).alias("avatar_src"))


def spaced_handle(k: Column) -> Column:
    digits = F.lpad(k.cast("string"), 7, "0")
    return F.concat(F.lit("+49 170-"), F.substring(digits, 1, 3), F.lit(" "), F.substring(digits, 4, 4))


def compact_handle(k: Column) -> Column:
    return F.concat(F.lit("+49170"), F.lpad(k.cast("string"), 7, "0"))


def handle(spark: SparkSession, d: str) -> DataFrame:
    """Normalised handles of three customers in four; some have a second, mail-like one."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").filter(k % 4 != 3)
    values = F.array_compact(F.array(compact_handle(k), F.when(k % 5 == 0, F.concat(F.lit("c"), k, F.lit("@example.org")))))
    return c.select(F.explode(values).alias("value"), k.alias("person_id"))


def person_alias(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").filter(k % 2 == 0).select(
        F.concat(F.lit("ALSO  "), F.upper("c_name")).alias("value"), k.alias("person_id"))


def device(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in ("mac_live", "ios_backup", "iphone_backup", "static")])
    return table(spark, d, "nation").select(
        k.alias("id"), F.concat(F.lit("dev"), k).alias("slug"), F.col("n_name").alias("name"),
        F.get(kinds, (k % 4).cast("int")).alias("type"), k.alias("owner_person_id"))


def chat(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("bigint")
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(users, "c_custkey", "left_semi").select(
        k.alias("id"), F.concat(F.lit("dev"), n, F.lit("/chat_"), k).alias("slug"), n.alias("device_id"),
        F.col("c_name").alias("title"), F.lit(None).cast("string").alias("subtitle"),
        (k % 5 == 0).alias("is_group"), F.when(k % 2 == 0, "apple").otherwise("whatsapp").alias("origin"))


def chat_source(spark: SparkSession, d: str) -> DataFrame:
    """One anchor per chat; every 37th chat carries an anchor of the wrong service on purpose."""
    apple = (F.col("origin") == "apple") != (F.col("id") % 37 == 0)
    tag = F.when(apple, "imessage_live:").otherwise("whatsapp_live:")
    return chat(spark, d).select(
        F.col("id").alias("chat_id"), F.concat(tag, F.lit("dev"), "device_id").alias("source"),
        F.col("id").cast("string").alias("external_id"))


# --- messages and media -----------------------------------------------------------------------------


def with_text(spark: SparkSession, d: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows with the text of their message, by its id. Joined last, texts are not shuffled for other joins."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(key), "text")
    return rows.join(docs, key, "left").withColumn("text", F.when(F.col(key) % 11 != 0, F.col("text")))


def message(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """Messages of all chats; their text only when asked for, so that counts never read documents."""
    e, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, d, "events").join(customers(spark, d), "user_id")
    rows = with_text(spark, d, rows, "event_id") if text else rows.withColumn("text", F.lit(None).cast("string"))
    is_me, ts = e % 2 == 1, event_seconds()
    other = F.when(F.col("user_id") % 5 == 0, F.col("user_id") + e % 3).otherwise(F.col("user_id"))
    draft = F.struct(F.concat(F.lit("draft "), e).alias("text"), (ts - 60).alias("ts"))
    final = F.struct(F.concat(F.lit("final "), e).alias("text"), ts.alias("ts"))
    edits = F.when(e % 34 == 0, F.array(final)).when(e % 17 == 0, F.array(draft, final))
    return rows.select(
        e.alias("id"), F.col("user_id").alias("chat_id"), F.when(is_me, F.col("nation")).otherwise(other).alias("sender_person_id"),
        ts.alias("ts"), is_me.alias("is_me"), "text",
        ((kind == "error") & (e % 10 == 3)).alias("retracted"),
        edits.cast(f"array<{EDIT}>").alias("edits"),
        F.when(e % 23 == 0, F.array(F.lit("📲 App message"))).alias("apps"),
        F.when(kind == "signup", "pending").when(kind == "purchase", "ready").otherwise("none").alias("media_status"),
        F.when(e % 20 == 0, "new").otherwise("published").alias("sync_state"))


def source_tag() -> Column:
    """Source of a message from its chat id and nation."""
    return F.concat(F.when(F.col("chat_id") % 2 == 0, "imessage_live:dev").otherwise("whatsapp_live:dev"), "device_id")


def source_ref(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of all messages (one chat in 41 crosses the service on purpose)."""
    c, e = F.col("user_id"), F.col("event_id")
    apple = (c % 2 == 0) != (c % 41 == 0)
    rows = table(spark, d, "events").join(customers(spark, d), "user_id")
    return rows.select(
        e.alias("message_id"),
        F.concat(F.when(apple, "imessage_live:dev").otherwise("whatsapp_live:dev"), "nation").alias("source"),
        e.cast("string").alias("external_id"))


def media(spark: SparkSession, d: str) -> DataFrame:
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey")
    events = table(spark, d, "events").select(F.col("event_id").alias("l_orderkey"))
    n = part * 7 + line
    step = line % 5
    return table(spark, d, "lineitem").join(events, "l_orderkey", "left_semi").select(
        (order * 10 + line).alias("id"), order.alias("message_id"),
        F.when(step <= 1, "image").when(step == 2, "video").when(step == 3, "audio").otherwise("file").alias("kind"),
        F.when(part % 50 != 0, F.concat(F.lit("media/"), n % 100, F.lit("/"), n)).alias("src"),
        F.when(step <= 1, F.when(part % 7 == 0, "sticker").when(part % 11 == 0, "emoji").when(part % 13 == 0, "photo")
               .otherwise("foto")).alias("cat"),
        (part % 3 == 0).alias("portrait"), F.floor("l_extendedprice").alias("bytes"),
        F.concat(F.lit("h"), n).alias("content_hash"))


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of the audio paths whose number matches a document."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        _document_src().alias("src"), "text", "lang", (k % 100 / 100.0).alias("prob"),
        F.when(k % 53 == 0, "decoder failed").alias("error"))


def ocr(spark: SparkSession, d: str) -> DataFrame:
    """Image text, with a line count and the stored screenshot flag."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        _document_src().alias("src"), F.when(k % 3 != 0, F.col("text")).alias("text"),
        F.size(F.split("text", "\n")).cast("bigint").alias("lines"), (k % 6 == 1).alias("is_screenshot"),
        F.when(k % 59 == 0, "engine failed").alias("error"))


def _document_src() -> Column:
    n = F.col("doc_id") * 9 + 1
    return F.concat(F.lit("media/"), n % 100, F.lit("/"), n)


def drift_event_in(spark: SparkSession, d: str) -> DataFrame:
    """Drift observations: one per event."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    sources = F.array(*[F.lit(x) for x in ("imessage_live", "whatsapp_live", "whatsapp_export")])
    kinds = (
        F.when(kind == "error", "missing_required_column").when(kind == "click", "unknown_enum_value")
        .when(kind == "signup", "new_column").when(kind == "purchase", "missing_optional_column")
        .otherwise("row_parse_failed"))
    return table(spark, d, "events").select(
        F.get(sources, (u % 3).cast("int")).alias("source"), (1 + e % 2).cast("int").alias("schema_version"),
        F.when(kind == "error", "fatal").otherwise("warn").alias("severity"), kinds.alias("kind"),
        F.when(u % 4 != 0, "message").alias("table_name"),
        F.when(u % 4 == 1, F.concat(F.lit("col"), u % 7)).alias("column_name"),
        F.when(e % 5 != 0, F.get_json_object("props", "$.k")).alias("observed"),
        F.lit("contract").alias("expected"), F.concat(F.lit("event "), e).alias("detail"),
        event_seconds().alias("seen_at"))
