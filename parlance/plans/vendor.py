"""Vendor-shaped stores and export lines as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.times import VENDOR_EPOCH
from parlance.plans import given
from parlance.sources.stores import APPLE_SCHEMAS, WHATSAPP_SCHEMAS, conform_store

BASE_TIME = "TIMESTAMP_NTZ'2024-03-01 00:00:00'"
BUNDLES = ["com.apple.messages.URLBalloonProvider", "com.apple.DigitalTouchBalloonProvider", "x.Handwriting",
           "x.AskToBuy", "x.ScreenTime", "x.FindMyApp", "x.PhotosMessagesApp", "x.Music", "x.Unknown"]


def event_text(e: Column) -> Column:
    return F.coalesce("text", F.concat(F.lit("event "), e))


def _events_with_text(spark: SparkSession, d: str) -> DataFrame:
    docs = given.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return given.table(spark, d, "events").join(docs, "event_id", "left")


def typed_stream(text: Column) -> Column:
    """A typed-stream blob around a text, with the length tag its size asks for."""
    body = F.encode(text, "UTF-8")
    n = F.octet_length(text)

    def little(width: int) -> Column:
        digits = F.lpad(F.hex(n), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(width, 0, -1)]))

    length = (
        F.when(n < 128, F.unhex(F.lpad(F.hex(n), 2, "0")))
        .when(n < 65536, F.concat(F.unhex(F.lit("81")), little(2)))
        .otherwise(F.concat(F.unhex(F.lit("82")), little(4)))
    )
    head = F.concat(F.encode(F.lit("streamtyped NSMutableString NSString"), "UTF-8"), F.unhex(F.lit("01948401")),
                    F.encode(F.lit("+"), "UTF-8"))
    return F.concat(head, length, body)


def edit_plist(versions: Column, broken: Column) -> Column:
    """An XML property list with an edit history, or one whose part is no list."""
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    entry = F.transform(versions, lambda v: F.concat(
        F.lit("<dict><key>t</key><string>"), escaped(v["text"]), F.lit("</string><key>d</key><real>"),
        (v["ts"] - VENDOR_EPOCH).cast("string"), F.lit(".5</real></dict>")))
    part = F.when(broken, F.lit("<integer>5</integer>")).otherwise(
        F.concat(F.lit("<array>"), F.array_join(entry, ""), F.lit("</array>")))
    return F.encode(F.concat(F.lit('<?xml version="1.0"?><plist version="1.0"><dict><key>ec</key><dict><key>0</key>'), part,
                             F.lit("</dict></dict></plist>")), "UTF-8")


def apple_store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    text = event_text(e)
    tapback = (
        F.when((kind == "click") & (e % 4 == 0), 2000 + e % 6).when((kind == "error") & (e % 4 == 0), 3000 + e % 6)
        .when(e % 37 == 0, 1000).when(e % 3 != 0, 0))
    message = _events_with_text(spark, d).select(
        e.alias("ROWID"), F.concat(F.lit("U"), u, F.lit("-"), e % 16).alias("guid"),
        F.when(e % 7 != 0, F.when(e % 13 == 0, F.concat(F.lit(" ￼"), text, F.lit("�"))).otherwise(text)).alias("text"),
        F.when(e % 14 == 0, typed_stream(text)).alias("attributedBody"),
        F.when(e % 29 != 0, F.when(u % 5 == 0, u + e % 3).otherwise(u)).alias("handle_id"),
        F.when(e % 101 != 0, (given.event_seconds() - VENDOR_EPOCH) * 1000000000 + 5).alias("date"),
        (e % 2).alias("is_from_me"), F.when(e % 5 == 0, 1).otherwise(0).alias("cache_has_attachments"),
        tapback.alias("associated_message_type"),
        F.when(tapback >= 2000, F.concat(F.lit("p:0/U"), u, F.lit("-"), e * 7 % 16)).alias("associated_message_guid"),
        F.when(e % 9 == 0, F.get(F.array(*[F.lit(b) for b in BUNDLES]), (F.floor(e / 9) % 9).cast("int"))).alias("balloon_bundle_id"),
        F.when((kind == "error") & (e % 10 == 3), 5).otherwise(0).alias("date_retracted"))
    k = F.col("c_custkey")
    customer = given.table(spark, d, "customer")
    p = F.col("p_partkey")
    tables = {
        "message": message,
        "chat": customer.select(
            k.alias("ROWID"), given.compact_handle(k).alias("chat_identifier"), F.lit("iMessage").alias("service_name"),
            F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "").alias("display_name"),
            F.when(k % 5 == 0, 43).when(k % 7 != 0, 45).alias("style")),
        "handle": customer.select(k.alias("ROWID"), given.compact_handle(k).alias("id")),
        "attachment": given.table(spark, d, "part").select(
            p.alias("ROWID"), F.concat(F.lit("~/Library/Messages/Attachments/"), p % 256, F.lit("/"), p, F.lit(".dat")).alias("filename"),
            F.when(p % 4 == 0, "image/jpeg").when(p % 4 == 1, "video/mp4").when(p % 4 == 2, "application/pdf").alias("mime_type"),
            F.when(p % 17 == 0, F.concat(F.lit("x."), F.lit("pluginPayloadAttachment"))).otherwise(
                F.concat(F.lit("IMG_"), p, F.lit(".jpg"))).alias("transfer_name"),
            F.when(p % 7 == 0, 1).otherwise(0).alias("is_sticker"), F.lit("public.data").alias("uti"),
            F.when(p % 11 == 0, "Emojis").alias("emoji_image_short_description")),
        "chat_message_join": given.table(spark, d, "events").select(u.alias("chat_id"), e.alias("message_id")),
        "message_attachment_join": given.table(spark, d, "lineitem").select(
            F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("attachment_id")),
    }
    return conform_store(tables, APPLE_SCHEMAS)


def whatsapp_store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e, u = F.col("event_id"), F.col("user_id")
    codes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 14, 46, 54, 59, 66, 99, 0, 0, 0]
    host = F.when(e % 4 == 0, "@lid").otherwise("@s.whatsapp.net")
    message = _events_with_text(spark, d).select(
        e.alias("Z_PK"), F.when(e % 13 != 0, F.concat(F.lit("ST"), e)).when(e % 2 == 0, "").alias("ZSTANZAID"),
        F.when(e % 97 != 0, given.event_seconds() - VENDOR_EPOCH + 0.5).alias("ZMESSAGEDATE"),
        F.when(e % 3 != 0, F.coalesce("text", F.concat(F.lit("event "), e))).alias("ZTEXT"),
        F.when(e % 2 == 0, F.concat(u.cast("string"), host)).alias("ZFROMJID"), (e % 2).alias("ZISFROMME"),
        F.when(e % 31 != 0, F.get(F.array(*[F.lit(c) for c in codes]), (e % 20).cast("int"))).alias("ZMESSAGETYPE"),
        u.alias("ZCHATSESSION"), F.when((u % 5 == 0) & (e % 8 != 0), u * 10 + e % 4).alias("ZGROUPMEMBER"),
        F.when(e % 7 == 0, e % 15).alias("ZGROUPEVENTTYPE"))
    k = F.col("c_custkey")
    customer = given.table(spark, d, "customer")
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey")
    tables = {
        "ZWAMESSAGE": message,
        "ZWACHATSESSION": customer.select(
            k.alias("Z_PK"), F.when(k % 5 == 0, 1).when(k % 23 == 0, 9).otherwise(0).alias("ZSESSIONTYPE"),
            F.when(k % 19 != 0, F.concat(k.cast("string"), F.lit("@s.whatsapp.net"))).alias("ZCONTACTJID"),
            F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("@lid"))).alias("ZPARTNERNAME")),
        "ZWAMEDIAITEM": given.table(spark, d, "lineitem").select(
            (order * 10 + line).alias("Z_PK"), order.alias("ZMESSAGE"),
            F.when(part % 3 != 0, F.concat(F.lit("Media/"), part, F.lit(".bin"))).alias("ZMEDIALOCALPATH"),
            F.when(part % 2 == 0, F.concat(F.lit("title "), part)).alias("ZTITLE"),
            F.when(part % 4 == 0, part / 100.0).alias("ZLATITUDE"), F.when(part % 4 == 0, part / 50.0).alias("ZLONGITUDE")),
        "ZWAGROUPMEMBER": customer.filter(k % 5 == 0).select(
            F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"), k).select(
            (k * 10 + F.col("j")).alias("Z_PK"), k.alias("ZCHATSESSION"),
            F.concat((k + F.col("j")).cast("string"), F.lit("@s.whatsapp.net")).alias("ZMEMBERJID")),
    }
    return conform_store(tables, WHATSAPP_SCHEMAS)


# --- text exports -------------------------------------------------------------------------------------


def turn_time() -> Column:
    """Wall-clock time of a turn: a fixed base, an hour per conversation, a minute per turn."""
    minutes = F.col("conv_id") % 500000 * 60 + F.col("turn")
    return F.timestamp_add("MINUTE", minutes, F.expr(BASE_TIME))


def turns(spark: SparkSession, d: str, marked: bool = False) -> DataFrame:
    """Conversation turns; with ``marked``, some become deleted messages, calls, notices or attachments."""
    rows = given.table(spark, d, "conversations").withColumn("at", turn_time())
    if not marked:
        return rows
    k = F.col("conv_id") * 8 + F.col("turn")
    text = (
        F.when(k % 11 == 0, "This message was deleted.").when(k % 17 == 0, "Missed voice call")
        .when(k % 19 == 0, "Messages and calls are end-to-end encrypted. Tap to learn more.")
        .when(k % 13 == 0, F.concat(F.col("text"), F.lit(" ‎<attached: 00"), k, F.lit("-PHOTO.jpg> <Anhang: n"), k, F.lit(".opus>")))
        .when(k % 7 == 0, F.concat(F.lit("<ATTACHED: 00"), k, F.lit("-PHOTO.webp>")))
        .otherwise(F.col("text")))
    return rows.withColumn("text", text)


def export_lines(rows: DataFrame, formats: int = 4, strange: bool = False) -> DataFrame:
    """Export lines of turns (folder, pos, line), the header format chosen by conversation."""
    at, role = F.col("at"), F.col("role")
    heads = [
        F.concat(F.lit("["), F.date_format(at, "dd.MM.yy, HH:mm:ss"), F.lit("] "), role, F.lit(": ")),
        F.concat(F.lit("["), F.date_format(at, "M/d/yy, h:mm:ss a"), F.lit("] "), role, F.lit(": ")),
        F.concat(F.lit("["), F.date_format(at, "dd/MM/yyyy, HH:mm:ss"), F.lit("] "), role, F.lit(": ")),
        F.concat(F.date_format(at, "M/d/yy, h:mm a"), F.lit(" - "), role, F.lit(": ")),
    ]
    head = heads[0] if formats == 1 else F.get(F.array(*heads), (F.col("conv_id") % 4).cast("int"))
    text = F.col("text")
    if strange:
        head = F.when(F.col("conv_id") % 9 == 0, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm "), role, F.lit(": "))).otherwise(head)
        text = F.when((F.col("conv_id") % 8 == 0) & (F.col("turn") == 0), F.concat(F.lit("<Bilaga: a.jpg> "), text)).otherwise(text)
    return rows.select(
        F.concat(F.lit("conv"), "conv_id").alias("folder"), "turn",
        F.posexplode(F.split(F.concat(head, text), "\n")).alias("k", "line")
    ).select("folder", (F.shiftleft(F.col("turn").cast("bigint"), 32) + F.col("k")).alias("pos"), "line")


def version_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A message version and the one after it: a turn and the next turn of the same role."""
    rows = given.table(spark, d, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("role").alias("role2"), F.col("text").alias("new"))
    return rows.join(later, ["conv_id", "turn"]).filter(F.col("role") == F.col("role2")).select(
        "conv_id", "turn", F.col("text").alias("old"), "new")
