"""Joins and set operations (J-*, U-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import joins, overview, timeline
from parlance.plans import given
from parlance.plans.registry import query


def canonical(spark, d, joined=lambda rows: rows, more=()):
    """All messages as an incoming canonical batch; every 50th text differs from the stored one.

    ``joined`` brings in the columns ``more`` ahead of the texts, which are shuffled once that way."""
    e = F.col("id")
    rows = given.message(spark, d).drop("text").join(given.chat(spark, d).select(F.col("id").alias("chat_id"), "device_id"), "chat_id")
    rows = given.with_text(spark, d, joined(rows), "id")
    return rows.withColumn("body", F.coalesce("text", F.concat(F.lit("m"), e))).select(
        given.source_tag().alias("source"), F.col("chat_id").cast("string").alias("chat_external_id"),
        e.cast("string").alias("external_id"), "ts", F.concat(F.lit("s"), "sender_person_id").alias("sender_raw"), "is_me",
        F.concat("body", F.when(e % 50 == 0, " altered").otherwise("")).alias("text"),
        "retracted", "edits", e.alias("event_id"), *more)


def before_edit():
    """The text without the mark of every 50th row."""
    return F.when(F.col("event_id") % 50 == 0, F.expr("left(text, length(text) - length(' altered'))")).otherwise(F.col("text"))


def stored(spark, d):
    """The archive before that batch: eight messages in ten, with their old text."""
    rows = canonical(spark, d).filter(F.col("event_id") % 10 < 8)
    return rows.withColumn("text", before_edit()).withColumnRenamed("event_id", "id")


CANONICAL_SQL = """
    SELECT CASE WHEN m.chat_id % 2 = 0 THEN 'imessage_live:dev' ELSE 'whatsapp_live:dev' END || c.device_id AS source,
           m.chat_id::varchar AS chat_external_id, m.id::varchar AS external_id, m.ts, m.id AS event_id,
           coalesce(m.text, 'm' || m.id) AS body, m.is_me, 's' || m.sender_person_id AS sender_raw, m.retracted, m.chat_id, m.sender_person_id
    FROM message m JOIN chat c ON c.id = m.chat_id"""


@query("j_01_media_messages", """
    SELECT md.id, md.message_id, c.slug, m.ts, md.kind FROM media md
    JOIN message m ON m.id = md.message_id JOIN chat c ON c.id = m.chat_id""")
def j_01(spark, d):
    rows = joins.media_of_messages(given.media(spark, d), given.message(spark, d), given.chat(spark, d))
    return rows.select("id", "message_id", "slug", "ts", "kind")


@query("j_02_left_equi", """
    SELECT m.id, coalesce(p.display_name, '?') AS sender, p.avatar_src AS sender_avatar,
           coalesce(o.display_name, 'Me') AS me_name
    FROM message m JOIN chat c ON c.id = m.chat_id LEFT JOIN person p ON p.id = m.sender_person_id
    LEFT JOIN device dv ON dv.id = c.device_id LEFT JOIN person o ON o.id = dv.owner_person_id""")
def j_02(spark, d):
    people = given.person(spark, d)
    owners = overview.with_owner(given.device(spark, d), people).select(F.col("id").alias("device_id"), "me_name")
    owned = given.chat(spark, d).select(F.col("id").alias("chat_id"), "device_id").join(owners, "device_id", "left")
    rows = timeline.with_sender(given.message(spark, d), people).join(owned, "chat_id")
    return rows.select("id", "sender", "sender_avatar", "me_name")


@query("j_03_live_anchor", """
    SELECT m.id, m.media_status, r.external_id AS apple_rowid FROM message m
    LEFT JOIN source_ref r ON r.message_id = m.id AND r.source LIKE 'imessage_live:%'""")
def j_03(spark, d):
    return joins.with_live_anchor(given.message(spark, d), given.source_ref(spark, d)).select(
        "id", "media_status", "apple_rowid")


@query("j_04_new_rows", f"SELECT source, external_id, ts FROM ({CANONICAL_SQL}) WHERE event_id % 10 >= 8")
def j_04(spark, d):
    return joins.unseen(canonical(spark, d), stored(spark, d)).select("source", "external_id", "ts")


@query("j_05_recognition_to_do", """
    SELECT 'audio' AS kind, src FROM (SELECT DISTINCT src FROM media WHERE kind = 'audio' AND src IS NOT NULL)
    WHERE src NOT IN (SELECT src FROM transcript)
    UNION ALL
    SELECT 'image', src FROM (SELECT DISTINCT src FROM media WHERE kind = 'image' AND src IS NOT NULL
        AND src NOT IN (SELECT src FROM ocr) ORDER BY src LIMIT 100)""")
def j_05(spark, d):
    files = given.media(spark, d)
    audio = overview.to_do(files, given.transcript(spark, d), "audio")
    image = overview.next_to_do(files, given.ocr(spark, d), "image", 100)
    return audio.select(F.lit("audio").alias("kind"), "src").unionByName(image.select(F.lit("image").alias("kind"), "src"))


@query("j_06_live_chats", """
    SELECT id, slug FROM chat WHERE device_id IN (SELECT id FROM device WHERE type = 'mac_live')
    AND id IN (SELECT chat_id FROM chat_source WHERE source LIKE 'imessage_live:%')""")
def j_06(spark, d):
    return overview.live_chats(given.chat(spark, d), given.device(spark, d), given.chat_source(spark, d)).select("id", "slug")


@query("j_07_changed_rows", f"""
    SELECT external_id, body || ' altered' AS text FROM ({CANONICAL_SQL})
    WHERE event_id % 10 < 8 AND event_id % 50 = 0""")
def j_07(spark, d):
    return joins.changed(canonical(spark, d), stored(spark, d)).select("external_id", "text")


@query("j_08_cache_enrichment", """
    SELECT md.id, md.src, nullif(trim(t.text), '') AS transcript, nullif(trim(o.text), '') AS image_text,
           coalesce(o.is_screenshot, false) AS is_screenshot
    FROM media md LEFT JOIN transcript t ON t.src = md.src LEFT JOIN ocr o ON o.src = md.src""")
def j_08(spark, d):
    rows = timeline.with_recognition(given.media(spark, d), given.transcript(spark, d), given.ocr(spark, d))
    return rows.select("id", "src", "transcript", "image_text", "is_screenshot")


EXCLUSIVE_SQL = """
    SELECT {key}, bool_and(coalesce(m.chat_id, -1) % 7 = 3) AS exclusive, max(md.bytes) AS bytes
    FROM media md LEFT JOIN message m ON m.id = md.message_id WHERE md.{key} IS NOT NULL
    GROUP BY 1 HAVING bool_or(coalesce(m.chat_id, -1) % 7 = 3)"""


def chosen_chats(spark, d):
    return given.chat(spark, d).filter(F.col("id") % 7 == 3).select(F.col("id").alias("chat_id"))


@query("j_09_exclusive_files",
       "SELECT 'src' AS what, src AS value, exclusive, bytes FROM (" + EXCLUSIVE_SQL.format(key="src") + ") UNION ALL "
       "SELECT 'hash', content_hash, exclusive, bytes FROM (" + EXCLUSIVE_SQL.format(key="content_hash") + ")")
def j_09(spark, d):
    parts = []
    for what, key in (("src", "src"), ("hash", "content_hash")):
        rows = joins.used_only_by(given.media(spark, d), given.message(spark, d), chosen_chats(spark, d), key)
        parts.append(rows.select(F.lit(what).alias("what"), F.col(key).alias("value"), "exclusive", "bytes"))
    return parts[0].unionByName(parts[1])


@query("u_01_set_difference", """
    SELECT DISTINCT src FROM media WHERE kind = 'image' AND src IS NOT NULL
    EXCEPT SELECT src FROM media WHERE cat = 'sticker'""")
def u_01(spark, d):
    files = given.media(spark, d).filter(F.col("src").isNotNull())
    used = files.filter(F.col("kind") == "image").select("src")
    return used.subtract(files.filter(F.col("cat") == "sticker").select("src"))


@query("u_03_union_of_sources", f"""
    SELECT source, external_id, ts, NULL::varchar AS apps FROM ({CANONICAL_SQL}) WHERE source LIKE 'imessage%'
    UNION ALL SELECT source, external_id, ts, 'wa' FROM ({CANONICAL_SQL}) WHERE source LIKE 'whatsapp%'""")
def u_03(spark, d):
    rows = canonical(spark, d)
    apple = rows.filter(F.col("source").startswith("imessage")).select("source", "external_id", "ts")
    other = rows.filter(F.col("source").startswith("whatsapp")).select("source", "external_id", "ts", F.lit("wa").alias("apps"))
    return apple.unionByName(other, allowMissingColumns=True)
