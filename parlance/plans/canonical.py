"""Canonicalisation queries (C-*) and the store scans they start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import labels, media, text
from parlance.functions.decode import attributed_text, edit_history
from parlance.operators import canonical, export_text
from parlance.plans import given, vendor
from parlance.plans.aggregates import EMOJI_SQL
from parlance.plans.registry import query

BALLOON_SQL = """['🔗 Shared link', '✌️ Digital Touch', '✍️ Handwriting', '💸 Purchase request', '⏱️ Screen Time request',
    '📍 Location shared', '🖼️ Photo shared', '🎵 Music shared', '📲 App message'][bundle + 1]"""
APPLE_SQL = f"""
    WITH fold AS (
        SELECT chat_id, target AS guid, string_agg(emoji || ':' || sender || ':' || coalesce(ts::varchar, ''), '|' ORDER BY type) AS reactions
        FROM (SELECT m.chat_id, m.target, m.ts, amt % 1000 AS type, {EMOJI_SQL.format(t='(2000 + amt % 1000)')} AS emoji, amt < 3000 AS added,
                     CASE WHEN is_me THEN 'Me' ELSE coalesce(h.id, '') END AS sender,
                     row_number() OVER (PARTITION BY m.chat_id, m.target, amt % 1000 ORDER BY m.ts DESC NULLS LAST, m.rowid DESC) AS rn
              FROM apple_message m LEFT JOIN apple_handle h ON h.rowid = m.handle_id WHERE amt >= 2000)
        WHERE rn = 1 AND added GROUP BY 1, 2),
    files AS (SELECT rowid, string_agg(source_ref || ';' || mime || ';' || filename, '|' ORDER BY attachment_id) AS attachments
              FROM apple_attachment GROUP BY 1)
    SELECT m.chat_id::varchar AS chat_external_id, m.rowid::varchar AS external_id, m.ts,
           CASE WHEN is_me THEN 'Me' ELSE coalesce(h.id, '') END AS sender_raw, is_me, nullif(body, '') AS text, retracted,
           coalesce(fold.reactions, '') AS reactions,
           CASE WHEN body = '' AND NOT has_files AND has_bundle THEN {BALLOON_SQL} ELSE '' END AS apps,
           CASE WHEN has_files THEN coalesce(files.attachments, '') ELSE '' END AS attachments
    FROM apple_message m LEFT JOIN apple_handle h ON h.rowid = m.handle_id
    LEFT JOIN fold ON fold.chat_id = m.chat_id AND fold.guid = m.guid LEFT JOIN files ON files.rowid = m.rowid
    WHERE amt < 2000 AND m.ts IS NOT NULL AND (body <> '' OR has_files OR has_bundle)"""


def flat(rows):
    """Canonical rows with their lists as text."""
    return rows.select(
        "chat_external_id", "external_id", "ts", "sender_raw", "is_me", "text", "retracted",
        F.array_join(F.transform("reactions", lambda r: F.concat(
            r["emoji"], F.lit(":"), r["sender"], F.lit(":"), F.coalesce(r["ts"].cast("string"), F.lit("")))), "|").alias("reactions"),
        F.array_join("apps", "|").alias("apps"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(";", a["source_ref"], a["mime"], a["filename"])), "|")
        .alias("attachments"))


@query("c_01_apple_canonical", APPLE_SQL)
def c_01(spark, d):
    return flat(canonical.apple_canonical(vendor.apple_store(spark, d), "imessage_live", "Me"))


WHATSAPP_SQL = """
    SELECT session::varchar AS chat_external_id, external_id, ts, sender AS sender_raw, is_me, nullif(body, '') AS text,
           kind = 'deleted' AS retracted, '' AS reactions, coalesce(label, '') AS apps,
           coalesce(path || ';' || mime || ';' || coalesce(media_title, ''), '') AS attachments
    FROM (
        SELECT m.*, x.media_title,
               CASE WHEN kind IN ('image', 'video', 'audio', 'sticker', 'gif', 'file', 'media') THEN x.local_path END AS path,
               CASE kind WHEN 'image' THEN 'image/jpeg' WHEN 'video' THEN 'video/mp4' WHEN 'audio' THEN 'audio/ogg'
                    WHEN 'sticker' THEN 'image/webp' WHEN 'gif' THEN 'video/mp4' WHEN 'file' THEN 'application/octet-stream' ELSE '' END AS mime,
               CASE WHEN kind = 'location' THEN CASE WHEN x.lat IS NOT NULL
                         THEN printf('📍 Location (%.5f, %.5f)', x.lat, x.lon) ELSE '📍 Location' END
                    WHEN kind = 'contact' THEN '👤 Contact card' WHEN kind = 'call' THEN '📞 Call'
                    WHEN x.media_pk IS NULL THEN CASE kind WHEN 'image' THEN '🖼️ Image' WHEN 'video' THEN '🎬 Video'
                         WHEN 'audio' THEN '🎤 Voice message' WHEN 'sticker' THEN '🃏 Sticker' WHEN 'gif' THEN '🎞️ GIF'
                         WHEN 'file' THEN '📎 Document' END END AS label
        FROM wa_sent m LEFT JOIN wa_media x ON x.pk = m.pk)
    WHERE ts IS NOT NULL AND (kind = 'deleted' OR body <> '' OR path IS NOT NULL OR label IS NOT NULL)"""


@query("c_02_whatsapp_canonical", WHATSAPP_SQL)
def c_02(spark, d):
    return flat(canonical.whatsapp_canonical(vendor.whatsapp_store(spark, d), "whatsapp_live", "Me"))


@query("c_03_whatsapp_sender", "SELECT pk, session, kind, sender FROM wa_sent")
def c_03(spark, d):
    return canonical.whatsapp_senders(vendor.whatsapp_store(spark, d), "Me").select("pk", "session", "kind", "sender")


@query("c_04_export_assembly", """
    SELECT folder, ts, role AS sender, body FROM turn_row""")
def c_04(spark, d):
    parsed = export_text.parse_lines(vendor.export_lines(vendor.turns(spark, d), formats=1))
    return export_text.assemble(parsed, 100000).select("folder", "ts", "sender", "body")


@query("c_05_export_formats", """
    SELECT folder, ts, role AS sender,
           ['bracket_dd_mm_yy_24h', 'bracket_mdy_12h', 'bracket_dmy_24h_slash', 'nobracket_mdy_12h_dash'][conv_id % 4 + 1] AS header
    FROM turn_row""")
def c_05(spark, d):
    parsed = export_text.parse_lines(vendor.export_lines(vendor.turns(spark, d)))
    return parsed.filter(F.col("header").isNotNull()).select("folder", "ts", "sender", "header")


@query("c_06_export_classification", """
    SELECT folder, ts, role = 'user' AS is_me, k % 11 = 0 AS retracted,
           CASE WHEN k % 11 = 0 OR k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN NULL WHEN k % 13 = 0 THEN nullif(body, '')
                WHEN k % 7 = 0 THEN NULL ELSE nullif(body, '') END AS text,
           CASE WHEN k % 11 <> 0 AND k % 17 = 0 THEN 'Missed voice call' ELSE '' END AS apps,
           CASE WHEN k % 11 = 0 OR k % 17 = 0 THEN '' WHEN k % 13 = 0 THEN '00' || k || '-PHOTO.jpg;image/jpeg|n' || k || '.opus;audio/ogg'
                WHEN k % 7 = 0 THEN '00' || k || '-PHOTO.webp;image/webp' ELSE '' END AS attachments
    FROM turn_row WHERE NOT (k % 19 = 0 AND k % 11 <> 0 AND k % 17 <> 0)""")
def c_06(spark, d):
    rows = export_text.canonical(vendor.export_lines(vendor.turns(spark, d, marked=True)), "user")
    return rows.select(
        F.col("chat_external_id").alias("folder"), "ts", "is_me", "retracted", "text", F.array_join("apps", "|").alias("apps"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(";", a["source_ref"], a["mime"])), "|").alias("attachments"))


@query("c_07_text_clean", "SELECT doc_id, body FROM tidy_document")
def c_07(spark, d):
    dirty = F.concat(F.lit(" ￼"), "text", F.lit("� \n"))
    return given.table(spark, d, "documents").select("doc_id", text.clean_text(dirty).alias("body"))


@query("c_08_attributed_body", "SELECT doc_id, body FROM tidy_document")
def c_08(spark, d):
    docs = given.table(spark, d, "documents").select("doc_id", vendor.typed_stream(F.col("text")).alias("blob"))
    return docs.select("doc_id", attributed_text("blob").alias("body"))


def edit_blobs(spark, d):
    """Edit blobs of version pairs: three versions with a repeated one, every tenth conversation broken."""
    at = 1709251200 + F.col("conv_id") * 3600
    pick = [F.struct(F.col(c).alias("text"), (at + k).alias("ts")) for k, c in enumerate(["old", "old", "new"])]
    pairs = vendor.version_pairs(spark, d)
    return pairs.select("conv_id", "turn", vendor.edit_plist(F.array(*pick), F.col("conv_id") % 10 == 0).alias("blob"))


EDITS_SQL = """
    WITH tidy AS (
        SELECT conv_id, turn, regexp_replace(old, '^\\s+|\\s+$', '', 'g') AS old, regexp_replace(new, '^\\s+|\\s+$', '', 'g') AS new,
               1709251200 + conv_id * 3600 AS base FROM version_pair)"""


@query("c_09_edit_history", EDITS_SQL + """
    SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 OR old = new OR old = '' OR new = '' THEN NULL ELSE old END AS first_text,
           CASE WHEN conv_id % 10 = 0 OR old = new OR old = '' OR new = '' THEN NULL ELSE new END AS last_text,
           CASE WHEN conv_id % 10 = 0 OR old = new OR old = '' OR new = '' THEN NULL ELSE base || ',' || (base + 2) END AS times,
           CASE WHEN conv_id % 10 = 0 THEN 'TypeError' END AS error FROM tidy""")
def c_09(spark, d):
    rows = edit_blobs(spark, d).withColumn("h", edit_history("blob"))
    edits = F.col("h.edits")
    return rows.select(
        "conv_id", "turn", F.get(edits, F.lit(0))["text"].alias("first_text"), F.try_element_at(edits, F.lit(-1))["text"].alias("last_text"),
        F.when(F.size(edits) > 0, F.array_join(edits["ts"].cast("array<string>"), ",")).alias("times"), F.col("h.error").alias("error"))


@query("c_10_balloon_label", f"SELECT rowid, CASE WHEN has_bundle THEN {BALLOON_SQL} END AS label FROM apple_message")
def c_10(spark, d):
    rows = vendor.apple_store(spark, d)["message"]
    return rows.select(F.col("ROWID").alias("rowid"), labels.balloon_label(F.col("balloon_bundle_id")).alias("label"))


EXT_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey % 5 AS m,
           CASE l_suppkey % 5 WHEN 0 THEN 'image/HEIC' WHEN 1 THEN 'video/quicktime' WHEN 2 THEN 'audio/amr' ELSE '' END AS mime,
           CASE l_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.mov' WHEN 2 THEN '.caf' ELSE '' END AS name_ext,
           CASE l_partkey % 3 WHEN 0 THEN '.GIF' WHEN 1 THEN '' ELSE '.pdf' END AS file_ext
    FROM lineitem"""
KIND_SQL = """CASE WHEN mime LIKE 'image/%' OR lower(ext) IN ('.png', '.gif', '.heic') THEN 'image'
    WHEN mime LIKE 'video/%' OR lower(ext) IN ('.mov') THEN 'video' WHEN mime LIKE 'audio/%' OR lower(ext) IN ('.caf') THEN 'audio' ELSE 'other' END"""
CLASSIFIED_SQL = f"""
    SELECT *, {KIND_SQL} AS kind FROM (
        SELECT *, CASE m WHEN 0 THEN '.heic' WHEN 1 THEN '.mov' WHEN 2 THEN '.amr'
                  ELSE coalesce(nullif(name_ext, ''), nullif(file_ext, ''), '.bin') END AS ext FROM ({EXT_SQL}))"""


def files(spark, d):
    """One vendor attachment per line item."""
    p, m = F.col("l_partkey"), F.col("l_suppkey") % 5
    rows = given.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", p.alias("p"),
        F.when(m == 0, "image/HEIC").when(m == 1, "video/quicktime").when(m == 2, "audio/amr").alias("mime"),
        F.concat(F.lit("IMG.v2_"), p, F.when(p % 4 == 0, ".PNG").when(p % 4 == 1, ".mov").when(p % 4 == 2, ".caf").otherwise("")).alias("name0"),
        F.concat(F.lit("/data.d/"), p, F.when(p % 3 == 0, ".GIF").when(p % 3 == 1, "").otherwise(".pdf")).alias("source"))
    rows = rows.withColumn("name", F.when(F.col("p") % 4 == 3, F.lit(".hidden")).otherwise(F.col("name0")))
    ext = media.media_extension(F.col("mime"), F.col("name"), F.col("source"))
    rows = rows.withColumn("ext", ext)
    return rows.withColumn("kind", media.media_kind(F.col("mime"), F.col("ext")))


@query("c_12_media_classification", f"SELECT l_orderkey, l_linenumber, p, ext, kind FROM ({CLASSIFIED_SQL})")
def c_12(spark, d):
    return files(spark, d).select(
        "l_orderkey", "l_linenumber", "p", "ext", "kind")


@query("c_13_media_category", f"""
    SELECT l_orderkey, l_linenumber, p,
           CASE WHEN kind = 'image' THEN CASE WHEN p % 11 = 0 THEN 'emoji' WHEN p % 7 = 0 THEN 'sticker' ELSE 'foto' END END AS cat,
           CASE p % 4 WHEN 0 THEN CASE WHEN p % 8 = 0 THEN 'sticker' ELSE 'foto' END END AS export_cat
    FROM ({CLASSIFIED_SQL})""")
def c_13(spark, d):
    p = F.col("p")
    exported = F.concat(F.lit("00"), p, F.when(p % 8 == 0, "-STICKER.png").when(p % 4 == 0, "-PHOTO.png").otherwise("-AUDIO.opus"))
    return files(spark, d).select(
        "l_orderkey", "l_linenumber", "p",
        media.media_category(F.col("kind"), p % 7 == 0, F.when(p % 11 == 0, "Emojis")).alias("cat"),
        media.export_media_category(exported).alias("export_cat"))


@query("c_14_content_path", f"""
    WITH hashed AS (
        SELECT *, substr(sha256('file ' || p), 1, 16) AS h,
               CASE kind WHEN 'audio' THEN '.m4a' WHEN 'video' THEN '.mp4' WHEN 'image' THEN
                    CASE WHEN p % 7 = 0 OR lower(ext) = '.png' THEN '.png' WHEN lower(ext) = '.gif' THEN '.gif' ELSE '.jpg' END
                    ELSE ext END AS web_ext
        FROM ({CLASSIFIED_SQL}))
    SELECT l_orderkey, l_linenumber, p, 'media/' || CASE kind WHEN 'image' THEN 'images' WHEN 'video' THEN 'videos' WHEN 'audio' THEN 'audio'
           ELSE 'files' END || '/' || substr(h, 1, 2) || '/' || h || lower(web_ext) AS path,
           'originals/' || substr(h, 1, 2) || '/' || h || lower(ext) AS original FROM hashed""")
def c_14(spark, d):
    digest = media.content_hash(F.encode(F.concat(F.lit("file "), "p"), "UTF-8"))
    rows = files(spark, d).withColumn("h", digest)
    web = media.web_extension(F.col("kind"), F.col("ext"), F.col("p") % 7 == 0)
    return rows.select("l_orderkey", "l_linenumber", "p", media.web_path(F.col("kind"), F.col("h"), web).alias("path"),
                       media.original_path(F.col("h"), F.col("ext")).alias("original"))


@query("c_15_handle_norm", """
    SELECT c_custkey, '+49170' || lpad(c_custkey::varchar, 7, '0') AS phone, 'c ' || c_custkey || '-x@example.org' AS mail, 'no digits - here' AS word
    FROM customer""")
def c_15(spark, d):
    k = F.col("c_custkey")
    return given.table(spark, d, "customer").select(
        k, text.norm_handle(F.concat(F.lit(" "), given.spaced_handle(k), F.lit(" "))).alias("phone"),
        text.norm_handle(F.concat(F.lit("C "), k, F.lit("-X@Example.org"))).alias("mail"),
        text.norm_handle(F.lit("No digits - here ")).alias("word"))


@query("c_16_name_norm", """
    SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS name FROM documents""")
def c_16(spark, d):
    return given.table(spark, d, "documents").select("doc_id", text.norm_name(F.concat(F.lit("  "), "text", F.lit(" \t"))).alias("name"))


@query("a_13_source_discovery", f"""
    SELECT s.session::varchar AS source_id, count(x.external_id) AS total, s.is_group,
           coalesce(s.partner_name, s.jid, 'chat_' || s.session) AS title
    FROM wa_session s JOIN ({WHATSAPP_SQL}) x ON x.chat_external_id = s.session::varchar GROUP BY ALL HAVING count(*) >= 10""")
def a_13(spark, d):
    from parlance.sources import stores

    store = vendor.whatsapp_store(spark, d)
    rows = canonical.whatsapp_canonical(store, "whatsapp_live", "Me")
    return canonical.counts_by_chat(rows, stores.whatsapp_chats(store, "dev")).select("source_id", "total", "is_group", "title")


@query("w_03_consecutive_versions", EDITS_SQL + """
    SELECT conv_id, turn, (1 + (old <> new)::int)::bigint AS versions FROM tidy""")
def w_03(spark, d):
    """Consecutive duplicates in an exploded history, by comparing each version with the one before."""
    from pyspark.sql.window import Window

    strip = text.strip
    pairs = vendor.version_pairs(spark, d)
    versions = pairs.select("conv_id", "turn", F.posexplode(F.array("old", "old", "new")).alias("k", "t"))
    before = F.lag(strip(F.col("t"))).over(Window.partitionBy("conv_id", "turn").orderBy("k"))
    kept = versions.withColumn("b", before).filter(F.col("b").isNull() | (F.col("b") != strip(F.col("t"))))
    return kept.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("versions"))
