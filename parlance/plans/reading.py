"""Projections, filters, pages and day groups (P-*, L-*, W-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import contains_ci
from parlance.operators import drift, overview, text_index, timeline
from parlance.plans import given
from parlance.plans.registry import query
from parlance.session import new_folder

MOMENT = 1705000000
PAGE = """
    SELECT id, chat_id, ts, is_me, text, {extra} FROM (
        SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts {dir}, id {dir}) AS rn,
               count(*) OVER (PARTITION BY chat_id) AS n
        FROM visible_message WHERE {where}) WHERE rn <= {limit}"""


def page_columns(df, *more):
    return df.select("id", "chat_id", "ts", "is_me", "text", *more)


@query("p_01_visible_filter", "SELECT id, chat_id, ts, media_status FROM visible_message")
def p_01(spark, d):
    return timeline.visible(given.message(spark, d)).select("id", "chat_id", "ts", "media_status")


@query("p_02_message_render", """
    SELECT m.id, m.chat_id, m.ts, m.is_me, coalesce(p.display_name, '?') AS sender, p.avatar_src AS sender_avatar,
           m.text, m.retracted, coalesce(m.n_edits, 0) AS n_edits, coalesce(m.app, '') AS apps,
           coalesce(x.missing, 0) AS missing_media, md.kind, md.src, md.cat, md.portrait
    FROM visible_message m LEFT JOIN person p ON p.id = m.sender_person_id
    LEFT JOIN (SELECT message_id, count(*) AS missing FROM media WHERE src IS NULL GROUP BY 1) x ON x.message_id = m.id
    LEFT JOIN (SELECT * FROM media WHERE src IS NOT NULL) md ON md.message_id = m.id""")
def p_02(spark, d):
    rows = timeline.render_rows(given.message(spark, d, text=True), given.person(spark, d), given.media(spark, d))
    return rows.select(
        "id", "chat_id", "ts", "is_me", "sender", "sender_avatar", "text", "retracted",
        F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"), F.array_join("apps", "|").alias("apps"),
        "missing_media", "kind", "src", "cat", "portrait")


@query("p_03_edited_messages", """
    SELECT m.id, m.chat_id, m.ts, n_edits, t.total, n_edits > 1 AS changed,
           CASE WHEN n_edits = 2 THEN 'draft ' ELSE 'final ' END || m.id AS first_text
    FROM visible_message m JOIN (SELECT chat_id, count(*) AS total FROM visible_message
        WHERE n_edits IS NOT NULL GROUP BY 1) t USING (chat_id) WHERE n_edits IS NOT NULL""")
def p_03(spark, d):
    messages = given.message(spark, d)
    return timeline.edited(messages).join(timeline.edited_totals(messages), "chat_id").select(
        "id", "chat_id", "ts", F.size("edits").alias("n_edits"), "total", (F.size("edits") > 1).alias("changed"),
        F.col("edits")[0]["text"].alias("first_text"))


@query("p_04_chat_filter", """
    SELECT slug, title FROM chat
    WHERE contains(lower(title), 'omer#00000001') OR contains(lower('c' || id || '@s.whatsapp.net'), 'c7')""")
def p_04(spark, d):
    jid = F.concat(F.lit("c"), "id", F.lit("@s.whatsapp.net"))
    chats = given.chat(spark, d)
    return chats.filter(contains_ci(F.col("title"), "Omer#00000001") | contains_ci(jid, "C7")).select("slug", "title")


def _items(spark, d):
    timeline_rows = timeline.media_timeline(given.message(spark, d), given.media(spark, d), given.person(spark, d))
    return timeline.with_recognition(timeline_rows, given.transcript(spark, d), given.ocr(spark, d))


ITEMS_SQL = """
    SELECT md.id AS media_id, md.src, md.kind, md.cat, m.chat_id, m.ts, m.id AS message_id,
           coalesce(p.display_name, '?') AS sender, nullif(trim(t.text), '') AS transcript,
           nullif(trim(o.text), '') AS image_text, coalesce(o.is_screenshot, false) AS is_screenshot
    FROM media md JOIN visible_message m ON m.id = md.message_id LEFT JOIN person p ON p.id = m.sender_person_id
    LEFT JOIN transcript t ON t.src = md.src LEFT JOIN ocr o ON o.src = md.src WHERE md.src IS NOT NULL"""


@query("p_05_media_filters", f"""
    WITH items AS ({ITEMS_SQL})
    SELECT 'photos' AS tab, media_id, src, sender FROM items WHERE kind = 'image' AND coalesce(cat, 'foto') = 'foto'
    UNION ALL SELECT 'stickers', media_id, src, sender FROM items WHERE kind = 'image' AND cat IN ('sticker', 'emoji')
    UNION ALL SELECT 'screenshots', media_id, src, sender FROM items
        WHERE kind = 'image' AND coalesce(cat, 'foto') = 'foto' AND is_screenshot
    UNION ALL SELECT 'video of one', media_id, src, sender FROM items
        WHERE kind = 'video' AND sender = 'Customer#000000007'""")
def p_05(spark, d):
    items = _items(spark, d)
    tabs = {
        "photos": timeline.filter_media(items, "image"),
        "stickers": timeline.filter_media(items, "image", ("sticker", "emoji")),
        "screenshots": timeline.filter_media(items, "image", screenshots_only=True),
        "video of one": timeline.filter_media(items, "video", sender="Customer#000000007"),
    }
    out = None
    for tab, rows in tabs.items():
        rows = rows.select(F.lit(tab).alias("tab"), "media_id", "src", "sender")
        out = rows if out is None else out.unionByName(rows)
    return out


DRIFT_STORE_SQL = """
    SELECT source, kind, table_name, column_name, observed, first_seen, last_seen, occurrence_count,
           latest.severity AS severity, latest.schema_version AS schema_version, latest.detail AS detail
    FROM (
        SELECT source, kind, coalesce(table_name, '') AS table_name, coalesce(column_name, '') AS column_name,
               coalesce(observed, '') AS observed, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
               count(*) AS occurrence_count,
               max({'seen_at': seen_at, 'detail': detail, 'severity': severity, 'schema_version': schema_version}) AS latest
        FROM drift_event_in GROUP BY ALL)"""


@query("p_06_drift_filter", f"""
    SELECT source, kind, table_name, column_name, observed, severity, last_seen
    FROM ({DRIFT_STORE_SQL}) WHERE source <> 'whatsapp_live'""")
def p_06(spark, d):
    store = drift.upsert(None, given.drift_event_in(spark, d))
    acked = drift.acknowledge(store, at=1, source="whatsapp_live")
    return drift.list_events(acked).select(
        "source", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("table_name", "column_name", "observed")],
        "severity", "last_seen")


SEARCH_SQL = """
    SELECT m.chat_id, m.id AS message_id, m.ts, 'text' AS found_in, NULL::varchar AS src FROM visible_message m WHERE {text_hit}
    UNION ALL
    SELECT m.chat_id, m.id, m.ts, f.found_in, f.src FROM (SELECT DISTINCT message_id, src FROM media) md
    JOIN (SELECT src, 'transcript' AS found_in FROM transcript WHERE {hit}
          UNION ALL SELECT src, 'image' FROM ocr WHERE {hit}) f ON f.src = md.src
    JOIN visible_message m ON m.id = md.message_id"""


@query("p_07_message_search", """
    SELECT m.chat_id, m.id AS message_id, m.ts, 'text' AS found_in, NULL::varchar AS src
    FROM visible_message m WHERE contains(lower(m.text), 'the thin')
    UNION ALL
    SELECT m.chat_id, m.id, m.ts, f.found_in, f.src FROM (SELECT DISTINCT message_id, src FROM media) md
    JOIN (SELECT src, 'transcript' AS found_in FROM transcript WHERE contains(lower(text), 'the thin')
          UNION ALL SELECT src, 'image' FROM ocr WHERE contains(lower(text), 'the thin')) f ON f.src = md.src
    JOIN visible_message m ON m.id = md.message_id""")
def p_07(spark, d):
    return timeline.search(given.message(spark, d, text=True), given.media(spark, d), given.transcript(spark, d),
                           given.ocr(spark, d), "The thin")


def indexed(spark, d, needle, regex=False):
    """The search by an index of all texts, built in two batches: the second holds every fifth message again and all files."""
    root = new_folder(spark, "index")
    messages, none = given.message(spark, d, text=True), given.transcript(spark, d).limit(0)
    text_index.add_batch(timeline.index_texts(messages, none, none), root, 0)
    text_index.add_batch(timeline.index_texts(messages.filter(F.col("id") % 5 == 0), given.transcript(spark, d), given.ocr(spark, d)), root, 1)
    return timeline.indexed_search(messages, given.media(spark, d), root, needle, regex)


PATTERN = r"the [a-z]*(old|thin|ing) .{1,9}er\b"


@query("p_07b_indexed_search", SEARCH_SQL.format(text_hit="contains(lower(m.text), 'the thin')", hit="contains(lower(text), 'the thin')"))
def p_07b(spark, d):
    return indexed(spark, d, "The thin")


@query("p_07c_indexed_pattern", SEARCH_SQL.format(text_hit=f"regexp_matches(m.text, '(?i){PATTERN}')", hit=f"regexp_matches(text, '(?i){PATTERN}')"))
def p_07c(spark, d):
    return indexed(spark, d, PATTERN, True)


@query("l_01_latest", PAGE.format(extra="n >= 50 AS has_more", dir="DESC", where="true", limit=50))
def l_01(spark, d):
    return page_columns(timeline.latest(given.message(spark, d, text=True)), "has_more")


@query("l_02_before", PAGE.format(extra="n >= 25 AS has_more", dir="DESC", where=f"ts < {MOMENT}", limit=25))
def l_02(spark, d):
    return page_columns(timeline.before(given.message(spark, d, text=True), MOMENT, 25), "has_more")


@query("l_03_since", PAGE.format(extra="sync_state", dir="ASC", where=f"ts > {MOMENT}", limit=500))
def l_03(spark, d):
    return page_columns(timeline.since(given.message(spark, d, text=True), MOMENT), "sync_state")


@query("l_04_around",
       PAGE.format(extra="true AS newer", dir="ASC", where=f"ts >= {MOMENT}", limit=80) + " UNION ALL "
       + PAGE.format(extra="false AS newer", dir="DESC", where=f"ts < {MOMENT}", limit=40))
def l_04(spark, d):
    return page_columns(timeline.around(given.message(spark, d, text=True), MOMENT), (F.col("ts") >= MOMENT).alias("newer"))


@query("l_05_media_timeline", """
    SELECT m.chat_id, m.ts, m.id AS message_id, md.id AS media_id, md.kind, md.src, md.cat, md.portrait, m.is_me,
           coalesce(p.display_name, '?') AS sender, m.text AS caption
    FROM media md JOIN visible_message m ON m.id = md.message_id LEFT JOIN person p ON p.id = m.sender_person_id
    WHERE md.src IS NOT NULL""")
def l_05(spark, d):
    rows = timeline.media_timeline(given.message(spark, d, text=True), given.media(spark, d), given.person(spark, d))
    return rows.orderBy("chat_id", "ts", "message_id", "media_id")


@query("l_06_configured_order", """
    SELECT slug, title, CASE WHEN device_id % 2 = 0 THEN id END AS position FROM chat""")
def l_06(spark, d):
    chats = given.chat(spark, d)
    order = chats.filter(F.col("device_id") % 2 == 0).select("slug", F.col("id").alias("position"))
    return overview.configured_order(chats.select("slug", "title"), order)


@query("l_07_import_first", """
    SELECT chat_external_id, external_id, ts, text FROM (
        SELECT chat_id::varchar AS chat_external_id, id::varchar AS external_id, ts, text,
               row_number() OVER (PARTITION BY chat_id ORDER BY ts, id::varchar) AS rn FROM message) WHERE rn <= 20""")
def l_07(spark, d):
    rows = given.message(spark, d, text=True).select(
        F.lit("given").alias("source"), F.col("chat_id").cast("string").alias("chat_external_id"),
        F.col("id").cast("string").alias("external_id"), "ts", "text")
    return timeline.first_messages(rows, 20).drop("source")


@query("w_01_day_groups", """
    WITH rows AS (
        SELECT m.id, m.chat_id, m.ts, m.is_me, coalesce(p.display_name, '?') AS sender, c.is_group,
               cast(DATE '1970-01-01' + cast(floor(m.ts / 86400.0) AS int) AS date) AS day
        FROM visible_message m JOIN chat c ON c.id = m.chat_id LEFT JOIN person p ON p.id = m.sender_person_id),
    marked AS (
        SELECT *, lag(is_me) OVER w AS prev_me, lag(sender) OVER w AS prev_sender,
               row_number() OVER w AS k, dense_rank() OVER (PARTITION BY chat_id ORDER BY day) AS day_rank
        FROM rows WINDOW w AS (PARTITION BY chat_id, day ORDER BY ts, id))
    SELECT id, chat_id, day, k = 1 AS day_break, CASE WHEN day_rank % 2 = 1 THEN 'a' ELSE 'b' END AS tone,
           is_group AND NOT is_me AND (k = 1 OR prev_me OR prev_sender <> sender) AS sender_header
    FROM marked""")
def w_01(spark, d):
    return timeline.day_groups(given.message(spark, d), given.chat(spark, d), given.person(spark, d)).select(
        "id", "chat_id", "day", "day_break", "tone", "sender_header")
