"""Aggregates and windows over the archive (A-*, W-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import drift, kept, overview, reactions, timeline
from parlance.plans import given
from parlance.plans.reading import DRIFT_STORE_SQL, ITEMS_SQL
from parlance.plans.registry import query

DAY_SQL = "cast(DATE '1970-01-01' + cast(floor(ts / 86400.0) AS int) AS date)"

COUNTS_SQL = """
    SELECT chat_id, count(*) AS total, count_if(is_me) AS me, count(*) - count_if(is_me) AS them, min(ts) AS first,
           max(ts) AS last, count_if(sync_state = 'new') AS new_count FROM visible_message GROUP BY 1"""

STATS_SQL = """
    SELECT chat_id, {columns}, sum(bytes)::bigint AS bytes_total FROM (
        SELECT m.chat_id, m.is_me, md.bytes,
               CASE WHEN md.kind IN ('image', 'video', 'audio', 'other') THEN md.kind ELSE 'other' END AS kind
        FROM media md JOIN message m ON m.id = md.message_id WHERE md.src IS NOT NULL) GROUP BY 1
""".format(columns=", ".join(
    f"count_if(kind = '{k}' AND is_me) AS {k}_me, count_if(kind = '{k}' AND NOT is_me) AS {k}_them, "
    f"coalesce(sum(bytes) FILTER (kind = '{k}'), 0)::bigint AS {k}_bytes" for k in ("image", "video", "audio", "other")))

AVATAR_SQL = """
    SELECT chat_id, avatar_src AS chat_avatar FROM (
        SELECT m.chat_id, p.avatar_src,
               row_number() OVER (PARTITION BY m.chat_id ORDER BY count(*) DESC, p.id) AS rn
        FROM message m JOIN person p ON p.id = m.sender_person_id JOIN chat c ON c.id = m.chat_id
        WHERE NOT m.is_me AND p.avatar_src IS NOT NULL AND NOT c.is_group
        GROUP BY m.chat_id, p.id, p.avatar_src) WHERE rn = 1"""

LIVE_SQL = """c.device_id IN (SELECT id FROM device WHERE type = 'mac_live')
    AND c.id IN (SELECT chat_id FROM chat_source WHERE source LIKE 'imessage_live:%')"""

OVERVIEW_COLUMNS = ["total", "me", "them", "new_count", *overview.MEDIA_COLUMNS]
OVERVIEW_SQL = f"""
    SELECT c.id AS chat_id, c.slug, c.title, c.is_group, c.origin, dv.name AS device, dv.slug AS device_slug,
           coalesce(o.display_name, 'Me') AS me_name, n.first, n.last, a.chat_avatar, {LIVE_SQL} AS live,
           {', '.join(f'coalesce({c}, 0) AS {c}' for c in OVERVIEW_COLUMNS)}, c.device_id
    FROM chat c LEFT JOIN device dv ON dv.id = c.device_id LEFT JOIN person o ON o.id = dv.owner_person_id
    LEFT JOIN ({COUNTS_SQL}) n ON n.chat_id = c.id LEFT JOIN ({STATS_SQL}) s ON s.chat_id = c.id
    LEFT JOIN ({AVATAR_SQL}) a ON a.chat_id = c.id"""


def overview_rows(spark, d):
    return overview.chat_overview(
        given.chat(spark, d), given.message(spark, d), given.media(spark, d), given.device(spark, d),
        given.person(spark, d), given.chat_source(spark, d))


@query("a_01_chat_overview", f"SELECT * EXCLUDE (device_id) FROM ({OVERVIEW_SQL})")
def a_01(spark, d):
    return overview_rows(spark, d).drop("device_id", "subtitle")


@query("a_02_media_stats", STATS_SQL)
def a_02(spark, d):
    return overview.media_stats(given.message(spark, d), given.media(spark, d))


@query("a_03_chat_meta", f"""
    SELECT v.slug, v.title, v.device, v.me_name, v.total, v.me, v.them, v.first, v.last, v.bytes_total, v.chat_avatar,
           p.avatar_src AS owner_avatar
    FROM ({OVERVIEW_SQL}) v JOIN device dv ON dv.id = v.device_id JOIN person p ON p.id = dv.owner_person_id""")
def a_03(spark, d):
    rows = overview.chat_meta(overview_rows(spark, d), given.device(spark, d), given.person(spark, d))
    return rows.select("slug", "title", "device", "me_name", "total", "me", "them", "first", "last", "bytes_total",
                       "chat_avatar", "owner_avatar")


DAYS_SQL = f"SELECT chat_id, {DAY_SQL} AS day, count(*) AS n FROM visible_message GROUP BY 1, 2"


@query("a_04_day_histogram", DAYS_SQL)
def a_04(spark, d):
    return overview.day_counts(given.message(spark, d))


@query("a_05_heatmap", f"""
    WITH days AS ({DAYS_SQL}),
    spans AS (SELECT chat_id, min(day) AS a, max(day) AS b, max(n) AS peak FROM days GROUP BY 1),
    grid AS (SELECT chat_id, peak, cast(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS date) AS day FROM spans),
    filled AS (SELECT g.chat_id, g.day, peak, coalesce(n, 0) AS n FROM grid g LEFT JOIN days USING (chat_id, day))
    SELECT chat_id, day, n, (isodow(day) - 1)::int AS weekday,
           CASE WHEN n = 0 THEN 0 WHEN peak <= 4 THEN least(5, n) WHEN n / peak <= 0.10 THEN 1 WHEN n / peak <= 0.25 THEN 2
                WHEN n / peak <= 0.50 THEN 3 WHEN n / peak <= 0.75 THEN 4 ELSE 5 END::int AS level
    FROM filled""")
def a_05(spark, d):
    return overview.heatmap(overview.day_counts(given.message(spark, d)))


@query("a_06_update_counts", """
    SELECT chat_id, count(*) AS new, max(ts) AS last FROM message WHERE sync_state = 'new' GROUP BY 1""")
def a_06(spark, d):
    return overview.update_counts(given.message(spark, d))


@query("a_07_index_roll_up", f"""
    WITH v AS ({OVERVIEW_SQL})
    SELECT device, 0 AS is_total, count(*) AS chats, sum(total)::bigint AS messages, sum(image_me + image_them)::bigint AS images,
           sum(bytes_total)::bigint AS bytes FROM v GROUP BY device
    UNION ALL SELECT NULL, 1, count(*), sum(total)::bigint, sum(image_me + image_them)::bigint, sum(bytes_total)::bigint FROM v""")
def a_07(spark, d):
    return overview.overview_totals(overview_rows(spark, d))


@query("a_08_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}"
    for t in ("person", "handle", "device", "chat", "message", "media")))
def a_08(spark, d):
    return overview.table_counts({t: getattr(given, t)(spark, d)
                                  for t in ("person", "handle", "device", "chat", "message", "media")})


@query("a_09_media_by_kind", "SELECT kind, count(*) AS n FROM media GROUP BY 1")
def a_09(spark, d):
    return overview.media_by_kind(given.media(spark, d))


@query("a_10_chat_list", """
    SELECT c.slug, c.title, c.origin, dv.slug AS device, count(m.id) AS messages
    FROM chat c JOIN device dv ON dv.id = c.device_id LEFT JOIN message m ON m.chat_id = c.id GROUP BY ALL""")
def a_10(spark, d):
    return overview.chat_list(given.chat(spark, d), given.message(spark, d), given.device(spark, d))


@query("a_11_device_list", """
    SELECT dv.slug, dv.name, dv.type, p.display_name AS owner, count(c.id) AS chats
    FROM device dv LEFT JOIN person p ON p.id = dv.owner_person_id LEFT JOIN chat c ON c.device_id = dv.id GROUP BY ALL""")
def a_11(spark, d):
    return overview.device_list(given.device(spark, d), given.chat(spark, d), given.person(spark, d))


@query("a_12_person_list", """
    SELECT p.id, p.display_name AS name, (SELECT count(*) FROM handle h WHERE h.person_id = p.id) AS handles,
           (SELECT count(*) FROM person_alias a WHERE a.person_id = p.id) AS aliases, p.avatar_src IS NOT NULL AS has_avatar
    FROM person p""")
def a_12(spark, d):
    return overview.person_list(given.person(spark, d), given.handle(spark, d), given.person_alias(spark, d))


@query("a_15_sender_facets", f"""
    WITH items AS ({ITEMS_SQL}), n AS (SELECT chat_id, kind, sender, count(*) AS n FROM items GROUP BY 1, 2, 3)
    SELECT * FROM n WHERE (chat_id, kind) IN (SELECT (chat_id, kind) FROM n GROUP BY chat_id, kind HAVING count(*) >= 2)""")
def a_15(spark, d):
    return overview_facets(spark, d)


def overview_facets(spark, d):
    return timeline.sender_facets(
        timeline.media_timeline(given.message(spark, d), given.media(spark, d), given.person(spark, d)))


def reaction_events(spark, d):
    """Reactions from clicks (added) and errors (taken back), aimed at the user's first message."""
    e, kind = F.col("event_id"), F.col("event_type")
    rows = given.table(spark, d, "events").filter(kind.isin("click", "error"))
    return rows.select(
        F.col("user_id").alias("chat_id"),
        (F.when(kind == "click", 2000).otherwise(3000) + e % 6).alias("associated_message_type"),
        F.concat(F.lit("p:0/"), "user_id").alias("associated_message_guid"),
        F.concat(F.lit("s"), e % 9).alias("sender"), given.event_seconds().alias("ts"),
        given.event_seconds().alias("date"), e.alias("rowid"))


EMOJI_SQL = """CASE {t} WHEN 2000 THEN '❤️' WHEN 2001 THEN '👍' WHEN 2002 THEN '👎' WHEN 2003 THEN '😂'
    WHEN 2004 THEN '‼️' ELSE '❓' END"""
LABEL_SQL = """CASE {t} WHEN 2000 THEN 'loved' WHEN 2001 THEN 'liked' WHEN 2002 THEN 'disliked' WHEN 2003 THEN 'laughed at'
    WHEN 2004 THEN 'emphasized' ELSE 'questioned' END"""
FOLD_SQL = f"""
    SELECT chat_id, target, tapback, sender, ts, {EMOJI_SQL.format(t='tapback')} AS emoji, {LABEL_SQL.format(t='tapback')} AS label
    FROM (SELECT user_id AS chat_id, user_id::varchar AS target, (2000 + event_id % 6)::int AS tapback,
                 's' || (event_id % 9) AS sender, cast(floor(epoch(ts)) AS bigint) AS ts, event_type = 'click' AS added,
                 row_number() OVER (PARTITION BY user_id, event_id % 6 {{more}}
                                    ORDER BY cast(floor(epoch(ts)) AS bigint) DESC, event_id DESC) AS rn
          FROM events WHERE event_type IN ('click', 'error'))
    WHERE rn = 1 AND added"""


@query("a_16_reaction_chips", f"""
    SELECT chat_id, string_agg(emoji, '' ORDER BY first_at) AS chips FROM (
        SELECT chat_id, emoji, min(tapback) AS first_at FROM ({FOLD_SQL.format(more='')}) GROUP BY 1, 2) GROUP BY 1""")
def a_16(spark, d):
    folded = reactions.folded_reactions(reactions.tapback_events(reaction_events(spark, d)))
    return overview.reaction_chips(folded).select(
        "chat_id", F.array_join(F.col("chips.emoji"), "").alias("chips"))


@query("a_17_participants", """
    SELECT chat_id, sender_person_id AS person_id FROM message
    UNION SELECT c.id, dv.owner_person_id FROM chat c JOIN device dv ON dv.id = c.device_id""")
def a_17(spark, d):
    return overview.participants(given.message(spark, d), given.chat(spark, d), given.device(spark, d))


@query("a_18_drift_roll_up", f"""
    SELECT source, sum(occurrence_count)::bigint AS occurrences, count_if(severity = 'fatal') AS fatal,
           count_if(severity = 'warn') AS warn, 0::bigint AS info, count(*) AS pending, bool_or(severity = 'fatal') AS is_fatal
    FROM ({DRIFT_STORE_SQL}) GROUP BY 1""")
def a_18(spark, d):
    return drift.roll_up(drift.upsert(None, given.drift_event_in(spark, d)))


@query("a_19_processing_summary", """
    SELECT 'audio' AS kind, count(*) AS total, count(t.src) AS done, count(*) - count(t.src) AS open,
           count_if(coalesce(t.text, '') <> '') AS with_text, 0::bigint AS screenshots, count(t.error) AS errors
    FROM (SELECT DISTINCT src FROM media WHERE kind = 'audio' AND src IS NOT NULL) f LEFT JOIN transcript t ON t.src = f.src
    UNION ALL
    SELECT 'image', count(*), count(o.src), count(*) - count(o.src), count_if(coalesce(o.text, '') <> ''),
           count_if(coalesce(o.is_screenshot, false)), count(o.error)
    FROM (SELECT DISTINCT src FROM media WHERE kind = 'image' AND src IS NOT NULL) f LEFT JOIN ocr o ON o.src = f.src""")
def a_19(spark, d):
    return overview.recognition_summary(given.media(spark, d), given.transcript(spark, d), given.ocr(spark, d))


@query("w_02_counterpart_avatar", AVATAR_SQL)
def w_02(spark, d):
    return overview.counterpart_avatars(given.message(spark, d), given.chat(spark, d), given.person(spark, d))


@query("w_05_neighbour_days", f"""
    SELECT chat_id, day, n, lag(day) OVER w AS prev_day, lead(day) OVER w AS next_day FROM ({DAYS_SQL})
    WINDOW w AS (PARTITION BY chat_id ORDER BY day)""")
def w_05(spark, d):
    return overview.neighbour_days(overview.day_counts(given.message(spark, d)))


@query("c_11_tapback_fold", FOLD_SQL.format(more=""))
def c_11(spark, d):
    return reactions.live_reactions(reactions.tapback_events(reaction_events(spark, d)))


@query("c_11b_tapback_fold_per_sender", FOLD_SQL.format(more=", event_id % 9"))
def c_11b(spark, d):
    return reactions.live_reactions(reactions.tapback_events(reaction_events(spark, d)), per_sender=True)


# --- kept aggregates -----------------------------------------------------------------------------------


def kept_after_changes(spark, d):
    """Eight messages in ten to start with; then the rest comes in, chats are read, and chats are purged."""
    messages, media = given.message(spark, d), given.media(spark, d)
    known, arrived = F.col("id") % 10 < 8, F.col("id") % 10 >= 8
    none = kept.owned(media, messages).limit(0)
    state = kept.start(messages.filter(known), media.join(messages.filter(known).select(F.col("id").alias("message_id")), "message_id", "left_semi")).stored()
    fresh = messages.filter(arrived)
    state = kept.after(state, fresh, messages.limit(0), messages, kept.owned(media, fresh), none).stored()
    hit = (F.col("chat_id") % 7 == 3) & (F.col("sync_state") == "new")
    read = messages.withColumn("sync_state", F.when(F.col("chat_id") % 7 == 3, "published").otherwise(F.col("sync_state")))
    state = kept.after(state, messages.filter(hit).withColumn("sync_state", F.lit("published")), messages.filter(hit), read, none, none).stored()
    gone = read.filter(F.col("chat_id") % 7 == 5)
    return kept.after(state, messages.limit(0), gone, read.filter(F.col("chat_id") % 7 != 5), none, kept.owned(media, gone)).stored()


KEPT_SQL = """
    WITH m AS (SELECT id, chat_id, is_me, ts, media_status IN ('ready', 'none') AS shown, sync_state = 'new' AND chat_id % 7 <> 3 AS unread
               FROM message WHERE chat_id % 7 <> 5)"""


@query("a_01b_kept_activity", KEPT_SQL + """
    SELECT chat_id, count_if(shown) AS total, count_if(shown AND is_me) AS me, count_if(shown AND NOT is_me) AS them, count_if(shown AND unread) AS new_count,
           min(ts) FILTER (WHERE shown) AS first, max(ts) FILTER (WHERE shown) AS last FROM m GROUP BY 1""")
def a_01b(spark, d):
    return kept.activity(kept_after_changes(spark, d), given.person(spark, d)).drop("chat_avatar")


@query("a_02b_kept_media", KEPT_SQL + """
    SELECT m.chat_id, CASE WHEN md.kind IN ('image', 'video', 'audio') THEN md.kind ELSE 'other' END AS kind, m.is_me, count(*) AS n, sum(coalesce(md.bytes, 0))::bigint AS bytes
    FROM media md JOIN m ON m.id = md.message_id WHERE md.src IS NOT NULL GROUP BY ALL""")
def a_02b(spark, d):
    return kept_after_changes(spark, d).files


@query("a_04b_kept_days", KEPT_SQL + """
    SELECT chat_id, cast(DATE '1970-01-01' + cast(floor(ts / 86400.0) AS int) AS date) AS day, count(*) AS n FROM m WHERE shown GROUP BY 1, 2""")
def a_04b(spark, d):
    return kept.day_counts(kept_after_changes(spark, d))


@query("a_06b_kept_updates", KEPT_SQL + "SELECT chat_id, count(*) AS new, max(ts) AS last FROM m WHERE unread GROUP BY 1")
def a_06b(spark, d):
    return kept.update_counts(kept_after_changes(spark, d))
