"""Maintenance queries (I-06 ... I-11, A-14, U-02, W-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import contains_ci
from parlance.model import ATTACHMENT, REACTION
from parlance.operators import overview, ranges, upkeep
from parlance.plans import given
from parlance.plans.joins import before_edit, CANONICAL_SQL, canonical, chosen_chats
from parlance.plans.registry import query
from parlance.session import materialise, new_folder


def incoming(spark, d):
    """A canonical batch of all messages: names in several forms, an attachment on every sixth."""
    e = F.col("event_id")
    sent = given.message(spark, d).select("id", F.col("sender_person_id").alias("_sender"))
    people = given.person(spark, d).select(F.col("id").alias("_sender"), "display_name")
    rows = canonical(spark, d, lambda rows: rows.join(sent, "id").join(people, "_sender", "left"), ["display_name"])
    rows = rows.select("event_id", *[c for c in rows.columns if c != "event_id"])
    name = F.when(e % 9 == 4, F.concat(F.lit("Stranger "), e % 30)).when(e % 2 == 0, F.lower("display_name")).otherwise(F.col("display_name"))
    file = F.struct(F.concat(F.lit("p"), e).alias("source_ref"), F.lit("image/png").alias("mime"), F.lit("a.png").alias("filename"),
                    F.lit(False).alias("is_sticker"), F.lit("").alias("emoji_desc")).cast(ATTACHMENT)
    return rows.withColumns({
        "sender_raw": name, "apps": F.array().cast("array<string>"),
        "reactions": F.when(e % 40 == 0, F.array(F.struct(F.lit("❤️").alias("emoji"), F.lit("loved").alias("label"),
                                                           F.lit("x").alias("sender"), F.lit(None).cast("bigint").alias("ts"))))
        .otherwise(F.array()).cast(f"array<{REACTION}>"),
        "attachments": F.when(e % 6 == 0, F.array(file)).otherwise(F.array().cast(f"array<{ATTACHMENT}>")),
    }).drop("display_name")


def archive(spark, d, keep=None):
    """The archive before the batch: chats but every 13th, messages but the last two in ten."""
    chats = given.chat(spark, d).filter(F.col("id") % 13 != 0)
    rows = canonical(spark, d, lambda rows: rows.join(chats.select(F.col("id").alias("chat_id")), "chat_id"), ["chat_id"])
    rows = rows.filter(F.col("event_id") % 10 < 8 if keep is None else keep)
    messages = rows.select(
        F.col("event_id").alias("id"), "chat_id", F.lit(None).cast("bigint").alias("sender_person_id"), "ts", "is_me",
        before_edit().alias("text"), "retracted", "edits", F.array().cast(f"array<{REACTION}>").alias("reactions"),
        F.array().cast("array<string>").alias("apps"), F.lit("none").alias("media_status"), F.lit("published").alias("sync_state"),
        "source", "external_id")
    return {
        "person": given.person(spark, d), "person_alias": given.person_alias(spark, d), "handle": given.handle(spark, d),
        "device": given.device(spark, d), "chat": chats, "message": messages,
        "source_ref": messages.select(F.col("id").alias("message_id"), "source", "external_id"),
        "chat_participant": messages.filter("is_me").select("chat_id", F.lit(0).cast("bigint").alias("person_id")).distinct(),
        "media": given.media(spark, d),
    }


def specs(spark, d):
    return given.chat(spark, d).withColumn("source_id", F.col("id").cast("string"))


STORED_SQL = "SELECT * FROM ({c}) WHERE event_id % 10 < 8 AND chat_id % 13 <> 0".format(c=CANONICAL_SQL)
CHAT_IDS_SQL = """
    SELECT id AS old_id, slug, CASE WHEN id % 13 <> 0 THEN id ELSE (SELECT max(id) FROM chat WHERE id % 13 <> 0)
           + row_number() OVER (PARTITION BY id % 13 = 0 ORDER BY md5(slug)) END AS chat_id, device_id FROM chat"""
NEW_NAMES_SQL = """
    SELECT norm, (SELECT max(id) FROM person) + row_number() OVER (ORDER BY day, md5(norm)) AS person_id
    FROM (SELECT lower(name) AS norm, min(floor(ts / 86400.0)) AS day FROM incoming WHERE NOT is_me AND name LIKE 'Stranger%' GROUP BY 1)"""
INCOMING_SQL = f"""
    SELECT c.*, CASE WHEN event_id % 9 = 4 THEN 'Stranger ' || (event_id % 30) ELSE p.display_name END AS name
    FROM ({CANONICAL_SQL}) c LEFT JOIN person p ON p.id = c.sender_person_id
    WHERE NOT (event_id % 10 < 8 AND chat_id % 13 <> 0)"""
IMPORT_SQL = f"""
    WITH incoming AS ({INCOMING_SQL}), ids AS ({CHAT_IDS_SQL}), names AS ({NEW_NAMES_SQL}),
    filled AS (SELECT DISTINCT source, chat_id FROM ({STORED_SQL}))
    SELECT (SELECT max(event_id) FROM ({STORED_SQL})) + row_number() OVER (ORDER BY md5(i.source || chr(31) || external_id)) AS id,
           ids.chat_id, CASE WHEN i.is_me THEN ids.device_id WHEN names.person_id IS NOT NULL THEN names.person_id ELSE i.sender_person_id END AS sender_person_id,
           i.source, i.external_id, i.ts, CASE WHEN event_id % 6 = 0 THEN 'ready' ELSE 'none' END AS media_status,
           CASE WHEN filled.chat_id IS NULL THEN 'published' ELSE 'new' END AS sync_state
    FROM incoming i JOIN ids ON ids.old_id = i.chat_id LEFT JOIN names ON names.norm = lower(i.name) AND i.name LIKE 'Stranger%' AND NOT i.is_me
    LEFT JOIN filled ON filled.source = i.source AND filled.chat_id = i.chat_id"""


@query("i_06_import_new", IMPORT_SQL)
def i_06(spark, d):
    """Two rows in ten and the chats the archive lacks; a second delivery of each row changes nothing."""
    rows = incoming(spark, d)
    changes = upkeep.import_new(rows.unionByName(rows), specs(spark, d), archive(spark, d), incremental_state=True)
    return changes.added["message"].select("id", "chat_id", "sender_person_id", "source", "external_id", "ts", "media_status", "sync_state")


@query("i_06b_import_stats", f"""
    SELECT count_if(is_new) AS new, count_if(NOT is_new) AS skipped_existing, count_if(is_new AND event_id % 6 = 0) AS media
    FROM (SELECT event_id, NOT (event_id % 10 < 8 AND chat_id % 13 <> 0) AS is_new FROM ({CANONICAL_SQL}))""")
def i_06b(spark, d):
    return upkeep.import_stats(incoming(spark, d), archive(spark, d)["source_ref"])


@query("i_06c_import_twice", "SELECT 0::bigint AS new, count(*) AS skipped_existing, 0::bigint AS media FROM message")
def i_06c(spark, d):
    """New rows of a second import after the first was applied: none."""
    store, rows = archive(spark, d), incoming(spark, d)
    after = upkeep.apply_changes(store, upkeep.import_new(rows, specs(spark, d), store))
    return upkeep.import_stats(rows, after["source_ref"])


DEVICE_OF_SOURCE_SQL = "CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)"


@query("i_06d_gated_import", f"""
    SELECT source, count(*) AS n, 0::bigint AS fatal FROM ({INCOMING_SQL}) WHERE {DEVICE_OF_SOURCE_SQL} % 5 <> 3 GROUP BY 1
    UNION ALL SELECT DISTINCT source, 0, 1 FROM ({CANONICAL_SQL}) WHERE {DEVICE_OF_SOURCE_SQL} % 5 = 3""")
def i_06d(spark, d):
    """Every fifth device has a fatal event: its events are stored, its messages are not."""
    rows = incoming(spark, d)
    device = F.regexp_extract("source", "[0-9]+$", 0).cast("int")
    none = F.lit(None).cast("string")
    events = rows.filter(device % 5 == 3).select("source").distinct().select(
        "source", F.lit(1).alias("schema_version"), F.lit("fatal").alias("severity"), F.lit("missing_table").alias("kind"),
        F.lit("message").alias("table_name"), none.alias("column_name"), none.alias("observed"), none.alias("expected"),
        F.lit("table message is missing").alias("detail"), F.lit(1705000000).cast("bigint").alias("seen_at"))
    changes = upkeep.import_gated(rows, events, specs(spark, d), archive(spark, d), incremental_state=True)
    stored = changes.added["message"].groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("fatal", F.lit(0).cast("bigint"))
    seen = changes.added["drift_event"].filter("severity = 'fatal'").select(
        "source", F.lit(0).cast("bigint").alias("n"), F.col("occurrence_count").cast("bigint").alias("fatal"))
    return stored.unionByName(seen)


@query("i_06e_attachments", f"""
    SELECT source, external_id, 'p' || event_id AS source_ref, 'image/png' AS mime FROM ({INCOMING_SQL}) WHERE event_id % 6 = 0""")
def i_06e(spark, d):
    """Attachments of imported messages wait in a table of their own for their files."""
    added = upkeep.import_new(incoming(spark, d), specs(spark, d), archive(spark, d), media_ready=False).added
    owners = added["message"].filter("media_status = 'pending'").select(F.col("id").alias("message_id"), "source", "external_id")
    return added["attachment"].join(owners, "message_id").select("source", "external_id", "source_ref", "mime")


SYNC_SQL = f"""
    SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN body || ' altered' ELSE body END AS text,
           CASE WHEN event_id % 50 = 0 THEN 'new' ELSE 'published' END AS sync_state,
           CASE WHEN event_id % 40 = 0 THEN '❤️' ELSE '' END AS reactions
    FROM ({STORED_SQL}) WHERE event_id % 50 = 0 OR event_id % 40 = 0"""


def updates(changes):
    return changes.updated["message"].select("id", "text", "sync_state", F.array_join(F.col("reactions.emoji"), "").alias("reactions"))


@query("i_07_sync_updates", SYNC_SQL)
def i_07(spark, d):
    return updates(upkeep.sync(incoming(spark, d), specs(spark, d), archive(spark, d)))


@query("i_07c_sync_by_ranges", SYNC_SQL)
def i_07c(spark, d):
    """The same, where only the ranges whose digests differ are looked at row by row."""
    store, root = archive(spark, d), new_folder(spark, "ranges")
    ranges.start(store["message"], root, {})
    rows = ranges.difference(incoming(spark, d), ranges.read_mark(spark, root)).rows
    return updates(upkeep.sync_rows(materialise(rows.drop(*ranges.EXTRA), "differing"), specs(spark, d), store))


@query("i_07b_sync_report", f"""
    SELECT count_if(NOT (event_id % 10 < 8 AND chat_id % 13 <> 0)) AS new,
           count_if(event_id % 10 < 8 AND chat_id % 13 <> 0 AND event_id % 50 = 0) AS updated FROM ({CANONICAL_SQL})""")
def i_07b(spark, d):
    return upkeep.sync_report(incoming(spark, d), archive(spark, d)["message"])


@query("i_08_replace_import", f"""
    SELECT 'message' AS what, count(*) AS n, sum(event_id)::bigint AS total FROM ({STORED_SQL}) WHERE chat_id % 7 <> 3
    UNION ALL SELECT 'chat', count(*), sum(id)::bigint FROM chat WHERE id % 13 <> 0 AND id % 7 <> 3
    UNION ALL SELECT 'media', count(*), sum(id)::bigint FROM media
        WHERE message_id NOT IN (SELECT event_id FROM ({STORED_SQL}) WHERE chat_id % 7 = 3)""")
def i_08(spark, d):
    slugs = given.chat(spark, d).join(chosen_chats(spark, d).withColumnRenamed("chat_id", "id"), "id", "left_semi").select("slug")
    rest = upkeep.replace_chats(archive(spark, d), slugs)
    out = None
    for what in ("message", "chat", "media"):
        row = rest[what].agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).select(F.lit(what).alias("what"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("i_08b_replaced_attachments", f"""
    SELECT l_orderkey AS message_id, l_linenumber::bigint AS position, 'p' || l_partkey AS source_ref FROM lineitem
    WHERE l_orderkey NOT IN (SELECT event_id FROM ({STORED_SQL}) WHERE chat_id % 7 = 3)""")
def i_08b(spark, d):
    slugs = given.chat(spark, d).join(chosen_chats(spark, d).withColumnRenamed("chat_id", "id"), "id", "left_semi").select("slug")
    rest = upkeep.replace_chats({**archive(spark, d), "attachment": pending_attachments(spark, d)}, slugs)
    return rest["attachment"].select("message_id", "position", "source_ref")


@query("i_08c_ids_after_replacement", f"""
    WITH stored AS ({STORED_SQL})
    SELECT event_id::varchar AS external_id, (SELECT max(event_id) FROM stored) + row_number() OVER (ORDER BY md5(source || chr(31) || external_id)) AS id
    FROM ({CANONICAL_SQL}) WHERE chat_id % 7 = 3 OR NOT (event_id % 10 < 8 AND chat_id % 13 <> 0)""")
def i_08c(spark, d):
    """The chats' messages come back with ids no message ever had, though the dropped ones held the highest."""
    slugs = given.chat(spark, d).join(chosen_chats(spark, d).withColumnRenamed("chat_id", "id"), "id", "left_semi").select("slug")
    rest = upkeep.replace_chats(archive(spark, d), slugs)
    return upkeep.import_new(incoming(spark, d), specs(spark, d), rest).added["message"].select("external_id", "id")


def pending_attachments(spark, d):
    part, line = F.col("l_partkey"), F.col("l_linenumber").cast("bigint")
    return given.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("message_id"), line.alias("position"), F.concat(F.lit("p"), part).alias("source_ref"),
        F.when(part % 2 == 0, "image/png").otherwise("").alias("mime"), F.concat(F.lit("n"), part, F.lit(".mov")).alias("filename"),
        (part % 5 == 0).alias("is_sticker"), F.lit("").alias("emoji_desc"), F.concat(F.lit("/x/"), part).alias("path"))


def file_listing(spark, d):
    """Files of four parts in five; one in 40 cannot be read."""
    p = F.col("p_partkey")
    return given.table(spark, d, "part").filter(p % 5 != 4).select(
        F.concat(F.lit("/x/"), p).alias("path"), F.when(p % 40 != 0, F.concat(F.lit("h"), p)).alias("digest"),
        (p * 10).alias("bytes"), (p % 3 == 0).alias("portrait"))


COMPLETE_SQL = """
    SELECT l.l_orderkey AS message_id, l.l_linenumber::bigint AS position, l_partkey AS p, l_partkey % 5 = 4 AS gone, l_partkey % 40 = 0 AS failed
    FROM lineitem l JOIN message m ON m.id = l.l_orderkey WHERE m.media_status = 'pending'"""


@query("i_09_media_completion", f"""
    SELECT message_id, position, CASE WHEN gone THEN 'other' WHEN p % 2 = 0 THEN 'image' ELSE 'video' END AS kind,
           CASE WHEN NOT gone THEN 'media/' || CASE WHEN p % 2 = 0 THEN 'images/' ELSE 'videos/' END || substr('h' || p, 1, 2) || '/h' || p
                || CASE WHEN p % 2 = 0 THEN '.png' ELSE '.mp4' END END AS src,
           CASE WHEN NOT gone AND p % 2 = 0 THEN CASE WHEN p % 5 = 0 THEN 'sticker' ELSE 'foto' END END AS cat,
           NOT gone AND p % 3 = 0 AND (p % 2 = 1 OR p % 5 <> 0) AS portrait, CASE WHEN gone THEN 0 ELSE p * 10 END AS bytes
    FROM ({COMPLETE_SQL}) WHERE NOT failed""")
def i_09(spark, d):
    rows, _ = upkeep.complete_media(given.message(spark, d), pending_attachments(spark, d), file_listing(spark, d))
    return rows.drop("content_hash")


@query("i_09b_media_status", f"""
    SELECT m.id, CASE WHEN bool_or(coalesce(x.failed, false)) THEN 'pending' ELSE 'ready' END AS media_status
    FROM message m LEFT JOIN ({COMPLETE_SQL}) x ON x.message_id = m.id WHERE m.media_status = 'pending' GROUP BY 1""")
def i_09b(spark, d):
    return upkeep.complete_media(given.message(spark, d), pending_attachments(spark, d), file_listing(spark, d))[1]


PURGE_SQL = """
    WITH gone AS (SELECT id AS chat_id FROM chat WHERE id % 7 = 3),
    owned AS (SELECT id AS message_id FROM message WHERE chat_id IN (SELECT chat_id FROM gone)),
    src AS (SELECT md.src, bool_and(o.message_id IS NOT NULL) AS exclusive, max(md.bytes) AS bytes
            FROM media md LEFT JOIN owned o USING (message_id) WHERE md.src IS NOT NULL GROUP BY 1 HAVING bool_or(o.message_id IS NOT NULL)),
    hash AS (SELECT md.content_hash, bool_and(o.message_id IS NOT NULL) AS exclusive
             FROM media md LEFT JOIN owned o USING (message_id) GROUP BY 1 HAVING bool_or(o.message_id IS NOT NULL))"""


@query("i_10_purge_chats", PURGE_SQL + """
    SELECT 'chats' AS name, (SELECT count(*) FROM gone) AS value
    UNION ALL SELECT 'messages', (SELECT count(*) FROM owned)
    UNION ALL SELECT 'media_rows', (SELECT count(*) FROM media WHERE message_id IN (SELECT message_id FROM owned))
    UNION ALL SELECT 'files_deleted', (SELECT count(*) FROM src WHERE exclusive)
    UNION ALL SELECT 'files_kept_shared', (SELECT count(*) FROM src WHERE NOT exclusive)
    UNION ALL SELECT 'bytes_freed', (SELECT coalesce(sum(bytes), 0)::bigint FROM src WHERE exclusive)
    UNION ALL SELECT 'originals_deleted', (SELECT count(*) FROM hash WHERE exclusive)""")
def i_10(spark, d):
    return upkeep.purge(purge_tables(spark, d), chosen_chats(spark, d)).stats


def purge_tables(spark, d):
    return {"chat": given.chat(spark, d), "message": given.message(spark, d), "media": given.media(spark, d),
            "source_ref": given.source_ref(spark, d), "chat_source": given.chat_source(spark, d), "device": given.device(spark, d),
            "chat_participant": overview.participants(given.message(spark, d), given.chat(spark, d), given.device(spark, d))}


@query("i_10b_purge_files", PURGE_SQL + "SELECT src, bytes FROM src WHERE exclusive")
def i_10b(spark, d):
    return upkeep.purge(purge_tables(spark, d), chosen_chats(spark, d)).files


@query("i_10d_purged_attachments", """
    SELECT l_orderkey AS message_id, l_linenumber::bigint AS position, 'p' || l_partkey AS source_ref FROM lineitem
    WHERE l_orderkey NOT IN (SELECT id FROM message WHERE chat_id % 7 = 3)""")
def i_10d(spark, d):
    tables = {**purge_tables(spark, d), "attachment": pending_attachments(spark, d)}
    return upkeep.purge(tables, chosen_chats(spark, d)).archive["attachment"].select("message_id", "position", "source_ref")


@query("i_10c_purge_device", """
    SELECT 'device' AS table_name, (SELECT count(*) FROM device WHERE id % 4 <> 0) AS rows
    UNION ALL SELECT 'chat', (SELECT count(*) FROM chat WHERE device_id % 4 <> 0)
    UNION ALL SELECT 'message', (SELECT count(*) FROM message WHERE chat_id IN (SELECT id FROM chat WHERE device_id % 4 <> 0))
    UNION ALL SELECT 'media', (SELECT count(*) FROM media JOIN message m ON m.id = message_id JOIN chat c ON c.id = m.chat_id WHERE c.device_id % 4 <> 0)
    UNION ALL SELECT 'source_ref', (SELECT count(*) FROM source_ref JOIN message m ON m.id = message_id JOIN chat c ON c.id = m.chat_id WHERE c.device_id % 4 <> 0)""")
def i_10c(spark, d):
    tables = purge_tables(spark, d)
    devices = tables["device"].filter(F.col("id") % 4 == 0).select(F.col("id").alias("device_id"))
    rest = upkeep.purge(tables, upkeep.device_chats(tables["chat"], devices), devices).archive
    return overview.table_counts({t: rest[t] for t in ("device", "chat", "message", "media", "source_ref")})


@query("i_11_mark_seen", "SELECT chat_id, count(*) AS marked_seen FROM message WHERE sync_state = 'new' AND chat_id % 7 = 3 GROUP BY 1")
def i_11(spark, d):
    return upkeep.mark_seen(given.message(spark, d), chosen_chats(spark, d))[1]


@query("i_11b_unread_after", "SELECT chat_id, count(*) AS new, max(ts) AS last FROM message WHERE sync_state = 'new' AND chat_id % 7 <> 3 GROUP BY 1")
def i_11b(spark, d):
    return overview.update_counts(upkeep.mark_seen(given.message(spark, d), chosen_chats(spark, d))[0])


def preview_inputs(spark, d):
    store = archive(spark, d)
    return incoming(spark, d), specs(spark, d), store["source_ref"], store["person"], store["person_alias"]


PREVIEW_SQL = f"""
    WITH incoming AS ({INCOMING_SQL})
    SELECT c.slug, c.title, c.is_group, (SELECT count(*) FROM message m WHERE m.chat_id = c.id) AS total,
           (SELECT count(*) FROM incoming i WHERE i.chat_id = c.id) AS new FROM chat c"""


@query("a_14_import_preview", PREVIEW_SQL)
def a_14(spark, d):
    return upkeep.import_preview(*preview_inputs(spark, d))[0]


@query("a_14b_preview_persons", f"""
    WITH incoming AS ({INCOMING_SQL})
    SELECT DISTINCT name, (SELECT count(*) FROM incoming WHERE NOT is_me AND name NOT LIKE 'Stranger%') AS matched_messages
    FROM incoming WHERE NOT is_me AND name LIKE 'Stranger%'""")
def a_14b(spark, d):
    _, names, known = upkeep.import_preview(*preview_inputs(spark, d))
    return names.withColumn("matched_messages", known.scalar())


@query("u_02_union_of_previews", f"SELECT slug, total, new FROM ({PREVIEW_SQL}) WHERE contains(lower(title), '01') OR contains(lower(title), '1')")
def u_02(spark, d):
    listed = upkeep.import_preview(*preview_inputs(spark, d))[0]
    parts = [listed.filter(contains_ci(F.col("title"), needle)) for needle in ("01", "1")]
    return upkeep.union_previews(parts).select("slug", "total", "new")


@query("w_04_first_fill", f"""
    SELECT DISTINCT source, chat_id FROM ({CANONICAL_SQL})
    EXCEPT SELECT source, chat_id FROM ({CANONICAL_SQL}) WHERE event_id % 10 < 8 AND chat_id % 13 <> 0""")
def w_04(spark, d):
    store = archive(spark, d)
    rows = canonical(spark, d).withColumn("chat_id", F.col("chat_external_id").cast("bigint"))
    return upkeep.first_fill(rows, store["message"])
