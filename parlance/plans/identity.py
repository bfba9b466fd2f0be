"""Identity queries (I-01 ... I-05, I-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import identity, vcards
from parlance.plans import given
from parlance.plans.registry import query

DAY = "floor(cast(floor(epoch(ts)) AS bigint) / 86400.0)"


def sent_handles(spark, d):
    """One handle per event, in three spellings; every seventh event comes from an unknown number."""
    e, u = F.col("event_id"), F.col("user_id")
    unknown = F.concat(F.lit("+43 1-"), u, F.lit(" "), e % 3)
    value = F.when(e % 7 == 0, unknown).when(e % 3 == 0, given.spaced_handle(u)).when(e % 3 == 1, given.compact_handle(u)).otherwise(
        F.concat(F.lit("C"), u, F.lit("@Example.org")))
    return given.table(spark, d, "events").select("event_id", value.alias("value"), given.event_seconds().alias("ts"))


SENT_HANDLES_SQL = """
    SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN '+431' || user_id || (event_id % 3)
           WHEN event_id % 3 < 2 THEN '+49170' || lpad(user_id::varchar, 7, '0') ELSE 'c' || user_id || '@example.org' END AS norm,
           CASE WHEN event_id % 7 = 0 THEN '+43 1-' || user_id || ' ' || (event_id % 3)
           WHEN event_id % 3 = 0 THEN '+49 170-' || lpad(user_id::varchar, 7, '0')[1:3] || ' ' || lpad(user_id::varchar, 7, '0')[4:7]
           WHEN event_id % 3 = 1 THEN '+49170' || lpad(user_id::varchar, 7, '0') ELSE 'C' || user_id || '@Example.org' END AS value
    FROM events"""


@query("i_01_resolve_handle", f"""
    WITH sent AS ({SENT_HANDLES_SQL}),
    known AS (SELECT value AS norm, max(person_id) AS person_id FROM handle GROUP BY 1),
    fresh AS (SELECT norm, min({DAY}) AS day, arg_min(value, {{'t': cast(floor(epoch(ts)) AS bigint), 'v': value}}) AS display_name
              FROM sent WHERE norm NOT IN (SELECT norm FROM known) GROUP BY 1),
    numbered AS (SELECT *, (SELECT max(id) FROM person) + row_number() OVER (ORDER BY day, md5(norm)) AS person_id FROM fresh)
    SELECT s.event_id, s.value, coalesce(k.person_id, n.person_id) AS person_id, coalesce(n.display_name, '') AS new_name
    FROM sent s LEFT JOIN known k USING (norm) LEFT JOIN numbered n ON n.norm = s.norm""")
def i_01(spark, d):
    sent = sent_handles(spark, d)
    found = identity.resolve_handles(sent, given.handle(spark, d), given.person(spark, d))
    named = found.new_persons.select(F.col("id").alias("person_id"), F.col("display_name").alias("new_name"))
    rows = identity.link_senders(sent, found.links, "value").join(named, "person_id", "left")
    return rows.select("event_id", "value", "person_id", F.coalesce("new_name", F.lit("")).alias("new_name"))


def sent_names(spark, d):
    """One sender name per event: exact, other case, a recorded spelling, or new in two spellings."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = given.table(spark, d, "events").join(
        given.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    value = (
        F.when(e % 4 == 0, F.concat(F.col("c_name"), F.lit(" "))).when(e % 4 == 1, F.lower("c_name"))
        .when(e % 4 == 2, F.concat(F.lit("also   "), F.lower("c_name")))
        .when(e % 8 == 3, F.concat(F.lit("New  Person "), u % 50)).otherwise(F.concat(F.lit("NEW person "), u % 50)))
    return rows.select("event_id", value.alias("value"), given.event_seconds().alias("ts"))


SENT_NAMES_SQL = """
    SELECT event_id, ts, cast(floor(epoch(ts)) AS bigint) AS t, CASE event_id % 4 WHEN 0 THEN c_name || ' ' WHEN 1 THEN lower(c_name) WHEN 2 THEN 'also   ' || lower(c_name)
           ELSE CASE WHEN event_id % 8 = 3 THEN 'New  Person ' ELSE 'NEW person ' END || (user_id % 50) END AS value
    FROM events JOIN customer ON c_custkey = user_id"""
MATCHED_NAMES_SQL = f"""
    SELECT s.*, trim(s.value) AS key, regexp_replace(lower(trim(s.value)), '\\s+', ' ', 'g') AS norm,
           coalesce((SELECT max(id) FROM person p WHERE p.display_name = trim(s.value)),
                    (SELECT max(person_id) FROM person_alias a
                     WHERE regexp_replace(lower(a.value), '\\s+', ' ', 'g') = regexp_replace(lower(trim(s.value)), '\\s+', ' ', 'g')),
                    (SELECT max(id) FROM person p WHERE lower(p.display_name) = regexp_replace(lower(trim(s.value)), '\\s+', ' ', 'g'))) AS known_id
    FROM ({SENT_NAMES_SQL}) s"""


@query("i_02_resolve_name", f"""
    WITH matched AS ({MATCHED_NAMES_SQL}),
    fresh AS (SELECT norm, min({DAY}) AS day, arg_min(key, {{'t': t, 'k': key}}) AS display_name FROM matched WHERE known_id IS NULL GROUP BY 1),
    numbered AS (SELECT *, (SELECT max(id) FROM person) + row_number() OVER (ORDER BY day, md5(norm)) AS person_id FROM fresh)
    SELECT m.event_id, m.value, coalesce(m.known_id, n.person_id) AS person_id, coalesce(n.display_name, '') AS new_name
    FROM matched m LEFT JOIN numbered n ON n.norm = m.norm AND m.known_id IS NULL""")
def i_02(spark, d):
    sent = sent_names(spark, d)
    found = identity.resolve_names(sent, given.person(spark, d), given.person_alias(spark, d))
    named = found.new_persons.select(F.col("id").alias("person_id"), F.col("display_name").alias("new_name"))
    rows = identity.link_senders(sent, found.links, "value").join(named, "person_id", "left")
    return rows.select("event_id", "value", "person_id", F.coalesce("new_name", F.lit("")).alias("new_name"))


@query("i_02b_match_name", f"SELECT DISTINCT value, known_id FROM ({MATCHED_NAMES_SQL})")
def i_02b(spark, d):
    names = sent_names(spark, d).select("value").distinct()
    return identity.match_names(names, given.person(spark, d), given.person_alias(spark, d)).select("value", "known_id")


def merge_tables(spark, d):
    messages = given.message(spark, d)
    return {
        "person": given.person(spark, d), "handle": given.handle(spark, d), "person_alias": given.person_alias(spark, d),
        "device": given.device(spark, d), "message": messages.select("id", "sender_person_id"),
        "chat_participant": messages.select("chat_id", F.col("sender_person_id").alias("person_id")).distinct(),
    }


MOVED = "CASE WHEN {c} % 10 = 4 THEN {c} - 2 WHEN {c} % 10 = 7 THEN {c} - 5 ELSE {c} END"
MERGE_SQL = f"""
    SELECT 'message' AS what, id::varchar AS key, {MOVED.format(c='sender_person_id')} AS person_id FROM message
    UNION ALL SELECT 'device', slug, {MOVED.format(c='owner_person_id')} FROM device
    UNION ALL SELECT 'handle', value, {MOVED.format(c='person_id')} FROM handle
    UNION ALL SELECT 'person_alias', value, {MOVED.format(c='person_id')} FROM person_alias
    UNION ALL SELECT 'person_alias', display_name, {MOVED.format(c='id')} FROM person WHERE id % 10 IN (4, 7)
    UNION ALL SELECT DISTINCT 'chat_participant', chat_id::varchar, {MOVED.format(c='sender_person_id')} FROM message
    UNION ALL SELECT 'person', display_name, id FROM person WHERE id % 10 NOT IN (4, 7)"""


@query("i_03_merge_persons", MERGE_SQL)
def i_03(spark, d):
    """Persons ...7 go to ...4, which go to ...2: a chain of two merges."""
    tables = merge_tables(spark, d)
    k = F.col("id")
    pairs = tables["person"].filter((k % 10).isin(4, 7)).select(
        k.alias("src_id"), F.when(k % 10 == 4, k - 2).otherwise(k - 3).alias("dst_id"))
    merged = identity.merge_persons(tables, pairs)
    keys = {"message": ("id", "sender_person_id"), "device": ("slug", "owner_person_id"), "handle": ("value", "person_id"),
            "person_alias": ("value", "person_id"), "chat_participant": ("chat_id", "person_id"), "person": ("display_name", "id")}
    out = None
    for what, (key, who) in keys.items():
        rows = merged[what].select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), F.col(who).alias("person_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("i_04_people_map", """
    WITH entries AS (
        SELECT c_custkey AS k, '+49170' || lpad(c_custkey::varchar, 7, '0') AS norm,
               CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Mapped ' || (c_custkey % 20) END AS name FROM customer),
    known AS (SELECT value AS norm, max(person_id) AS id FROM handle GROUP BY 1),
    fresh AS (SELECT DISTINCT lower(name) AS norm FROM entries WHERE norm NOT IN (SELECT norm FROM known)
              AND name NOT IN (SELECT display_name FROM person)),
    numbered AS (SELECT norm, (SELECT max(id) FROM person) + row_number() OVER (ORDER BY md5(norm)) AS id FROM fresh)
    SELECT e.norm, e.name, coalesce(known.id, p.id, n.id) AS person_id, known.id IS NULL AS is_new
    FROM entries e LEFT JOIN known USING (norm) LEFT JOIN person p ON p.display_name = e.name AND known.id IS NULL
    LEFT JOIN numbered n ON n.norm = lower(e.name) AND known.id IS NULL""")
def i_04(spark, d):
    k = F.col("c_custkey")
    people = given.table(spark, d, "customer").select(
        given.spaced_handle(k).alias("handle"),
        F.when(k % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Mapped "), k % 20)).alias("name"))
    found = identity.migrate_people(people, given.person(spark, d), given.handle(spark, d), given.person_alias(spark, d))
    return found.links.select("norm", "name", "person_id", "is_new")


@query("i_05_owner_alias", """
    SELECT slug, CASE n_name WHEN 'NATION_3' THEN 'Full Three' WHEN 'NATION_7' THEN 'Full: Seven' ELSE n_name END AS owner
    FROM device JOIN nation ON n_nationkey = id""")
def i_05(spark, d):
    aliases = identity.parse_owner_aliases("NATION_3:Full Three, NATION_7 : Full: Seven,broken, :x")
    return given.device(spark, d).select("slug", identity.owner_name(F.col("name"), aliases).alias("owner"))


def card_texts(spark, d):
    """One contact card per customer, folded lines and escapes included."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("FN:"), "c_name", F.lit("\\, Jr"))).otherwise(F.concat(F.lit("N:"), "c_name", F.lit(";Given;;;")))
    url = F.when(k % 4 == 0, F.concat(F.lit("item1.URL:x\nURL;type=pref:https://maps.apple.com/?q=a&ll=48."), k, F.lit(",-11.5\n"))).otherwise("")
    text = F.concat(F.lit("BEGIN:VCARD\r\n"), name, F.lit("\r\nORG:Org\r\n  "), "c_mktsegment", F.lit(";;\r\nTEL;type=CELL:"), given.compact_handle(k),
                    F.lit("\r\nTEL:"), k, F.lit("\r\nEMAIL;x=1:c"), k, F.lit("@example.org\r\n"), url, F.lit("END:VCARD\r\n"))
    return given.table(spark, d, "customer").select(F.concat(F.lit("cards/"), k, F.lit(".vcf")).alias("path"), text.alias("text"))


@query("i_12_vcards", """
    SELECT 'cards/' || c_custkey || '.vcf' AS path,
           CASE WHEN c_custkey % 3 = 0 THEN c_name || ', Jr' ELSE 'Given ' || c_name END AS full_name, 'Org ' || c_mktsegment AS org,
           '+49170' || lpad(c_custkey::varchar, 7, '0') || '|' || c_custkey AS tel, 'c' || c_custkey || '@example.org' AS email,
           CASE WHEN c_custkey % 4 = 0 THEN '48.' || c_custkey END AS lat, CASE WHEN c_custkey % 4 = 0 THEN '-11.5' END AS lng
    FROM customer""")
def i_12(spark, d):
    rows = vcards.parse(card_texts(spark, d))
    return rows.select("path", "full_name", "org", F.array_join("tel", "|").alias("tel"), F.array_join("email", "|").alias("email"), "lat", "lng")
