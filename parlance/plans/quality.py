"""Drift and integrity queries (D-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.decode import edit_history
from parlance.operators import canonical, drift, export_text, integrity
from parlance.plans import given, vendor
from parlance.plans.canonical import edit_blobs
from parlance.plans.joins import canonical as canonical_rows
from parlance.plans.reading import DRIFT_STORE_SQL
from parlance.plans.registry import query
from parlance.sources import contracts

# A small contract per store: (table, column, storage, required, flag_new).
CONTRACT = [("m", "pk", "INTEGER", True, True), ("m", "ts", "NUMERIC", True, True), ("m", "txt", None, False, True),
            ("s", "pk", "INTEGER", True, False), ("s", "name", None, False, False)]


def store_name():
    return F.concat(F.lit("store"), F.col("c_custkey"))


def contract(spark, d):
    rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(s).cast("string").alias("storage"),
                              F.lit(r).alias("required"), F.lit(n).alias("flag_new")) for t, c, s, r, n in CONTRACT])
    return given.table(spark, d, "customer").select(
        store_name().alias("source"), F.lit(3).alias("schema_version"), F.explode(rows).alias("x")).select("source", "schema_version", "x.*")


def observed(spark, d):
    """What each customer's store shows: some tables, columns and types differ from the contract."""
    k = F.col("c_custkey")

    def column(when, table: str, name: str, declared):
        return F.when(when, F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), declared.alias("declared_type")))

    rows = F.array_compact(F.array(
        column(k % 7 != 0, "m", "pk", F.lit("integer")), column(k >= 0, "m", "ts", F.when(k % 4 == 1, "VARCHAR(20)").otherwise("TIMESTAMP")),
        column(k % 3 != 0, "m", "txt", F.lit("TEXT")), column(k % 6 == 0, "m", "extra", F.lit("")),
        column(k % 5 != 0, "s", "pk", F.lit("BIGINT")), column(k % 5 != 0, "s", "other", F.lit("CLOB"))))
    return given.table(spark, d, "customer").select(store_name().alias("source"), F.explode(rows).alias("x")).select("source", "x.*")


def probe_rows(spark, d, kind):
    rows = drift.probe(contract(spark, d), observed(spark, d), 1700000000)
    return rows.filter(F.col("kind") == kind).select("source", "severity", "table_name", "column_name", "observed", "expected", "seen_at")


PROBES = {
    "d_01_missing_table": ("missing_table", "SELECT 's' AS t, NULL::varchar AS c, NULL::varchar AS o, 'present' AS e, 'fatal' AS v, c_custkey AS k FROM customer WHERE c_custkey % 5 = 0"),
    "d_02_missing_required": ("missing_required_column", "SELECT 'm' AS t, 'pk' AS c, NULL::varchar AS o, 'INTEGER' AS e, 'fatal' AS v, c_custkey AS k FROM customer WHERE c_custkey % 7 = 0"),
    "d_03_type_changed": ("type_changed", "SELECT 'm' AS t, 'ts' AS c, 'TEXT' AS o, 'NUMERIC' AS e, 'fatal' AS v, c_custkey AS k FROM customer WHERE c_custkey % 4 = 1"),
    "d_04_missing_optional": ("missing_optional_column", """
        SELECT 'm' AS t, 'txt' AS c, NULL::varchar AS o, 'present (optional)' AS e, 'warn' AS v, c_custkey AS k FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 's', 'name', NULL, 'present (optional)', 'warn', c_custkey FROM customer WHERE c_custkey % 5 <> 0"""),
    "d_05_new_column": ("new_column", "SELECT 'm' AS t, 'extra' AS c, 'BLOB' AS o, NULL::varchar AS e, 'warn' AS v, c_custkey AS k FROM customer WHERE c_custkey % 6 = 0"),
}


def _register(name: str, kind: str, sql: str) -> None:
    query(name, f"""SELECT 'store' || k AS source, v AS severity, t AS table_name, c AS column_name, o AS observed, e AS expected,
        1700000000::bigint AS seen_at FROM ({sql})""")(lambda spark, d: probe_rows(spark, d, kind))


for _name, (_kind, _sql) in PROBES.items():
    _register(_name, _kind, _sql)


@query("d_06_unknown_enum", """
    SELECT 'ZWAMESSAGE' AS table_name, 'ZMESSAGETYPE' AS column_name, '99' AS observed, count(*) AS occurrences
    FROM events WHERE event_id % 20 = 16 AND event_id % 31 <> 0
    UNION ALL SELECT 'ZWAMESSAGE', 'ZGROUPEVENTTYPE', (event_id % 15)::varchar, count(*) FROM events WHERE event_id % 7 = 0 AND event_id % 15 > 12 GROUP BY 3
    UNION ALL SELECT 'ZWACHATSESSION', 'ZSESSIONTYPE', '9', count(*) FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 23 = 0
    UNION ALL SELECT 'message', 'associated_message_type', amt::varchar, count(*) FROM apple_message WHERE amt = 1000 GROUP BY 3""")
def d_06(spark, d):
    wa = canonical.enum_events(vendor.whatsapp_store(spark, d), contracts.WHATSAPP_SOURCE, contracts.WHATSAPP_VERSION, contracts.WHATSAPP_ENUMS, 1)
    apple = canonical.enum_events(vendor.apple_store(spark, d), contracts.APPLE_LIVE, contracts.APPLE_VERSION, contracts.APPLE_ENUMS, 1)
    return wa.unionByName(apple).select("table_name", "column_name", "observed", "occurrences")


@query("d_07_parse_failures", """
    SELECT 'whatsapp_live' AS source, 'NULL' AS observed, 'message ' || event_id || ' has no time' AS detail FROM events WHERE event_id % 97 = 0
    UNION ALL SELECT 'imessage_live', 'TypeError', 'edits of ' || conv_id || '/' || turn FROM version_pair WHERE conv_id % 10 = 0""")
def d_07(spark, d):
    no_time = canonical.whatsapp_failures(vendor.whatsapp_store(spark, d), contracts.WHATSAPP_SOURCE, 1)
    edits = edit_blobs(spark, d).withColumn("h", edit_history("blob")).withColumn("source", F.lit(contracts.APPLE_LIVE))
    broken = drift.parse_failures(edits, contracts.APPLE_VERSION, "message", F.col("h.error"), F.concat(F.lit("edits of "), "conv_id", F.lit("/"), "turn"), 1)
    return no_time.unionByName(broken).select("source", "observed", "detail")


def strange_lines(spark, d):
    return vendor.export_lines(vendor.turns(spark, d), strange=True)


@query("d_08_export_format", """
    SELECT DISTINCT 'export folder conv' || conv_id AS detail, 'fatal' AS severity FROM conversations WHERE conv_id % 9 = 0""")
def d_08(spark, d):
    events = export_text.probe_formats(strange_lines(spark, d), 1)
    return events.filter(F.col("kind") == "unknown_export_format").select("detail", "severity")


@query("d_09_export_keyword", """
    SELECT DISTINCT 'export folder conv' || conv_id AS detail, 'warn' AS severity, 'Bilaga' AS observed FROM conversations WHERE conv_id % 8 = 0 AND turn = 0""")
def d_09(spark, d):
    events = export_text.probe_formats(strange_lines(spark, d), 1)
    return events.filter(F.col("kind") == "unknown_export_locale").select("detail", "severity", "observed")


@query("d_10_drift_upsert", f"SELECT * FROM ({DRIFT_STORE_SQL})")
def d_10(spark, d):
    """The store after one run, with a second run merged in."""
    rows = given.drift_event_in(spark, d)
    late = F.col("seen_at") >= 1705000000
    first = drift.upsert(None, rows.filter(~late))
    return drift.upsert(first, rows.filter(late)).select(
        "source", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("table_name", "column_name", "observed")],
        "first_seen", "last_seen", "occurrence_count", "severity", "schema_version", "detail")


@query("d_10b_drift_ids", f"""
    SELECT source, kind, table_name, column_name, observed,
           row_number() OVER (ORDER BY floor(first_seen / 86400.0), md5(concat_ws(chr(31), source, kind, table_name, column_name, observed))) AS id
    FROM ({DRIFT_STORE_SQL})""")
def d_10b(spark, d):
    store = drift.number_events(drift.upsert(None, given.drift_event_in(spark, d)))
    return store.select("source", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("table_name", "column_name", "observed")], "id")


@query("d_11_acknowledge", f"""
    SELECT source, count(*) AS events, count_if(source = 'whatsapp_live') AS acknowledged, CASE WHEN source = 'whatsapp_live' THEN 77::bigint END AS at
    FROM ({DRIFT_STORE_SQL}) GROUP BY source""")
def d_11(spark, d):
    store = drift.acknowledge(drift.upsert(None, given.drift_event_in(spark, d)), 77, source="whatsapp_live")
    again = drift.acknowledge(store, 99, source="whatsapp_live")
    return again.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"), F.count("acknowledged_at").alias("acknowledged"), F.max("acknowledged_at").alias("at"))


@query("d_12_origin_consistency", """
    SELECT 'whatsapp chat with apple anchor' AS check, c.slug, s.source, count(*) AS n FROM chat c JOIN chat_source s ON s.chat_id = c.id
    WHERE c.origin = 'whatsapp' AND s.source LIKE 'imessage%' GROUP BY ALL
    UNION ALL SELECT 'whatsapp message with apple anchor', c.slug, r.source, count(*) FROM source_ref r JOIN message m ON m.id = r.message_id
    JOIN chat c ON c.id = m.chat_id WHERE c.origin = 'whatsapp' AND r.source LIKE 'imessage%' GROUP BY ALL
    UNION ALL SELECT 'apple chat with other anchor', c.slug, s.source, count(*) FROM chat c JOIN chat_source s ON s.chat_id = c.id
    WHERE c.origin = 'apple' AND s.source NOT LIKE 'imessage%' GROUP BY ALL""")
def d_12(spark, d):
    return integrity.origin_violations(given.chat(spark, d), given.chat_source(spark, d), given.message(spark, d), given.source_ref(spark, d))


@query("d_13_fatal_gate", """
    SELECT CASE WHEN m.chat_id % 2 = 0 THEN 'imessage_live:dev' ELSE 'whatsapp_live:dev' END || c.device_id AS source, count(*) AS n
    FROM message m JOIN chat c ON c.id = m.chat_id WHERE c.device_id % 5 <> 0 OR m.chat_id % 2 = 0 GROUP BY 1""")
def d_13(spark, d):
    """Every fifth device's second source has a fatal event, the others warnings."""
    k = F.col("id")
    events = given.device(spark, d).select(
        F.concat(F.lit("whatsapp_live:"), "slug").alias("source"), F.when(k % 5 == 0, "fatal").otherwise("warn").alias("severity"))
    return drift.gate(canonical_rows(spark, d), events).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("d_14_referential_check", """
    SELECT 'media' AS child, 'message_id' AS column_name, l_orderkey AS value, count(*) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT event_id FROM events) GROUP BY 3
    UNION ALL SELECT 'message', 'sender_person_id', sender_person_id, count(*) FROM message WHERE sender_person_id % 9 = 0 GROUP BY 3
    UNION ALL SELECT 'device', 'owner_person_id', owner_person_id, count(*) FROM device WHERE owner_person_id % 9 = 0 GROUP BY 3""")
def d_14(spark, d):
    """Media of all order lines, and persons of whom every ninth is missing."""
    tables = {
        "person": given.person(spark, d).filter(F.col("id") % 9 != 0), "device": given.device(spark, d), "chat": given.chat(spark, d),
        "message": given.message(spark, d), "media": given.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id")),
        "source_ref": given.source_ref(spark, d),
    }
    return integrity.orphans(tables)
