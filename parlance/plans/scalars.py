"""Scalar functions over whole tables (F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import jsontext, recognition, text, times
from parlance.functions.diff import edit_diffs
from parlance.operators import export_text, overview
from parlance.plans import given, vendor
from parlance.plans.registry import query


@query("f_01_vendor_times", """
    SELECT event_id, cast(floor(epoch(ts)) AS bigint) AS apple, cast(floor(epoch(ts)) AS bigint) AS whatsapp,
           cast(floor(epoch(ts)) AS bigint) AS export, cast(floor(epoch(ts)) AS bigint) - 3600 AS berlin,
           cast(ts + INTERVAL 1 HOUR AS date) AS berlin_day
    FROM events""")
def f_01(spark, d):
    at = given.event_seconds()
    line = F.concat(F.lit("["), F.date_format("ts", "dd.MM.yy, HH:mm:ss"), F.lit("] A: b"))
    parts = export_text.header_parts(line, export_text.header_format(line))
    return given.table(spark, d, "events").select(
        "event_id", times.apple_seconds((at - times.VENDOR_EPOCH) * 1000000000 + 999999999).alias("apple"),
        times.whatsapp_seconds((at - times.VENDOR_EPOCH).cast("double") + 0.75).alias("whatsapp"),
        export_text.header_time(parts).alias("export"), export_text.header_time(parts, "Europe/Berlin").alias("berlin"),
        times.local_day(at, "Europe/Berlin").alias("berlin_day"))


TITLE_SQL = "'+ ' || p_name || ' (' || p_brand || ') ' || p_type"


@query("f_02_initials", f"""
    SELECT p_partkey, upper(array_to_string(list_transform(list_filter(list_transform(
               string_split_regex(regexp_replace({TITLE_SQL}, '\\([^)]*\\)', ' ', 'g'), '\\s+'),
               lambda w: regexp_extract(w, '[\\p{{L}}\\p{{N}}]')), lambda x: x <> '')[1:2], lambda x: x), '')) AS index_initials,
           upper(array_to_string(list_transform(string_split_regex({TITLE_SQL}, '\\s+')[1:2], lambda w: w[1]), '')) AS page_initials
    FROM part""")
def f_02(spark, d):
    title = F.concat(F.lit("+ "), "p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")
    return given.table(spark, d, "part").select(
        "p_partkey", text.initials(title).alias("index_initials"), text.avatar_initials(title).alias("page_initials"))


@query("f_03_human_bytes", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::double)
           WHEN b >= 1048576 THEN floor(b / 1048576.0::double + 0.5)::bigint || ' MB'
           WHEN b >= 1024 THEN floor(b / 1024.0::double + 0.5)::bigint || ' KB' ELSE b || ' B' END AS size
    FROM (SELECT *, cast(floor(l_extendedprice) AS bigint) * CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS b
          FROM lineitem)""")
def f_03(spark, d):
    part = F.col("l_partkey")
    b = F.floor("l_extendedprice") * F.when(part % 3 == 0, 1).when(part % 3 == 1, 1000).otherwise(1000000)
    return given.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.human_bytes(b).alias("size"))


@query("f_04_durations", """
    SELECT p_partkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's'
           ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS eta,
           (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') AS player
    FROM (SELECT p_partkey, p_partkey * p_size AS s FROM part)""")
def f_04(spark, d):
    seconds = F.col("p_partkey") * F.col("p_size")
    return given.table(spark, d, "part").select(
        "p_partkey", text.duration_text(seconds).alias("eta"), text.player_time(seconds + 0.9).alias("player"))


@query("f_05_extension", """
    SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:\\?.*)?$', 1)) AS ext,
           CASE page_id % 4 WHEN 0 THEN 'PDF document' WHEN 1 THEN 'Contact / location' WHEN 2 THEN 'Watch face' ELSE 'File' END AS label
    FROM pages""")
def f_05(spark, d):
    k = F.col("page_id")
    name = F.concat(F.lit("media/f/"), k, F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".vcf?x=1").when(k % 4 == 2, ".watchface").otherwise(".zip"))
    return given.table(spark, d, "pages").select("page_id", text.extension(F.col("url")).alias("ext"), text.file_label(name).alias("label"))


@query("f_06_urls", """
    SELECT page_id, len(regexp_extract_all(html, 'https?://\\S+'))::bigint AS n,
           md5(array_to_string(regexp_extract_all(html || ' ' || url, 'https?://\\S+'), ' ')) AS digest FROM pages""")
def f_06(spark, d):
    return given.table(spark, d, "pages").select(
        "page_id", F.size(text.urls(F.col("html"))).cast("bigint").alias("n"),
        F.md5(F.array_join(text.urls(F.concat("html", F.lit(" "), "url")), " ")).alias("digest"))


@query("f_07_name_and_period", """
    SELECT chat_id, split_part(p.display_name, '#', 1) AS first_name, first, last,
           cast(floor((last - first) / 86400.0 + 0.5) AS bigint) + 1 AS days
    FROM (SELECT chat_id, min(ts) AS first, max(ts) AS last FROM visible_message GROUP BY 1) JOIN person p ON p.id = chat_id""")
def f_07(spark, d):
    names = given.person(spark, d).select(
        F.col("id").alias("chat_id"), text.first_name(F.replace(F.col("display_name"), F.lit("#"), F.lit(" "))).alias("first_name"))
    spans = overview.message_counts(given.message(spark, d)).select("chat_id", "first", "last")
    return spans.join(names, "chat_id").withColumn("days", text.day_span(F.col("first"), F.col("last")))


@query("f_08_tokens", """
    SELECT doc_id, len(regexp_extract_all(text, '\\s+|\\S+'))::bigint AS n,
           md5(array_to_string(regexp_extract_all(text, '\\s+|\\S+'), '|')) AS digest FROM documents""")
def f_08(spark, d):
    rows = given.table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", "|")).alias("digest"))


@query("f_09_json_columns", """
    SELECT id, CASE WHEN n_edits = 2 THEN '[{"text":"draft ' || id || '","ts":' || (ts - 60) || '},{"text":"final ' || id || '","ts":' || ts || '}]'
           WHEN n_edits = 1 THEN '[{"text":"final ' || id || '","ts":' || ts || '}]' END AS edits,
           CASE WHEN app IS NOT NULL THEN '["' || app || '"]' END AS apps, n_edits::bigint AS n_edits,
           CASE WHEN n_edits IS NOT NULL THEN 'final ' || id END AS last_text
    FROM message""")
def f_09(spark, d):
    rows = given.message(spark, d).select("id", jsontext.encode(F.col("edits")).alias("edits"), jsontext.encode(F.col("apps")).alias("apps"))
    back = jsontext.decode_edits(F.col("edits"))
    return rows.select("id", "edits", "apps", F.when(back.isNotNull(), F.size(back)).cast("bigint").alias("n_edits"),
                       F.try_element_at(back, F.lit(-1))["text"].alias("last_text"))


LATIN_SQL = """length(regexp_replace(regexp_replace(text, '\\P{L}', '', 'g'), '[^\\p{Latin}]', '', 'g'))
    / nullif(length(regexp_replace(text, '\\P{L}', '', 'g')), 0)"""
DOMINANT_SQL = f"coalesce(lines >= 2 AND text <> '' AND {LATIN_SQL} >= 0.5, false)"


@query("f_10_text_dominance", f"SELECT src, lines, {DOMINANT_SQL} AS dominant FROM ocr")
def f_10(spark, d):
    return given.ocr(spark, d).select("src", "lines", recognition.is_text_dominant(F.col("text"), F.col("lines")).alias("dominant"))


@query("f_11_screenshots", f"""
    SELECT src, {DOMINANT_SQL} AND lines >= 8 AND list_sum(list_transform(string_split(coalesce(text, ''), chr(10)),
           lambda x: length(trim(x)))) >= 120 AS screenshot FROM ocr""")
def f_11(spark, d):
    return given.ocr(spark, d).select("src", recognition.is_screenshot(F.col("text"), F.col("lines")).alias("screenshot"))


@query("f_12_transcript_sanitise", f"""
    SELECT src, CASE WHEN verdict IS NULL THEN text ELSE '' END AS text,
           coalesce(verdict, CASE WHEN prob < 0.5 THEN 'uncertain recognition (language ' || lang || ', ' || round(prob * 100)::int || '%)' END) AS note
    FROM (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'empty'
                         WHEN lang IN ('nn', 'no', '') AND prob < 0.6 THEN 'no clear language (hallucination)'
                         WHEN prob < 0.45 THEN 'uncertain (' || lang || ' ' || round(prob * 100)::int || '%, likely noise)'
                         WHEN {LATIN_SQL} < 0.5 THEN 'non-latin characters (hallucination)'
                         WHEN length(regexp_replace(text, '[^A-Za-zÀ-ÿ0-9]', '', 'g')) < 3 THEN 'too short / unintelligible' END AS verdict
          FROM (SELECT * REPLACE (CASE WHEN lang = 'es' THEN 'nn' ELSE lang END AS lang) FROM transcript))""")
def f_12(spark, d):
    rows = given.transcript(spark, d).withColumn("lang", F.when(F.col("lang") == "es", "nn").otherwise(F.col("lang")))
    v = recognition.transcript_verdict(F.col("text"), F.col("lang"), F.col("prob"))
    return rows.select("src", v.alias("v")).select("src", "v.text", "v.note")


@query("f_13_service_name", """
    SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'WhatsApp' WHEN 2 THEN 'Signal' WHEN 3 THEN 'SMS / Android' ELSE 'iMessage' END AS service
    FROM customer""")
def f_13(spark, d):
    k = F.col("c_custkey") % 6
    origin = F.when(k == 0, "apple").when(k == 1, "whatsapp").when(k == 2, "signal").when(k == 3, "sms").when(k == 4, "telegram")
    return given.table(spark, d, "customer").select("c_custkey", text.service_name(origin).alias("service"))


@query("i_13_edit_diff")
def i_13(spark, d):
    """Runs of kept, removed and added words between a version and the next, over whole texts."""
    rows = edit_diffs(vendor.version_pairs(spark, d), "old", "new")
    return rows.select("conv_id", "turn", F.posexplode("runs").alias("k", "run")).select("conv_id", "turn", "k", "run.op", "run.text")


@query("i_13b_edit_diff_versions", """
    SELECT conv_id, turn, md5(old) AS old, md5(new) AS new FROM version_pair""")
def i_13b(spark, d):
    """Both versions put together again from the runs."""
    rows = edit_diffs(vendor.version_pairs(spark, d), "old", "new")

    def rebuilt(skip: str):
        return F.md5(F.array_join(F.transform(F.filter("runs", lambda r: r["op"] != skip), lambda r: r["text"]), ""))

    return rows.select("conv_id", "turn", rebuilt("ins").alias("old"), rebuilt("del").alias("new"))
