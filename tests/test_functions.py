import pytest
from pyspark.sql import functions as F

from parlance.functions import labels, media, recognition, text, times


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [
    (" +49 170-123 45 ", "+4917012345"), ("Anna-Lena", "anna-lena"), ("A B-1@X.org", "a b-1@x.org"), ("", "")])
def test_handles(spark, raw, want):
    assert value(spark, text.norm_handle(F.lit(raw))) == want


def test_names_and_cleaning(spark):
    assert value(spark, text.norm_name(F.lit("  Alice \t K.\n Example "))) == "alice k. example"
    assert value(spark, text.clean_text(F.lit(" ￼ hi �\n"))) == "hi"
    assert value(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert value(spark, text.strip_invisible(F.lit("‎<x>‏"))) == "<x>"


@pytest.mark.parametrize("title, index, page", [
    ("Anna (iCloud) Berg", "AB", "A("), ("+49 170", "41", "+1"), ("x", "X", "X"), ("", "", "")])
def test_initials(spark, title, index, page):
    assert value(spark, text.initials(F.lit(title))) == index
    assert value(spark, text.avatar_initials(F.lit(title))) == page


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1536, "2 KB"), (5 << 20, "5 MB"), (1610612736, "1.5 GB")])
def test_bytes(spark, n, want):
    assert value(spark, text.human_bytes(F.lit(n))) == want


def test_bytes_with_comma(spark):
    assert value(spark, text.human_bytes(F.lit(1610612736), ",")) == "1,5 GB"


@pytest.mark.parametrize("s, want", [(12.3, "12s"), (67.0, "1m 7s"), (910.0, "15m 10s"), (4200.0, "1h 10m"), (99999.0, "27h 46m"), (-3.0, "0s")])
def test_durations(spark, s, want):
    assert value(spark, text.duration_text(F.lit(s))) == want


def test_vendor_clocks(spark):
    assert value(spark, times.apple_seconds(F.lit(1_999_999_999))) == 978307201
    assert value(spark, times.apple_seconds(F.lit(-1))) == 978307199
    assert value(spark, times.apple_seconds(F.lit(None).cast("bigint"))) is None
    assert value(spark, times.whatsapp_seconds(F.lit(10.9))) == 978307210


def test_days_follow_the_named_zone_only(spark):
    late = 1704063600 + 1800  # 2023-12-31 23:30 UTC
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert str(value(spark, times.local_day(F.lit(late)))) == "2023-12-31"
            assert str(value(spark, times.local_day(F.lit(late), "Europe/Berlin"))) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name, want", [
    ("a.tar.gz", ".gz"), (".hidden", ""), ("x/.hidden", ""), ("d.d/name", ""), ("..a.b", ".b"), ("a.", "."), ("a.b", ".b"), ("ab.c/d.e", ".e")])
def test_split_extension(spark, name, want):
    assert value(spark, media.split_extension(F.lit(name))) == want


def test_balloons(spark):
    assert value(spark, labels.balloon_label(F.lit("com.apple.FindMy.x"))) == "📍 Location shared"
    assert value(spark, labels.balloon_label(F.lit("com.apple.URLBalloonProvider"))) == "🔗 Shared link"
    assert value(spark, labels.balloon_label(F.lit("zzz"))) == "📲 App message"
    assert value(spark, labels.balloon_label(F.lit(""))) is None


def test_text_dominance(spark):
    def both(t, n):
        return value(spark, recognition.is_text_dominant(F.lit(t), F.lit(n)))

    assert both("ab\ncd", 2) and not both("ab", 1) and not both("12\n34", 2) and not both("привет\nмир a", 2)


@pytest.mark.parametrize("args, want", [
    (("", "en", 1.0), ("", "empty")), (("hi there", "nn", 0.5), ("", "no clear language (hallucination)")),
    (("hi there", "en", 0.4), ("", "uncertain (en 40%, likely noise)")), (("привет", "ru", 1.0), ("", "non-latin characters (hallucination)")),
    (("a!", "en", 1.0), ("", "too short / unintelligible")),
    (("hello", "en", 0.47), ("hello", "uncertain recognition (language en, 47%)")), (("hello", "en", 0.9), ("hello", None))])
def test_transcripts(spark, args, want):
    verdict = value(spark, recognition.transcript_verdict(*[F.lit(a) for a in args]))
    assert (verdict["text"], verdict["note"]) == want


def test_wall_clock_seconds_follow_the_named_zone_only(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    noon = F.expr("TIMESTAMP_NTZ'2024-07-01 12:00:00.75'")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert value(spark, times.ntz_seconds(noon)) == 1719835200
            assert value(spark, times.wall_clock_seconds(noon, "Europe/Berlin")) == 1719828000
            back = times.seconds_ntz(F.lit(1719828000), "Europe/Berlin")
            assert value(spark, F.date_format(back, "yyyy-MM-dd HH:mm:ss")) == "2024-07-01 12:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
