"""Text exports: header lines, message assembly, classification and format probes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.media import MIME_BY_EXTENSION, split_extension
from parlance.functions.text import choose, empty_to_null, strip, strip_invisible
from parlance.functions.times import wall_clock_seconds
from parlance.model import ATTACHMENT, EDIT, REACTION
from parlance.operators.ordered import running_total

SOURCE, CONTRACT_VERSION = "whatsapp_export", 1
CHUNK_BYTES = 4 * 1024 * 1024
SEPARATOR = "\u001f"
HEAD_LINES = 50


@dataclass(frozen=True)
class HeaderFormat:
    """A header line: its pattern and where year, month, day, hour, minute, second, AM/PM, sender and
    text are among the groups ('0' where a format has no such part)."""

    key: str
    pattern: str
    groups: tuple[str, ...]


# The four header formats, tried in this order.
FORMATS = (
    HeaderFormat(
        "bracket_dd_mm_yy_24h",
        r"^\[([0-9]{2})\.([0-9]{2})\.([0-9]{2}),\s*([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s([^:]+?):\s?(.*)$",
        ("$3", "$2", "$1", "$4", "$5", "$6", "", "$7", "$8")),
    HeaderFormat(
        "bracket_mdy_12h",
        r"^\[([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4}),\s*([0-9]{1,2}):([0-9]{2}):([0-9]{2})\s*([AaPp][Mm])\]\s([^:]+?):\s?(.*)$",
        ("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9")),
    HeaderFormat(
        "bracket_dmy_24h_slash",
        r"^\[([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}),\s*([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s([^:]+?):\s?(.*)$",
        ("$3", "$2", "$1", "$4", "$5", "$6", "", "$7", "$8")),
    HeaderFormat(
        "nobracket_mdy_12h_dash",
        r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4}),\s*([0-9]{1,2}):([0-9]{2})\s*([AaPp][Mm])?\s*-\s([^:]+?):\s?(.*)$",
        ("$3", "$1", "$2", "$4", "$5", "0", "$6", "$7", "$8")),
)
FLAGS = "(?dU)"
# A line that may be a header of any format starts with a date, behind one opening mark at most.
DAY_OR_MONTH, DATE_MARKS = "[0-9]{1,2}", ("[.]", "-", "/")
DATE_ORDERS = ((DAY_OR_MONTH, DAY_OR_MONTH, "(?:[0-9]{4}|[0-9]{2})"), ("[0-9]{4}", DAY_OR_MONTH, DAY_OR_MONTH))
DATE_LINE = r"^\p{Ps}?(?:" + "|".join(mark.join(order) for order in DATE_ORDERS for mark in DATE_MARKS) + ")(?![0-9])"
# An attachment in any language: a word, a colon and a file name, between angle brackets.
FILE_NAME = r"[^<>:]*[^<>:\s]\.[0-9A-Za-z]{2,4}"
NAMED_FILE = r"<\s*(\p{L}+)\s*:\s*" + FILE_NAME + r"\s*>"
# Attachment keywords and message markers by language.
ATTACHMENT_KEYWORDS = ["attached", "Anhang", "allegato", "adjunto", "bijlage"]
SYSTEM_MARKERS = [
    "Messages and calls are end-to-end encrypted",
    "Nachrichten und Anrufe sind Ende-zu-Ende-verschlüsselt",
]
DELETED_MARKERS = [
    "This message was deleted.",
    "You deleted this message.",
    "Diese Nachricht wurde gelöscht.",
    "Du hast diese Nachricht gelöscht.",
]
APP_MARKERS = [
    "Missed voice call", "Missed video call",
    "Verpasster Sprachanruf", "Verpasster Videoanruf",
    "Voice call", "Video call",
]
ATTACHMENT_MARK = r"(?iU)<\s*(?:" + "|".join(ATTACHMENT_KEYWORDS) + r")\s*:\s*([^>]+)>"


def export_source() -> Column:
    """Every folder is a source of its own: its messages are numbered from 1, and its faults stop no other folder."""
    return F.concat(F.lit(f"{SOURCE}:"), "folder")


def header_format(line: Column) -> Column:
    """Key of the first format a line matches, NULL for other lines."""
    out = None
    for f in FORMATS:
        hit = line.rlike(FLAGS + f.pattern)
        out = F.when(hit, F.lit(f.key)) if out is None else out.when(hit, F.lit(f.key))
    return out


def header_parts(line: Column, key: Column) -> Column:
    """Nine header parts of a line in a known format: one pattern pass, then a split."""
    out = None
    for f in FORMATS:
        joined = F.regexp_replace(line, FLAGS + f.pattern, SEPARATOR.join(f.groups))
        parts = F.split(joined, SEPARATOR, len(f.groups))
        out = F.when(key == f.key, parts) if out is None else out.when(key == f.key, parts)
    return out


def header_time(parts: Column, zone: str = "UTC") -> Column:
    """Unix second of header parts, NULL for an impossible date."""
    def number(k: int) -> Column:
        return parts[k].cast("int")

    year = number(0)
    half = F.upper(parts[6])
    hour = F.when(half == "", number(3)).otherwise(number(3) % 12 + F.when(half == "PM", 12).otherwise(0))
    ntz = F.try_make_timestamp_ntz(F.when(year < 100, year + 2000).otherwise(year), number(1), number(2), hour,
                                   number(4), number(5).cast("decimal(8,6)"))
    return wall_clock_seconds(ntz, zone)


def parse_lines(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add ``header`` (format key), and for header lines ``ts``, ``sender`` and ``line`` without its header."""
    clean = lines.withColumn("line", strip_invisible(F.col("line")))
    keyed = clean.withColumn("header", header_format(F.col("line")))
    split = keyed.withColumn("_parts", header_parts(F.col("line"), F.col("header")))
    return split.withColumns({
        "ts": F.when(F.col("header").isNotNull(), header_time(F.col("_parts"), zone)),
        "sender": strip(F.col("_parts")[7]),
        "line": F.coalesce(F.col("_parts")[8], F.col("line")),
    }).drop("_parts")


def assemble(parsed: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Messages of each folder: a header line and the lines up to the next one.

    The message number is a running count of headers, taken per file chunk, so that one very long chat
    is numbered by many tasks. Lines in front of the first header belong to no message.
    """
    numbered = running_total(parsed, ["folder"], F.floor(F.col("pos") / chunk_bytes), ["pos"],
                             F.when(F.col("header").isNotNull(), 1).otherwise(0), "message_no")
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return (
        numbered.filter("message_no > 0").groupBy("folder", "message_no")
        .agg(F.max("ts").alias("ts"), F.max("sender").alias("sender"), F.max("header").alias("header"),
             F.min("pos").alias("pos"), lines.alias("_lines"))
        .withColumn("body", strip(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")))
        .drop("_lines")
    )


def _any(markers: list[str], test) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | test(F.lit(marker))
    return out


def classify(messages: DataFrame, me_name: str | Column) -> DataFrame:
    """Canonical rows of assembled export messages: system notices go, the rest gets its kind."""
    body = F.col("body")
    me = F.lit(me_name) if isinstance(me_name, str) else me_name
    names = F.transform(F.regexp_extract_all(body, F.lit(ATTACHMENT_MARK), F.lit(1)), strip)
    deleted = _any(DELETED_MARKERS, body.startswith)
    kept = messages.filter(~_any(SYSTEM_MARKERS, body.contains) & F.col("ts").isNotNull()).withColumns(
        {"_deleted": deleted, "_names": F.when(~deleted, names).otherwise(F.array().cast("array<string>"))})
    with_files = F.size("_names") > 0
    app = ~F.col("_deleted") & ~with_files & body.isin(APP_MARKERS)
    text = (
        F.when(F.col("_deleted") | app, F.lit(None).cast("string"))
        .when(with_files, empty_to_null(strip(F.regexp_replace(body, ATTACHMENT_MARK, ""))))
        .otherwise(empty_to_null(body))
    )
    files = F.transform("_names", lambda n: F.struct(
        n.alias("source_ref"), F.coalesce(choose(F.lower(split_extension(n)), MIME_BY_EXTENSION), F.lit("")).alias("mime"),
        n.alias("filename"), F.lit(False).alias("is_sticker"), F.lit("").alias("emoji_desc")))
    return kept.select(
        export_source().alias("source"), F.col("folder").alias("chat_external_id"), F.col("message_no").cast("string").alias("external_id"),
        "ts", F.col("sender").alias("sender_raw"), (F.col("sender") == me).alias("is_me"), text.alias("text"),
        F.col("_deleted").alias("retracted"), F.array().cast(f"array<{EDIT}>").alias("edits"),
        F.array().cast(f"array<{REACTION}>").alias("reactions"),
        F.when(app, F.array(body)).otherwise(F.array().cast("array<string>")).alias("apps"),
        files.cast(f"array<{ATTACHMENT}>").alias("attachments"), "message_no")


def canonical(lines: DataFrame, me_name: str, zone: str = "UTC") -> DataFrame:
    """Export lines (folder, pos, line) to canonical rows."""
    return classify(assemble(parse_lines(lines, zone)), me_name)


# --- probes -----------------------------------------------------------------------------------------


def head_lines(lines: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    """The first non-empty lines of each folder; Spark limits the rank before the shuffle."""
    clean = lines.withColumn("line", strip_invisible(F.col("line"))).filter(F.col("line") != "")
    first = F.row_number().over(Window.partitionBy("folder").orderBy("pos"))
    return clean.withColumn("_k", first).filter(F.col("_k") <= n).drop("_k")


def probe_formats(lines: DataFrame, seen_at: int, n: int = HEAD_LINES) -> DataFrame:
    """One event per folder that has header-like lines in no known format (fatal), and one per folder
    with an attachment keyword of an unknown language (warn). ``source`` names the folder."""
    head = head_lines(lines, n)
    like = F.col("line").rlike(DATE_LINE)
    shape = head.groupBy("folder").agg(
        F.bool_or(like).alias("_like"), F.bool_or(header_format(F.col("line")).isNotNull()).alias("_known"),
        F.min_by(F.when(like, F.substring("line", 1, 60)), F.when(like, F.col("pos"))).alias("_sample"))
    unknown = shape.filter(F.col("_like") & ~F.col("_known")).select(
        "folder", F.lit("fatal").alias("severity"), F.lit("unknown_export_format").alias("kind"),
        F.col("_sample").alias("observed"),
        F.lit("one of [" + ", ".join(f.key for f in FORMATS) + "]").alias("expected"))
    word = F.regexp_extract("line", "(?U)" + NAMED_FILE, 1)
    known = F.lower(word).isin([k.lower() for k in ATTACHMENT_KEYWORDS])
    strange = head.filter((word != "") & ~known).groupBy("folder").agg(F.min_by(word, "pos").alias("observed"))
    locale = strange.select(
        "folder", F.lit("warn").alias("severity"), F.lit("unknown_export_locale").alias("kind"), "observed",
        F.lit("one of [" + ", ".join(sorted(ATTACHMENT_KEYWORDS)) + "]").alias("expected"))
    return unknown.unionByName(locale).select(
        export_source().alias("source"), F.lit(CONTRACT_VERSION).alias("schema_version"), "severity", "kind",
        F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("column_name"), "observed",
        "expected", F.concat(F.lit("export folder "), "folder").alias("detail"), F.lit(seen_at).cast("bigint").alias("seen_at"),
        "folder")


def parse_failures(assembled: DataFrame, seen_at: int) -> DataFrame:
    """Assembled messages whose header carries an impossible date."""
    from parlance.operators.drift import parse_failures as failures

    rows = assembled.withColumn("source", export_source())
    error = F.when(F.col("ts").isNull(), "ValueError")
    return failures(rows, CONTRACT_VERSION, "_chat.txt", error, F.concat(F.lit("header date in "), "folder"), seen_at)
