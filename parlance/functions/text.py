"""Text expressions: cleaning, normalising, tokenising, short display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as text editors and scripts understand it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Delete object-replacement and replacement characters, then strip; NULL becomes ''."""
    bare = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("￼")), F.lit("�"))
    return strip(bare)


def strip_invisible(c: Column) -> Column:
    """Delete format control characters (Unicode category Cf)."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def norm_handle(c: Column) -> Column:
    """Phone numbers lose spaces and hyphens, everything is stripped and lower-cased."""
    stripped = strip(c)
    phone = stripped.rlike(r"\p{Nd}") & ~stripped.contains("@")
    return F.lower(F.when(phone, F.translate(stripped, " -", "")).otherwise(stripped))


def norm_name(c: Column) -> Column:
    """Lower case with single spaces."""
    return strip(F.regexp_replace(F.lower(c), f"[{SPACE_CLASS}]+", " "))


def initials(title: Column) -> Column:
    """Two letters of a list entry: text in parentheses and leading symbols do not count."""
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r"\([^)]*\)", " ")
    letters = F.transform(F.split(base, r"\s+"), lambda w: F.regexp_extract(w, r"[\p{L}\p{N}]", 0))
    return _two(F.filter(letters, lambda x: x != ""))


def avatar_initials(title: Column) -> Column:
    """Two letters of a chat header: the first character of the first two pieces."""
    pieces = F.slice(F.split(F.coalesce(title, F.lit("")), r"\s+"), 1, 2)
    return F.upper(F.array_join(F.transform(pieces, lambda w: F.substring(w, 1, 1)), ""))


def _two(letters: Column) -> Column:
    return F.upper(F.array_join(F.slice(letters, 1, 2), ""))


def first_name(name: Column) -> Column:
    return F.regexp_extract(strip(F.coalesce(name, F.lit(""))), r"^\S+", 0)


def tokens(c: Column) -> Column:
    """Alternating runs of white space and of other characters, losing nothing."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{SPACE_CLASS}]+|[^{SPACE_CLASS}]+"), F.lit(0))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"https?://[^{SPACE_CLASS}]+"), F.lit(0))


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))


def human_bytes(b: Column, decimal_mark: str = ".") -> Column:
    """1.5 GB, 12 MB, 3 KB or 17 B."""
    n = F.coalesce(b.cast("double"), F.lit(0.0))
    gb = F.format_string("%.1f GB", n / 1073741824)
    return (
        F.when(n >= 1073741824, F.replace(gb, F.lit("."), F.lit(decimal_mark)))
        .when(n >= 1048576, F.format_string("%d MB", F.floor(n / 1048576 + 0.5)))
        .when(n >= 1024, F.format_string("%d KB", F.floor(n / 1024 + 0.5)))
        .otherwise(F.format_string("%d B", n.cast("bigint")))
    )


def duration_text(seconds: Column) -> Column:
    """12s, 1m 7s or 1h 10m."""
    s = F.greatest(F.bround(seconds.cast("double"), 0).cast("bigint"), F.lit(0))
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def player_time(seconds: Column) -> Column:
    """m:ss as an audio player shows it."""
    s = F.floor(F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def extension(path: Column) -> Column:
    """Lower-case extension without dot and query part, '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)(?:\?.*)?$", 1))


# Labels of viewable file types.
FILE_LABELS = {"pdf": "PDF document", "vcf": "Contact / location", "watchface": "Watch face"}
OTHER_FILE_LABEL = "File"

# Display names of message services.
SERVICE_NAMES = {"apple": "iMessage", "whatsapp": "WhatsApp", "signal": "Signal", "sms": "SMS / Android"}
DEFAULT_SERVICE = "iMessage"


def choose(c: Column, table: dict, default: Column | str | None = None) -> Column:
    """Look a value up in a small fixed table."""
    out = None
    for key, value in table.items():
        out = F.when(c == F.lit(key), F.lit(value)) if out is None else out.when(c == F.lit(key), F.lit(value))
    if default is None:
        return out
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def file_label(path: Column) -> Column:
    return choose(extension(path), FILE_LABELS, OTHER_FILE_LABEL)


def service_name(origin: Column) -> Column:
    return choose(origin, SERVICE_NAMES, DEFAULT_SERVICE)


def day_span(first: Column, last: Column) -> Column:
    """Number of days a conversation covers, counted by rounded 24-hour steps."""
    return (F.floor((last - first) / 86400.0 + 0.5) + 1).cast("bigint")
