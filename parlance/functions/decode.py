"""Arrow UDFs for the two binary vendor encodings no built-in function reads."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.times import VENDOR_EPOCH
from parlance.model import HISTORY_TYPE

# Fixed values of the typed-stream format: class name, string marker, and the bytes of a length field
# that follow each length tag (any other tag is the length itself).
STRING_CLASS, STRING_MARK = b"NSString", b"+"
LENGTH_BYTES = {0x80: 1, 0x81: 2, 0x82: 4}


def typed_stream_text(blob: bytes | None) -> str:
    """First string of a typed-stream blob, '' when there is none."""
    data = bytes(blob or b"")
    start = data.find(STRING_CLASS)
    mark = data.find(STRING_MARK, start) if start >= 0 else -1
    tag_at = mark + 1
    if mark < 0 or tag_at >= len(data):
        return ""
    width = LENGTH_BYTES.get(data[tag_at], 0)
    body_at = tag_at + 1 + width
    if width:
        length = int.from_bytes(data[tag_at + 1:body_at], "little")
    else:
        length = data[tag_at]
    text = data[body_at:body_at + length].decode("utf-8", errors="replace")
    return text.translate({0xFFFC: None, 0xFFFD: None}).strip()


def edit_versions(blob: bytes | None) -> tuple[list[dict], str | None]:
    """Distinct consecutive versions of an edited message, and the error class of an unusable blob.

    A blob that is not a property list carries no history; one whose parts have an unexpected shape is
    reported, so that the row can be put aside.
    """
    if not blob:
        return [], None
    try:
        parts = plistlib.loads(bytes(blob)).get("ec")
    except Exception:
        return [], None
    if not isinstance(parts, dict):
        return [], None
    found: list[dict] = []
    try:
        for name in sorted(parts):
            for entry in parts[name]:
                version = _version(entry) if isinstance(entry, dict) else None
                if version and (not found or found[-1]["text"] != version["text"]):
                    found.append(version)
    except Exception as problem:
        return [], type(problem).__name__
    return (found if len({v["text"] for v in found}) > 1 else []), None


def _version(entry: dict) -> dict | None:
    raw, when = entry.get("t"), entry.get("d")
    if isinstance(raw, (bytes, bytearray)):
        text = typed_stream_text(raw)
    else:
        text = (raw or "").translate({0xFFFC: None, 0xFFFD: None}).strip()
    if not text:
        return None
    timed = isinstance(when, (int, float)) and bool(when) and when == when and abs(when) != float("inf")
    return {"text": text, "ts": int(when + VENDOR_EPOCH) if timed else None}


def _texts(blobs: pd.Series) -> pd.Series:
    return blobs.map(typed_stream_text)


def _histories(blobs: pd.Series) -> pd.DataFrame:
    parsed = [edit_versions(b) for b in blobs]
    return pd.DataFrame({"edits": [p[0] for p in parsed], "error": [p[1] for p in parsed]})


# Declared non-deterministic so that a filter on a decoded value does not make Spark decode it twice.
attributed_text = F.pandas_udf(_texts, T.StringType()).asNondeterministic()
edit_history = F.pandas_udf(_histories, HISTORY_TYPE).asNondeterministic()
