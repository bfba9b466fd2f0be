"""JSON text of the nested message columns, as older archives store them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.model import EDIT, REACTION


def decode_edits(c: Column) -> Column:
    return F.from_json(c, f"array<{EDIT}>")


def decode_reactions(c: Column) -> Column:
    return F.from_json(c, f"array<{REACTION}>")


def decode_apps(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def encode(c: Column) -> Column:
    """JSON text, NULL for an empty or missing list; NULL fields are written."""
    return F.when(F.size(c) > 0, F.to_json(c, {"ignoreNullFields": "false"}))
