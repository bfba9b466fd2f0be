"""Fixed vendor labels as Column lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import choose

# Tapback type, emoji and label. Type + 1000 takes the reaction back.
TAPBACKS = {
    2000: ("❤️", "loved"),
    2001: ("👍", "liked"),
    2002: ("👎", "disliked"),
    2003: ("😂", "laughed at"),
    2004: ("‼️", "emphasized"),
    2005: ("❓", "questioned"),
}
TAPBACK_REMOVE = 1000

# Balloon bundle fragment and label, first match wins.
BALLOONS = [
    ("URLBalloonProvider", "🔗 Shared link"),
    ("DigitalTouch", "✌️ Digital Touch"),
    ("Handwriting", "✍️ Handwriting"),
    ("AskToBuy", "💸 Purchase request"),
    ("ScreenTime", "⏱️ Screen Time request"),
    ("findmy", "📍 Location shared"),
    ("PhotosMessagesApp", "🖼️ Photo shared"),
    ("Music", "🎵 Music shared"),
]
ANY_CASE_BALLOON = "findmy"
OTHER_BALLOON = "📲 App message"


def tapback_emoji(kind: Column) -> Column:
    return choose(kind, {k: v[0] for k, v in TAPBACKS.items()})


def tapback_label(kind: Column) -> Column:
    return choose(kind, {k: v[1] for k, v in TAPBACKS.items()})


def is_tapback_add(kind: Column) -> Column:
    return kind.between(min(TAPBACKS), max(TAPBACKS))


def is_tapback_remove(kind: Column) -> Column:
    return kind.between(min(TAPBACKS) + TAPBACK_REMOVE, max(TAPBACKS) + TAPBACK_REMOVE)


def balloon_label(bundle: Column) -> Column:
    """Label of an app message, NULL when there is no bundle id."""
    out = F.when(F.coalesce(bundle, F.lit("")) == "", F.lit(None).cast("string"))
    for fragment, label in BALLOONS:
        subject = F.lower(bundle) if fragment == ANY_CASE_BALLOON else bundle
        out = out.when(subject.contains(fragment), F.lit(label))
    return out.otherwise(F.lit(OTHER_BALLOON))
