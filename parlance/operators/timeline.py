"""Message pages, rendering, filters and search over the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.media import PHOTO
from parlance.functions.text import contains_ci
from parlance.functions.times import local_day
from parlance.model import (
    AROUND_AFTER, AROUND_BEFORE, MISSING_ATTACHMENT_LABEL, PAGE_DEFAULT, PAGE_MAX, VISIBLE_MEDIA_STATUS,
)
from parlance.operators import text_index
from parlance.operators.ordered import first_per_group, previous_row
from parlance.session import materialise

UNKNOWN_SENDER = "?"


def visible(messages: DataFrame) -> DataFrame:
    """Messages whose media are complete or absent."""
    return messages.filter(F.col("media_status").isin(*VISIBLE_MEDIA_STATUS))


def of_chat(df: DataFrame, chats: DataFrame, slug: str) -> DataFrame:
    """Rows of one chat, found by its slug."""
    return df.join(chats.filter(F.col("slug") == slug).select(F.col("id").alias("chat_id")), "chat_id", "left_semi")


def clamp_page(limit: int | None) -> int:
    return max(1, min(PAGE_DEFAULT if limit is None else int(limit), PAGE_MAX))


def with_sender(messages: DataFrame, persons: DataFrame) -> DataFrame:
    """Add ``sender`` and ``sender_avatar``; an unknown sender shows as '?'."""
    who = persons.select(F.col("id").alias("sender_person_id"), F.col("display_name").alias("_name"),
                         F.col("avatar_src").alias("sender_avatar"))
    return (
        messages.join(who, "sender_person_id", "left")
        .withColumn("sender", F.coalesce("_name", F.lit(UNKNOWN_SENDER)))
        .drop("_name")
    )


def render_rows(messages: DataFrame, persons: DataFrame, media: DataFrame) -> DataFrame:
    """Visible messages with sender, one row per present media item (or one row without any).

    ``missing_media`` counts the message's media rows without a file. The relation stays flat, so a
    message with any number of attachments never becomes one oversized row.
    """
    rows = with_sender(visible(messages), persons)
    missing = (
        media.filter(F.col("src").isNull()).groupBy(F.col("message_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("missing_media"))
    )
    items = media.filter(F.col("src").isNotNull()).select(
        F.col("message_id").alias("id"), F.col("id").alias("media_id"), "kind", "src", "cat", "portrait")
    return (
        rows.join(missing, "id", "left").join(items, "id", "left")
        .withColumn("missing_media", F.coalesce("missing_media", F.lit(0)))
        .withColumn("apps", F.coalesce("apps", F.array().cast("array<string>")))
    )


def render_page(page: DataFrame, persons: DataFrame, media: DataFrame) -> DataFrame:
    """A page of messages (at most a few hundred) as nested records, empty fields left out of the JSON."""
    items = media.join(page.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    lists = items.groupBy(F.col("message_id").alias("id")).agg(
        F.count_if(F.col("src").isNull()).alias("_missing"),
        F.array_sort(F.collect_list(F.when(
            F.col("src").isNotNull(),
            F.struct(F.col("id").alias("media_id"), "kind", "src", "cat",
                     F.when(F.col("portrait"), F.lit(True)).alias("portrait"))))).alias("_media"),
    )
    absent = F.array_repeat(F.lit(MISSING_ATTACHMENT_LABEL), F.coalesce("_missing", F.lit(0)).cast("int"))
    apps = F.concat(F.coalesce("apps", F.array().cast("array<string>")), absent)
    shown = F.transform("_media", lambda m: m.dropFields("media_id"))
    return with_sender(page, persons).join(lists, "id", "left").select(
        "id", "chat_id", "ts",
        F.to_json(F.struct(
            F.lit("msg").alias("t"), "ts", F.col("is_me").alias("me"), "sender", "text",
            "sender_avatar", _filled("edits").alias("edits"), _filled("reactions").alias("reactions"),
            F.when(F.size(apps) > 0, apps).alias("apps"),
            F.when(F.col("retracted"), F.lit(True)).alias("retracted"),
            F.when(F.size(shown) > 0, shown).alias("media"),
        )).alias("record"),
    )


def _filled(name: str) -> Column:
    return F.when(F.size(name) > 0, F.col(name))


def edited(messages: DataFrame, min_versions: int = 0) -> DataFrame:
    """Visible messages with an edit history; ``min_versions=2`` asks for a real change."""
    rows = visible(messages).filter(F.col("edits").isNotNull())
    return rows.filter(F.size("edits") >= min_versions) if min_versions else rows


def edited_totals(messages: DataFrame) -> DataFrame:
    return edited(messages).groupBy("chat_id").agg(F.count(F.lit(1)).alias("total"))


# --- pages --------------------------------------------------------------------------------------


def latest(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest messages of every chat with ``has_more``."""
    n = clamp_page(limit)
    page = first_per_group(visible(messages), ["chat_id"], [F.desc("ts"), F.desc("id")], n, "id")
    return _has_more(page, n)


def before(messages: DataFrame, ts: int, limit: int | None = None, message_id: int | None = None) -> DataFrame:
    """Newest messages older than ``ts``; with ``message_id`` rows tied at the page edge are kept apart."""
    n = clamp_page(limit)
    older = F.col("ts") < ts
    if message_id is not None:
        older = older | ((F.col("ts") == ts) & (F.col("id") < message_id))
    page = first_per_group(visible(messages).filter(older), ["chat_id"], [F.desc("ts"), F.desc("id")], n, "id")
    return _has_more(page, n)


def since(messages: DataFrame, ts: int, limit: int | None = PAGE_MAX, message_id: int | None = None) -> DataFrame:
    """Oldest messages newer than ``ts``."""
    newer = F.col("ts") > ts
    if message_id is not None:
        newer = newer | ((F.col("ts") == ts) & (F.col("id") > message_id))
    return first_per_group(visible(messages).filter(newer), ["chat_id"], [F.asc("ts"), F.asc("id")],
                           clamp_page(limit), "id")


def around(messages: DataFrame, ts: int, n_before: int = AROUND_BEFORE, n_after: int = AROUND_AFTER) -> DataFrame:
    """Messages on both sides of a moment."""
    shown = visible(messages)
    n_before, n_after = max(0, min(int(n_before), PAGE_MAX)), max(1, min(int(n_after), PAGE_MAX))
    newer = first_per_group(shown.filter(F.col("ts") >= ts), ["chat_id"], [F.asc("ts"), F.asc("id")], n_after, "id")
    if not n_before:
        return newer
    older = first_per_group(shown.filter(F.col("ts") < ts), ["chat_id"], [F.desc("ts"), F.desc("id")], n_before, "id")
    return older.unionByName(newer)


def _has_more(page: DataFrame, n: int) -> DataFrame:
    return page.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy("chat_id")) == n)


def first_messages(canonical: DataFrame, limit: int) -> DataFrame:
    """First messages of every source chat, in time order, for a trial import."""
    return first_per_group(canonical, ["source", "chat_external_id"],
                           [F.asc("ts"), F.asc("external_id")], limit, "external_id")


# --- media lists ---------------------------------------------------------------------------------


def media_timeline(messages: DataFrame, media: DataFrame, persons: DataFrame) -> DataFrame:
    """Every present media item of a visible message with sender, time and caption."""
    rows = with_sender(visible(messages), persons).select(
        F.col("id").alias("message_id"), "chat_id", "ts", "is_me", "sender", F.col("text").alias("caption"))
    items = media.filter(F.col("src").isNotNull()).select(
        "message_id", F.col("id").alias("media_id"), "kind", "src", "cat", "portrait")
    return items.join(rows, "message_id")


def with_recognition(media: DataFrame, transcripts: DataFrame, ocr: DataFrame) -> DataFrame:
    """Add transcript text, image text and the screenshot flag by file."""
    spoken = transcripts.select("src", _text_or_null("text").alias("transcript"))
    read = ocr.select("src", _text_or_null("text").alias("image_text"), "is_screenshot")
    return (
        media.join(spoken, "src", "left").join(read, "src", "left")
        .withColumn("is_screenshot", F.coalesce("is_screenshot", F.lit(False)))
    )


def _text_or_null(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def filter_media(items: DataFrame, kind: str, categories: tuple[str, ...] = (PHOTO,), sender: str | None = None,
                 screenshots_only: bool = False) -> DataFrame:
    """One media tab: images by category (photographs unless asked otherwise), any kind by sender."""
    rows = items.filter(F.col("kind") == kind)
    if kind == "image":
        rows = rows.filter(F.coalesce("cat", F.lit(PHOTO)).isin(*categories))
        if screenshots_only:
            rows = rows.filter("is_screenshot")
    return rows if sender is None else rows.filter(F.col("sender") == sender)


def sender_facets(items: DataFrame) -> DataFrame:
    """Items per chat, kind and sender, where at least two senders share the list."""
    counts = items.groupBy("chat_id", "kind", "sender").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.groupBy("chat_id", "kind").agg(F.count(F.lit(1)).alias("_senders")).filter("_senders >= 2")
    return counts.join(shared.drop("_senders"), ["chat_id", "kind"], "left_semi")


# --- day groups and search -------------------------------------------------------------------------


def day_groups(messages: DataFrame, chats: DataFrame, persons: DataFrame, zone: str = "UTC") -> DataFrame:
    """Day breaks, alternating day tone and sender headers of group chats.

    The previous sender never reaches across a day, so rows are ordered per chat, day and hour; the
    tone is ranked on the distinct days.
    """
    shown = visible(messages).withColumn("day", local_day(F.col("ts"), zone))
    rows = with_sender(shown, persons).join(chats.select(F.col("id").alias("chat_id"), "is_group"), "chat_id")
    marked = previous_row(rows, ["chat_id", "day"], F.floor(F.col("ts") / 3600), ["ts", "id"],
                          ["is_me", "sender"], "_prev")
    changed = F.col("_prev").isNull() | F.col("_prev.is_me") | (F.col("_prev.sender") != F.col("sender"))
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy("day"))
    tones = shown.select("chat_id", "day").distinct().withColumn("tone", F.when(rank % 2 == 1, "a").otherwise("b"))
    return (
        marked.withColumn("day_break", F.col("_prev").isNull())
        .withColumn("sender_header", F.col("is_group") & ~F.col("is_me") & changed)
        .join(tones, ["chat_id", "day"]).drop("_prev")
    )


def search(messages: DataFrame, media: DataFrame, transcripts: DataFrame, ocr: DataFrame, needle: str,
           regex: bool = False) -> DataFrame:
    """Hits in message text, transcripts and image text, by case-insensitive substring or pattern."""
    def hit(c: Column) -> Column:
        return c.rlike(f"(?i){needle}") if regex else contains_ci(c, needle)

    shown = visible(messages)
    in_text = shown.filter(hit(F.col("text"))).select(
        "chat_id", F.col("id").alias("message_id"), "ts", F.lit("text").alias("found_in"),
        F.lit(None).cast("string").alias("src"))
    spoken = transcripts.filter(hit(F.col("text"))).select("src", F.lit("transcript").alias("found_in"))
    read = ocr.filter(hit(F.col("text"))).select("src", F.lit("image").alias("found_in"))
    return in_text.unionByName(_in_files(shown, media, spoken.unionByName(read)))


def _in_files(shown: DataFrame, media: DataFrame, found: DataFrame) -> DataFrame:
    files = media.join(found, "src").select("message_id", "src", "found_in").distinct()
    return files.join(shown.select(F.col("id").alias("message_id"), "chat_id", "ts"), "message_id").select(
        "chat_id", "message_id", "ts", "found_in", "src")


def index_texts(messages: DataFrame, transcripts: DataFrame, ocr: DataFrame) -> DataFrame:
    """What ``search`` looks through, for ``text_index.add_batch``: message texts by id, recognised ones by file."""
    def texts(rows: DataFrame, kind: str, key: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "text")

    return texts(messages, "text", "id").unionByName(texts(transcripts, "transcript", "src")).unionByName(texts(ocr, "image", "src"))


def indexed_search(messages: DataFrame, media: DataFrame, root: str, needle: str, regex: bool = False) -> DataFrame:
    """``search`` by a trigram index: the messages' own texts are not read."""
    hits = materialise(text_index.search(messages.sparkSession, root, needle, regex).hits, "hits")
    shown = visible(messages)
    own = hits.filter("kind = 'text'").select(F.col("key").cast("bigint").alias("id"))
    in_text = shown.join(own, "id", "left_semi").select(
        "chat_id", F.col("id").alias("message_id"), "ts", F.lit("text").alias("found_in"), F.lit(None).cast("string").alias("src"))
    return in_text.unionByName(_in_files(shown, media, hits.filter("kind <> 'text'").select(F.col("key").alias("src"), F.col("kind").alias("found_in"))))
