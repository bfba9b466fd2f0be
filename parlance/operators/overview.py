"""Aggregates over the archive: chat overview, media statistics, calendars, counts and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.times import local_day
from parlance.model import APPLE_LIVE_PREFIX, MEDIA_KINDS, VISIBLE_MEDIA_STATUS
from parlance.operators.joins import dealt
from parlance.operators.timeline import visible

LIVE_DEVICE_TYPE = "mac_live"
DEFAULT_ME = "Me"


def count_rows() -> Column:
    return F.count(F.lit(1))


def message_counts(messages: DataFrame) -> DataFrame:
    """Per chat: total, me, them, first, last and new over visible messages."""
    return (
        visible(messages).groupBy("chat_id")
        .agg(count_rows().alias("total"), F.count_if("is_me").alias("me"),
             F.min("ts").alias("first"), F.max("ts").alias("last"),
             F.count_if(F.col("sync_state") == "new").alias("new_count"))
        .withColumn("them", F.col("total") - F.col("me"))
    )


def media_counts(messages: DataFrame, media: DataFrame) -> DataFrame:
    """Per chat, kind and direction: files and bytes, over all messages.

    Media are counted per message first, so that neither a message with very many files nor a chat
    with very many messages meets the join row by row. They are dealt by message and file for that, so
    that no task counts more than its share.
    """
    kind = F.when(F.col("kind").isin(*MEDIA_KINDS), F.col("kind")).otherwise("other")
    per_message = (
        dealt(media.filter(F.col("src").isNotNull()).select("message_id", "kind", "src", "bytes"), "message_id", "src")
        .groupBy("message_id", kind.alias("kind"))
        .agg(count_rows().alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    )
    owners = messages.select(F.col("id").alias("message_id"), "chat_id", "is_me")
    return (
        dealt(per_message, "message_id").join(owners, "message_id")
        .groupBy("chat_id", "kind", "is_me").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    )


def media_stats(messages: DataFrame, media: DataFrame) -> DataFrame:
    """Per chat, one column for each kind and direction, bytes per kind and in total."""
    counts = media_counts(messages, media)
    columns = []
    for kind in MEDIA_KINDS:
        of_kind = F.col("kind") == kind
        columns += [_sum_if(of_kind & F.col("is_me"), "n", f"{kind}_me"),
                    _sum_if(of_kind & ~F.col("is_me"), "n", f"{kind}_them"),
                    _sum_if(of_kind, "bytes", f"{kind}_bytes")]
    return counts.groupBy("chat_id").agg(*columns, F.sum("bytes").alias("bytes_total"))


def _sum_if(condition: Column, name: str, alias: str) -> Column:
    return F.sum(F.when(condition, F.col(name)).otherwise(0)).alias(alias)


MEDIA_COLUMNS = [f"{k}_{part}" for k in MEDIA_KINDS for part in ("me", "them", "bytes")] + ["bytes_total"]


def counterpart_avatars(messages: DataFrame, chats: DataFrame, persons: DataFrame) -> DataFrame:
    """Avatar of the busiest other sender of each direct chat who has one; ties go to the lowest id."""
    sent = (
        messages.filter(~F.col("is_me") & F.col("sender_person_id").isNotNull())
        .groupBy("chat_id", "sender_person_id").agg(count_rows().alias("n"))
    )
    faces = persons.filter(F.col("avatar_src").isNotNull()).select(
        F.col("id").alias("sender_person_id"), "avatar_src")
    direct = chats.filter(~F.col("is_group")).select(F.col("id").alias("chat_id"))
    return (
        sent.join(direct, "chat_id", "left_semi").join(faces, "sender_person_id")
        .groupBy("chat_id")
        .agg(F.max_by("avatar_src", F.struct("n", -F.col("sender_person_id"))).alias("chat_avatar"))
    )


def chat_activity(messages: DataFrame, persons: DataFrame) -> DataFrame:
    """Message counts and counterpart avatar of every chat in one pass over the messages.

    Messages are counted per chat and sender first; names and chats meet these few rows only.
    """
    shown = F.col("media_status").isin(*VISIBLE_MEDIA_STATUS)
    by_sender = messages.groupBy("chat_id", "sender_person_id").agg(
        F.count_if(shown).alias("total"), F.count_if(shown & F.col("is_me")).alias("me"),
        F.min(F.when(shown, F.col("ts"))).alias("first"), F.max(F.when(shown, F.col("ts"))).alias("last"),
        F.count_if(shown & (F.col("sync_state") == "new")).alias("new_count"), F.count_if(~F.col("is_me")).alias("_sent"))
    faces = persons.filter(F.col("avatar_src").isNotNull()).select(
        F.col("id").alias("sender_person_id"), "avatar_src")
    candidate = F.when(F.col("avatar_src").isNotNull() & (F.col("_sent") > 0), F.struct("_sent", -F.col("sender_person_id")))
    return (
        by_sender.join(faces, "sender_person_id", "left").groupBy("chat_id")
        .agg(*[F.sum(c).alias(c) for c in ("total", "me", "new_count")], F.min("first").alias("first"), F.max("last").alias("last"),
             F.max_by("avatar_src", candidate).alias("chat_avatar"))
        .withColumn("them", F.col("total") - F.col("me"))
    )


def live_chats(chats: DataFrame, devices: DataFrame, chat_sources: DataFrame) -> DataFrame:
    """Chats of a live device that have a live anchor."""
    live_device = devices.filter(F.col("type") == LIVE_DEVICE_TYPE).select(F.col("id").alias("device_id"))
    anchored = chat_sources.filter(F.col("source").startswith(APPLE_LIVE_PREFIX)).select(F.col("chat_id").alias("id"))
    return chats.join(live_device, "device_id", "left_semi").join(anchored, "id", "left_semi")


def with_owner(devices: DataFrame, persons: DataFrame) -> DataFrame:
    """Devices with the name and avatar of their owner."""
    owner = persons.select(F.col("id").alias("owner_person_id"), F.col("display_name").alias("owner_name"),
                           F.col("avatar_src").alias("owner_avatar"))
    return devices.join(owner, "owner_person_id", "left").withColumn(
        "me_name", F.coalesce("owner_name", F.lit(DEFAULT_ME)))


def chat_overview(chats: DataFrame, messages: DataFrame, media: DataFrame, devices: DataFrame, persons: DataFrame,
                  chat_sources: DataFrame) -> DataFrame:
    """One row per chat with counts, period, media statistics, avatar and the live flag."""
    owned = with_owner(devices, persons).select(
        F.col("id").alias("device_id"), F.col("name").alias("device"), F.col("slug").alias("device_slug"), "me_name")
    live = live_chats(chats, devices, chat_sources).select(F.col("id").alias("chat_id"), F.lit(True).alias("live"))
    rows = (
        chats.withColumnRenamed("id", "chat_id").join(owned, "device_id", "left")
        .join(chat_activity(messages, persons), "chat_id", "left")
        .join(media_stats(messages, media), "chat_id", "left")
        .join(live, "chat_id", "left")
        .withColumn("chat_avatar", F.when(~F.col("is_group"), F.col("chat_avatar")))
    )
    return rows.fillna(0, ["total", "me", "them", "new_count", *MEDIA_COLUMNS]).fillna(False, ["live"])


def chat_meta(overview: DataFrame, devices: DataFrame, persons: DataFrame, slug: str | None = None) -> DataFrame:
    """Overview rows of chats whose device has a known owner, with the owner's avatar."""
    owner = devices.join(
        persons.select(F.col("id").alias("owner_person_id"), F.col("avatar_src").alias("owner_avatar")),
        "owner_person_id").select(F.col("id").alias("device_id"), "owner_avatar")
    rows = overview if slug is None else overview.filter(F.col("slug") == slug)
    return rows.join(owner, "device_id")


def overview_totals(overview: DataFrame) -> DataFrame:
    """Chats, messages, images and bytes per device, and over all devices in one row without a name."""
    images = F.col("image_me") + F.col("image_them")
    return overview.rollup("device").agg(
        F.grouping("device").cast("int").alias("is_total"), count_rows().alias("chats"),
        F.sum("total").alias("messages"), F.sum(images).alias("images"), F.sum("bytes_total").alias("bytes"))


# --- calendars ------------------------------------------------------------------------------------


def day_counts(messages: DataFrame, zone: str = "UTC") -> DataFrame:
    """Visible messages per chat and local day."""
    return visible(messages).groupBy("chat_id", local_day(F.col("ts"), zone).alias("day")).agg(count_rows().alias("n"))


def heatmap(days: DataFrame) -> DataFrame:
    """Every day from first to last with its level 0-5 and its weekday (Monday = 0)."""
    spans = days.groupBy("chat_id").agg(F.min("day").alias("_first"), F.max("day").alias("_last"), F.max("n").alias("peak"))
    grid = spans.select("chat_id", "peak", F.explode(F.sequence("_first", "_last")).alias("day"))
    n = F.coalesce("n", F.lit(0))
    share = n / F.col("peak")
    level = (
        F.when(n == 0, 0).when(F.col("peak") <= 4, F.least(F.lit(5), n))
        .when(share <= 0.10, 1).when(share <= 0.25, 2).when(share <= 0.50, 3).when(share <= 0.75, 4).otherwise(5)
    )
    return grid.join(days, ["chat_id", "day"], "left").select(
        "chat_id", "day", n.alias("n"), level.cast("int").alias("level"), F.weekday("day").alias("weekday"))


def neighbour_days(days: DataFrame) -> DataFrame:
    """Previous and next active day of every active day."""
    along = Window.partitionBy("chat_id").orderBy("day")
    return days.withColumn("prev_day", F.lag("day").over(along)).withColumn("next_day", F.lead("day").over(along))


# --- counts and lists -------------------------------------------------------------------------------


def update_counts(messages: DataFrame) -> DataFrame:
    """Unread messages and newest time per chat that has any."""
    return messages.filter(F.col("sync_state") == "new").groupBy("chat_id").agg(
        count_rows().alias("new"), F.max("ts").alias("last"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(count_rows().alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def media_by_kind(media: DataFrame) -> DataFrame:
    return media.groupBy("kind").agg(count_rows().alias("n")).orderBy(F.desc("n"), "kind")


def chat_list(chats: DataFrame, messages: DataFrame, devices: DataFrame, device_slug: str | None = None) -> DataFrame:
    """Chats with the number of all their messages."""
    owners = devices.select(F.col("id").alias("device_id"), F.col("slug").alias("device"))
    if device_slug is not None:
        owners = owners.filter(F.col("device") == device_slug)
    counts = messages.groupBy("chat_id").agg(count_rows().alias("messages"))
    return (
        chats.withColumnRenamed("id", "chat_id").join(owners, "device_id").join(counts, "chat_id", "left")
        .fillna(0, ["messages"]).select("slug", "title", "origin", "device", "messages")
        .orderBy(F.desc("messages"), "slug")
    )


def device_list(devices: DataFrame, chats: DataFrame, persons: DataFrame) -> DataFrame:
    counts = chats.groupBy(F.col("device_id").alias("id")).agg(count_rows().alias("chats"))
    return (
        with_owner(devices, persons).join(counts, "id", "left").fillna(0, ["chats"])
        .select("slug", "name", "type", F.col("owner_name").alias("owner"), "chats").orderBy("slug")
    )


def person_list(persons: DataFrame, handles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Persons with the number of their handles and spellings, each counted before the join."""
    n_handles = handles.groupBy(F.col("person_id").alias("id")).agg(count_rows().alias("handles"))
    n_aliases = aliases.groupBy(F.col("person_id").alias("id")).agg(count_rows().alias("aliases"))
    return (
        persons.join(n_handles, "id", "left").join(n_aliases, "id", "left").fillna(0, ["handles", "aliases"])
        .select("id", F.col("display_name").alias("name"), "handles", "aliases",
                F.col("avatar_src").isNotNull().alias("has_avatar"))
        .orderBy(F.lower("name"), "id")
    )


def participants(messages: DataFrame, chats: DataFrame, devices: DataFrame) -> DataFrame:
    """Distinct senders of each chat and the owner of its device."""
    senders = messages.filter(F.col("sender_person_id").isNotNull()).select(
        "chat_id", F.col("sender_person_id").alias("person_id"))
    owners = chats.select(F.col("id").alias("chat_id"), "device_id").join(
        devices.select(F.col("id").alias("device_id"), F.col("owner_person_id").alias("person_id")), "device_id"
    ).drop("device_id").filter(F.col("person_id").isNotNull())
    return senders.distinct().unionByName(owners).distinct()


def recognition_summary(media: DataFrame, transcripts: DataFrame, ocr: DataFrame) -> DataFrame:
    """Audio and image files: total, done, open, with text, screenshots and errors."""
    return _summary(media, "audio", transcripts.select(
        "src", "text", "error", F.lit(False).alias("is_screenshot"))
    ).unionByName(_summary(media, "image", ocr.select("src", "text", "error", "is_screenshot")))


def _summary(media: DataFrame, kind: str, cache: DataFrame) -> DataFrame:
    files = media.filter((F.col("kind") == kind) & F.col("src").isNotNull()).select("src").distinct()
    seen = cache.withColumn("_done", F.lit(True))
    done = F.coalesce("_done", F.lit(False))
    return files.join(seen, "src", "left").agg(
        count_rows().alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("open"),
        F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"),
        F.count_if(F.coalesce("is_screenshot", F.lit(False))).alias("screenshots"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    ).select(F.lit(kind).alias("kind"), "total", "done", "open", "with_text", "screenshots", "errors")


def to_do(media: DataFrame, cache: DataFrame, kind: str) -> DataFrame:
    """Files of a kind that a recognition cache does not hold yet."""
    files = media.filter((F.col("kind") == kind) & F.col("src").isNotNull()).select("src").distinct()
    return files.join(cache.select("src"), "src", "left_anti")


def next_to_do(media: DataFrame, cache: DataFrame, kind: str, limit: int) -> DataFrame:
    """The first files of the work list in path order."""
    return to_do(media, cache, kind).orderBy("src").limit(limit)


def reaction_chips(messages: DataFrame) -> DataFrame:
    """One reaction per emoji and message, the first kept."""
    first = F.filter(
        F.transform("reactions", lambda r, k: F.struct(r.alias("r"), k.alias("k"))),
        lambda x: F.array_position(F.col("reactions.emoji"), x["r"]["emoji"]) == x["k"] + 1)
    return messages.filter(F.size("reactions") > 0).withColumn("chips", F.transform(first, lambda x: x["r"]))


def configured_order(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with a ``slug`` in the configured order (slug, position); unknown ones follow by slug."""
    return rows.join(order, "slug", "left").orderBy(F.col("position").asc_nulls_last(), "slug")
