"""Archive maintenance: incremental imports, replacement, media completion, purge and unread state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import media as media_rules
from parlance.operators import drift, identity, joins
from parlance.operators.ordered import number_rows
from parlance.session import materialise

MESSAGE_COLUMNS = ["id", "chat_id", "sender_person_id", "ts", "is_me", "text", "retracted", "edits", "reactions", "apps",
                   "media_status", "sync_state", "source", "external_id"]
PUBLISHED, NEW = "published", "new"


@dataclass
class Changes:
    """What one import adds to (``added``) and replaces in (``updated``, by id) each archive table."""

    added: dict[str, DataFrame] = field(default_factory=dict)
    updated: dict[str, DataFrame] = field(default_factory=dict)


def anchor_key() -> Column:
    """The anchor as text; rows without one go by chat, time, sender and content."""
    loose = F.to_json(F.struct("chat_external_id", "ts", "sender_raw", "text", "attachments"))
    return F.concat_ws("\u001f", "source", F.coalesce("external_id", loose))


MARKED = ("message", "chat")


def highest_id(archive: dict[str, DataFrame], name: str) -> Column:
    """Highest id a table has or ever had: ids of dropped rows are not given out again."""
    now = identity.next_id(archive[name])
    if "high_water" not in archive:
        return now
    return F.greatest(now, identity.next_id(archive["high_water"].filter(F.col("table_name") == name)))


def high_water(archive: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id): the highest ids so far, to be stored with an archive that rows are dropped from."""
    rows = None
    for name in MARKED:
        one = archive[name].agg(F.max("id").alias("id")).select(F.lit(name).alias("table_name"), "id")
        rows = one if rows is None else rows.unionByName(one)
    if "high_water" in archive:
        rows = rows.unionByName(archive["high_water"])
    return rows.groupBy("table_name").agg(F.max("id").alias("id")).filter(F.col("id").isNotNull())


def first_fill(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(source, chat_id) of rows for which the archive holds no message of that source yet."""
    filled = messages.filter(F.col("source").isNotNull()).select("source", "chat_id").distinct()
    return rows.select("source", "chat_id").distinct().join(filled, ["source", "chat_id"], "left_anti")


def find_chats(specs: DataFrame, chats: DataFrame, marks: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chat ids of specs by slug, creating the missing ones: (source_id, slug, chat_id) and new chats.

    ``specs`` carries slug, source_id, title, subtitle, is_group, origin, device_id and, where chats of several
    sources come together, ``source``. ``marks`` may hold the archive's ``high_water`` table.
    """
    named = ["source"] if "source" in specs.columns else []
    known = chats.select("slug", F.col("id").alias("known_id"))
    matched = materialise(specs.join(known, "slug", "left"), "chats")
    columns = ["slug", "device_id", "title", "subtitle", "is_group", "origin"]
    missing = matched.filter(F.col("known_id").isNull()).groupBy("slug").agg(
        F.min(F.struct(*columns[1:])).alias("_c")).select("slug", "_c.*")
    fresh = number_rows(missing, F.col("slug"), "id", highest_id({"chat": chats, **(marks or {})}, "chat"))
    ids = matched.join(fresh.select("slug", F.col("id").alias("fresh_id")), "slug", "left").select(
        *named, "source_id", "slug", "device_id", F.coalesce("known_id", "fresh_id").alias("chat_id"))
    return ids, fresh.select("id", *columns)


def place(canonical: DataFrame, chat_ids: DataFrame) -> DataFrame:
    """Canonical rows with the ids of their chat and device.

    Chats are matched by source and id where the specs name their source: ids repeat between devices.
    """
    keys = ["source", "chat_external_id"] if "source" in chat_ids.columns else ["chat_external_id"]
    ids = chat_ids.withColumnRenamed("source_id", "chat_external_id").select(*keys, "chat_id", "device_id")
    return canonical.join(ids, keys)


def import_new(canonical: DataFrame, specs: DataFrame, archive: dict[str, DataFrame], by_handle: bool = False,
               incremental_state: bool = False, media_ready: bool = True) -> Changes:
    """Rows of a source that the archive does not hold yet, with their chats, people and participants.

    ``by_handle`` resolves senders as handles (else as names); ``incremental_state`` marks rows of chats
    that were filled before as new; ``media_ready`` tells whether attachments arrive with their files.
    """
    unseen = joins.once_per_anchor(joins.unseen(canonical, archive["source_ref"]), "ts")
    return add_rows(materialise(unseen, "unseen"), specs, archive, by_handle, incremental_state, media_ready)


def import_gated(canonical: DataFrame, events: DataFrame, specs: DataFrame, archive: dict[str, DataFrame], **options) -> Changes:
    """An import behind the drift checks: all events are stored, and sources with a fatal one add nothing else.

    ``events`` are those of the probes, the enumerated columns, misfit values and parse failures of the same run.
    """
    changes = import_new(drift.gate(canonical, events), specs, archive, **options)
    changes.added["drift_event"] = drift.upsert(archive.get("drift_event"), events)
    return changes


def add_rows(unseen: DataFrame, specs: DataFrame, archive: dict[str, DataFrame], by_handle: bool,
             incremental_state: bool, media_ready: bool) -> Changes:
    """Changes that add canonical rows known to be new; ``unseen`` is read several times."""
    chat_ids, new_chats = find_chats(specs, archive["chat"], {n: archive[n] for n in ("high_water",) if n in archive})
    owners = archive["device"].select(F.col("id").alias("device_id"), "owner_person_id")
    fresh = place(unseen, chat_ids).join(owners, "device_id", "left")

    others = fresh.filter(~F.col("is_me")).select(F.col("sender_raw").alias("value"), "ts")
    if by_handle:
        people = identity.resolve_handles(others, archive["handle"], archive["person"])
    else:
        people = identity.resolve_names(others, archive["person"], archive["person_alias"])
    linked = identity.link_senders(fresh, people.links).withColumn(
        "sender_person_id", F.when(F.col("is_me"), F.col("owner_person_id")).otherwise(F.col("person_id")))

    state = F.lit(PUBLISHED)
    if incremental_state:
        first = first_fill(fresh, archive["message"]).withColumn("_first", F.lit(True))
        linked = linked.join(first, ["source", "chat_id"], "left")
        state = F.when(F.col("_first"), PUBLISHED).otherwise(NEW)
    with_files = F.size("attachments") > 0
    status = F.when(with_files, "ready" if media_ready else "pending").otherwise("none")
    numbered = number_rows(linked, anchor_key(), "id", highest_id(archive, "message"))
    messages = materialise(
        numbered.withColumns({"media_status": status, "sync_state": state}).select(*MESSAGE_COLUMNS, "attachments"), "imported")

    owned = chat_ids.join(owners, "device_id").select("chat_id", F.col("owner_person_id").alias("person_id"))
    participants = (
        messages.select("chat_id", F.col("sender_person_id").alias("person_id")).unionByName(owned)
        .filter(F.col("person_id").isNotNull()).distinct().join(archive["chat_participant"], ["chat_id", "person_id"], "left_anti"))
    added = {
        "chat": new_chats, "person": people.new_persons, "chat_participant": participants,
        "message": messages.select(*MESSAGE_COLUMNS), "source_ref": messages.select(F.col("id").alias("message_id"), "source", "external_id"),
        "attachment": messages.filter(with_files).select(
            F.col("id").alias("message_id"), F.posexplode("attachments").alias("position", "a")).select("message_id", "position", "a.*"),
    }
    if people.new_handles is not None:
        added["handle"] = people.new_handles
    return Changes(added=added)


def import_stats(canonical: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: distinct new anchors, rows already known, attachments of new rows."""
    known = refs.select(*joins.ANCHOR).withColumn("_known", F.lit(True))
    seen = canonical.groupBy(*joins.ANCHOR).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.size("attachments")).alias("_files"))
    marked = seen.join(known, joins.ANCHOR, "left")
    old = F.coalesce("_known", F.lit(False))
    return marked.agg(
        F.count_if(~old).alias("new"), F.coalesce(F.sum(F.when(old, F.col("_n"))), F.lit(0)).alias("skipped_existing"),
        F.coalesce(F.sum(F.when(~old, F.col("_files"))), F.lit(0)).alias("media"))


COMPARED = ("text", "retracted", "edits")
TAKEN = (*COMPARED, "apps")


def compare(canonical: DataFrame, messages: DataFrame) -> DataFrame:
    """Source rows against the archive in one join: ``is_new``, ``is_changed`` (text, retraction or
    edits differ) and ``is_reacted`` (reactions differ; all taken back means an empty list)."""
    none = F.array().cast(messages.schema["reactions"].dataType)
    before = messages.select(*joins.ANCHOR, F.col("id").alias("_id"), *[F.col(c).alias(f"_old_{c}") for c in COMPARED],
                             F.coalesce("reactions", none).alias("_old_reactions"))
    rows = joins.once_per_anchor(canonical, "ts").join(before, joins.ANCHOR, "left")
    differs = F.lit(False)
    for column in COMPARED:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"_old_{column}"))
    known = F.col("_id").isNotNull()
    return rows.withColumns({
        "is_new": ~known, "is_changed": known & differs,
        "is_reacted": known & (F.coalesce("reactions", none) != F.col("_old_reactions")),
    }).drop("_old_reactions", *[f"_old_{c}" for c in COMPARED])


def sync(canonical: DataFrame, specs: DataFrame, archive: dict[str, DataFrame]) -> Changes:
    """Live sync: new rows, changed rows and reactions. Source and archive meet once; every later step
    reads only the rows that differ."""
    differing = compare(canonical, archive["message"]).filter("is_new OR is_changed OR is_reacted")
    return sync_rows(materialise(differing, "differing"), specs, archive)


def sync_rows(differing: DataFrame, specs: DataFrame, archive: dict[str, DataFrame], media_ready: bool = False) -> Changes:
    """Changes that bring in rows known to differ: as ``compare`` marks them, read several times."""
    unseen = differing.filter("is_new").drop("_id", "is_new", "is_changed", "is_reacted")
    out = add_rows(unseen, specs, archive, by_handle=True, incremental_state=True, media_ready=media_ready)
    fresh = differing.filter(~F.col("is_new")).select(
        F.col("_id").alias("id"), "is_changed", *[F.col(c).alias(f"_{c}") for c in (*TAKEN, "reactions")])
    rows = archive["message"].join(fresh, "id")
    taken = {c: F.when(F.col("is_changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in TAKEN}
    none = F.array().cast(archive["message"].schema["reactions"].dataType)
    state = F.when(F.col("is_changed"), NEW).otherwise(F.col("sync_state"))
    out.updated["message"] = rows.withColumns(
        {**taken, "reactions": F.coalesce("_reactions", none), "sync_state": state}).select(*MESSAGE_COLUMNS)
    return out


def sync_report(canonical: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts of a dry run: new and updated rows."""
    return compare(canonical, messages).agg(F.count_if("is_new").alias("new"), F.count_if("is_changed").alias("updated"))


def apply_changes(archive: dict[str, DataFrame], changes: Changes) -> dict[str, DataFrame]:
    """Archive tables after an import, as new DataFrames."""
    out = dict(archive)
    for name, rows in changes.updated.items():
        out[name] = out[name].join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)
    for name, rows in changes.added.items():
        if name in out:
            out[name] = out[name].unionByName(rows, allowMissingColumns=True)
    return out


def import_preview(canonical: DataFrame, chats: DataFrame, refs: DataFrame, persons: DataFrame,
                   aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an import would do: per chat total and new, names that would become persons, and how many
    new messages come from known people. ``chats`` carries slug, title, is_group and source_id."""
    known = refs.select(*joins.ANCHOR, F.lit(True).alias("_known"))
    rows = canonical.join(known, joins.ANCHOR, "left").withColumn("_new", F.col("_known").isNull())
    per_chat = rows.groupBy(F.col("chat_external_id").alias("source_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_new").alias("new"))
    listed = chats.join(per_chat, "source_id", "left").fillna(0, ["total", "new"]).select("slug", "title", "is_group", "total", "new")
    senders = rows.filter(F.col("_new") & ~F.col("is_me") & (F.coalesce("sender_raw", F.lit("")) != "")).groupBy(
        F.col("sender_raw").alias("value")).agg(F.count(F.lit(1)).alias("messages"))
    matched = identity.match_names(senders, persons, aliases)
    new_names = matched.filter(F.col("known_id").isNull()).select(F.col("value").alias("name"))
    known_count = matched.filter(F.col("known_id").isNotNull()).agg(
        F.coalesce(F.sum("messages"), F.lit(0)).alias("matched_messages"))
    return listed, new_names, known_count


def union_previews(previews: list[DataFrame]) -> DataFrame:
    """Chats of several previews, once per slug."""
    rows = previews[0]
    for more in previews[1:]:
        rows = rows.unionByName(more)
    rest = [c for c in rows.columns if c != "slug"]
    return rows.groupBy("slug").agg(F.max(F.struct(*rest)).alias("_r")).select("slug", "_r.*")


def replace_chats(archive: dict[str, DataFrame], slugs: DataFrame) -> dict[str, DataFrame]:
    """The archive without the chats of a re-import, ready for ``import_new`` of their full content."""
    gone = archive["chat"].join(slugs, "slug", "left_semi").select(F.col("id").alias("chat_id"))
    return drop_chats(archive, gone)


# --- media --------------------------------------------------------------------------------------------


def complete_media(messages: DataFrame, attachments: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media rows of pending messages and the messages' new status.

    ``attachments``: message_id, position, source_ref, mime, filename, is_sticker, emoji_desc and the
    resolved ``path``; ``files``: path, digest, bytes, portrait. A path without a file becomes a row of
    kind ``other`` without ``src``. A file without a digest could not be read: it gives no row and its
    message stays pending. Messages without attachments become ready.
    """
    pending = messages.filter(F.col("media_status") == "pending").select(F.col("id").alias("message_id"), "is_me")
    wanted = attachments.join(pending.select("message_id"), "message_id", "left_semi")
    found = wanted.join(files.withColumn("_found", F.lit(True)), "path", "left")
    present = F.coalesce("_found", F.lit(False))
    failed = present & F.col("digest").isNull()
    ext = media_rules.media_extension(F.col("mime"), F.col("filename"), F.col("path"))
    kind = media_rules.media_kind(F.col("mime"), ext)
    cat = media_rules.media_category(kind, F.col("is_sticker"), F.col("emoji_desc"))
    src = media_rules.web_path(kind, F.col("digest"), media_rules.web_extension(kind, ext, F.col("is_sticker")))
    can_turn = (kind == "video") | (cat == media_rules.PHOTO)
    rows = found.filter(~failed).select(
        "message_id", "position", F.when(present, kind).otherwise("other").alias("kind"), F.when(present, src).alias("src"),
        F.when(present, cat).alias("cat"), (present & can_turn & F.coalesce("portrait", F.lit(False))).alias("portrait"),
        F.when(present, F.col("bytes")).otherwise(0).alias("bytes"), F.col("digest").alias("content_hash"))
    outcome = found.groupBy("message_id").agg(F.bool_or(failed).alias("_failed"))
    status = pending.join(outcome, "message_id", "left").select(
        F.col("message_id").alias("id"),
        F.when(F.coalesce("_failed", F.lit(False)), "pending").otherwise("ready").alias("media_status"))
    return rows, status


# --- purge and unread state ------------------------------------------------------------------------------


def drop_chats(archive: dict[str, DataFrame], chat_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given chats and what hangs on them; ``high_water`` keeps the highest ids."""
    gone = chat_ids.select("chat_id").distinct()
    messages = archive["message"].join(gone, "chat_id", "left_semi").select(F.col("id").alias("message_id"))
    out = dict(archive)
    out["chat"] = archive["chat"].join(gone.withColumnRenamed("chat_id", "id"), "id", "left_anti")
    for name in ("message", "chat_participant", "chat_source"):
        if name in out:
            out[name] = archive[name].join(gone, "chat_id", "left_anti").select(*archive[name].columns)
    out["high_water"] = high_water(archive)
    for name in ("media", "source_ref", "attachment"):
        if name in out:
            out[name] = archive[name].join(messages, "message_id", "left_anti").select(*archive[name].columns)
    return out


@dataclass
class Purge:
    archive: dict[str, DataFrame]
    files: DataFrame
    originals: DataFrame
    stats: DataFrame


def purge(archive: dict[str, DataFrame], chat_ids: DataFrame, devices: DataFrame | None = None) -> Purge:
    """Remove chats; list the files no remaining message uses, and count what goes and what stays.

    ``files`` (src, bytes) and ``originals`` (content_hash) are deletable; nothing is deleted here. With
    ``devices`` (device_id) the device rows go too.
    """
    gone = chat_ids.select("chat_id").distinct()
    media, messages = archive["media"], archive["message"]
    by_src = joins.used_only_by(media, messages, gone, "src")
    by_hash = joins.used_only_by(media, messages, gone, "content_hash")
    owned = messages.join(gone, "chat_id", "left_semi").select(F.col("id").alias("message_id"))
    per_message = media.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    freed = F.when(F.col("exclusive"), F.col("bytes"))
    stats = _named(
        gone.agg(F.count(F.lit(1)).alias("chats")),
        owned.join(per_message, "message_id", "left").agg(
            F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("media_rows")),
        by_src.agg(F.count_if("exclusive").alias("files_deleted"), F.count_if(~F.col("exclusive")).alias("files_kept_shared"),
                   F.coalesce(F.sum(freed), F.lit(0)).alias("bytes_freed")),
        by_hash.agg(F.count_if("exclusive").alias("originals_deleted")))
    rest = drop_chats(archive, gone)
    if devices is not None:
        rest["device"] = archive["device"].join(devices.withColumnRenamed("device_id", "id"), "id", "left_anti")
    return Purge(rest, by_src.filter("exclusive").select("src", "bytes"), by_hash.filter("exclusive").select("content_hash"), stats)


def _named(*single_rows: DataFrame) -> DataFrame:
    """One-row frames as (name, value) rows."""
    out = None
    for row in single_rows:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in row.columns])
        named = row.select(F.explode(pairs).alias("p")).select("p.*")
        out = named if out is None else out.unionByName(named)
    return out


def device_chats(chats: DataFrame, devices: DataFrame) -> DataFrame:
    return chats.join(devices.select("device_id"), "device_id", "left_semi").select(F.col("id").alias("chat_id"))


def mark_seen(messages: DataFrame, chat_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the unread state of the given chats cleared, and how many rows that were per chat."""
    seen = chat_ids.select("chat_id").distinct().withColumn("_seen", F.lit(True))
    rows = messages.join(seen, "chat_id", "left")
    hit = F.coalesce("_seen", F.lit(False)) & (F.col("sync_state") == NEW)
    counts = rows.filter(hit).groupBy("chat_id").agg(F.count(F.lit(1)).alias("marked_seen"))
    cleared = rows.withColumn("sync_state", F.when(hit, PUBLISHED).otherwise(F.col("sync_state"))).drop("_seen")
    return cleared.select(*messages.columns), counts
