import pytest
from conftest import dicts
from pyspark.sql import functions as F

from parlance.model import ARCHIVE_DDL, CANONICAL_DDL, EDIT, REACTION, schema
from parlance.operators import sinks, upkeep

MESSAGE = f"""id long, chat_id long, sender_person_id long, ts long, is_me boolean, text string, retracted boolean, edits array<{EDIT}>,
    reactions array<{REACTION}>, apps array<string>, media_status string, sync_state string, source string, external_id string"""
FILE = {"source_ref": "a.png", "mime": "image/png", "filename": "a.png", "is_sticker": False, "emoji_desc": ""}


def row(ext, ts, sender="Ann", me=False, text="t", chat="1", source="wa", **more):
    base = dict(source=source, chat_external_id=chat, external_id=ext, ts=ts, sender_raw=sender, is_me=me, text=text, retracted=False,
                edits=[], reactions=[], apps=[], attachments=[])
    return {**base, **more}


def canonical(spark, *rows):
    return spark.createDataFrame(list(rows), schema(CANONICAL_DDL))


def empty_archive(spark):
    return {
        "person": spark.createDataFrame([(1, "Owner", None)], "id long, display_name string, avatar_src string"),
        "person_alias": spark.createDataFrame([], "value string, person_id long"), "handle": spark.createDataFrame([], "value string, person_id long"),
        "device": spark.createDataFrame([(5, "dev", "Dev", "static", 1)], "id long, slug string, name string, type string, owner_person_id long"),
        "chat": spark.createDataFrame([], "id long, slug string, device_id long, title string, subtitle string, is_group boolean, origin string"),
        "chat_participant": spark.createDataFrame([], "chat_id long, person_id long"),
        "message": spark.createDataFrame([], schema(MESSAGE)), "source_ref": spark.createDataFrame([], "message_id long, source string, external_id string"),
        "attachment": spark.createDataFrame([], schema(ARCHIVE_DDL["attachment"])),
    }


def specs(spark, *ids):
    return spark.createDataFrame([(f"dev/chat_{k}", k, f"Chat {k}", None, False, "whatsapp", 5) for k in ids],
                                 "slug string, source_id string, title string, subtitle string, is_group boolean, origin string, device_id long")


def test_import_then_again_adds_nothing(spark):
    rows = canonical(spark, row("a", 1), row("b", 2, me=True, sender="Me"), row("a", 5, text="repeated"), row("c", 3, chat="2", attachments=[FILE]))
    chats = specs(spark, "1", "2")
    archive = empty_archive(spark)
    after = upkeep.apply_changes(archive, upkeep.import_new(rows, chats, archive))
    got = {r["external_id"]: r for r in dicts(after["message"])}
    assert sorted(r["id"] for r in got.values()) == [1, 2, 3]
    assert got["a"]["text"] == "t" and got["b"]["sender_person_id"] == 1 and got["a"]["sender_person_id"] == got["c"]["sender_person_id"] == 2
    assert got["c"]["media_status"] == "ready" and got["a"]["media_status"] == "none"
    assert {r["slug"] for r in dicts(after["chat"])} == {"dev/chat_1", "dev/chat_2"}
    assert {(r["chat_id"], r["person_id"]) for r in dicts(after["chat_participant"])} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    again = upkeep.import_new(rows, chats, after)
    assert {n: df.count() for n, df in again.added.items()} == {
        "chat": 0, "person": 0, "chat_participant": 0, "message": 0, "source_ref": 0, "attachment": 0}
    assert dicts(upkeep.import_stats(rows, after["source_ref"])) == [{"new": 0, "skipped_existing": 4, "media": 0}]


def test_sync_marks_changes_and_reactions(spark):
    heart = {"emoji": "❤️", "label": "loved", "sender": "x", "ts": None}
    first = [row(str(k), k, sender=f"h{k % 2}") for k in range(6)]
    first[5]["reactions"] = [heart]
    archive, chats = empty_archive(spark), specs(spark, "1")
    filled = upkeep.apply_changes(archive, upkeep.sync(canonical(spark, *first), chats, archive))
    assert {r.sync_state for r in filled["message"].collect()} == {"published"}
    assert {r.display_name for r in filled["person"].collect()} == {"Owner", "h0", "h1"} and filled["handle"].count() == 2

    second = [dict(r) for r in first] + [row("9", 9, sender="h1")]
    second[0]["text"] = "edited"
    second[1]["retracted"] = True
    second[2]["edits"] = [{"text": "a", "ts": 1}, {"text": "b", "ts": 2}]
    second[3]["reactions"] = [heart]
    second[5]["reactions"] = []
    now = canonical(spark, *second)
    assert dicts(upkeep.sync_report(now, filled["message"])) == [{"new": 1, "updated": 3}]
    after = upkeep.apply_changes(filled, upkeep.sync(now, chats, filled))
    got = {r["external_id"]: r for r in dicts(after["message"])}
    assert {k for k, r in got.items() if r["sync_state"] == "new"} == {"0", "1", "2", "9"}
    assert got["0"]["text"] == "edited" and got["1"]["retracted"] and len(got["2"]["edits"]) == 2
    assert [len(got[k]["reactions"]) for k in ("3", "4", "5")] == [1, 0, 0] and len(got) == 7
    assert dicts(upkeep.sync_report(now, after["message"])) == [{"new": 0, "updated": 0}]


@pytest.fixture
def shared_file(spark):
    """Two chats share s.jpg; only the first uses only.jpg."""
    archive = {
        "chat": spark.createDataFrame([(1, "d/a", 5), (2, "d/b", 5)], "id long, slug string, device_id long"),
        "message": spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id long, chat_id long"),
        "media": spark.createDataFrame([(1, 10, "s.jpg", 7, "hs"), (2, 11, "only.jpg", 5, "ho"), (3, 20, "s.jpg", 7, "hs"), (4, 10, None, 0, None)],
                                       "id long, message_id long, src string, bytes long, content_hash string"),
        "source_ref": spark.createDataFrame([(10, "s", "1"), (20, "s", "2")], "message_id long, source string, external_id string"),
        "attachment": spark.createDataFrame([(10, 0), (10, 1), (20, 0)], "message_id long, position int"),
        "chat_participant": spark.createDataFrame([(1, 1), (2, 1)], "chat_id long, person_id long"),
        "device": spark.createDataFrame([(5,), (6,)], "id long"),
    }
    return archive


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "chat_id long")


def test_purge_keeps_shared_files(spark, shared_file):
    first = upkeep.purge(shared_file, ids(spark, 1))
    assert {r.name: r.value for r in first.stats.collect()} == {
        "chats": 1, "messages": 2, "media_rows": 3, "files_deleted": 1, "files_kept_shared": 1, "bytes_freed": 5, "originals_deleted": 1}
    assert [r.src for r in first.files.collect()] == ["only.jpg"]
    assert {n: df.count() for n, df in first.archive.items()} == {
        "chat": 1, "message": 1, "media": 1, "source_ref": 1, "attachment": 1, "chat_participant": 1, "device": 2, "high_water": 2}
    second = upkeep.purge(first.archive, ids(spark, 2))
    both = upkeep.purge(shared_file, ids(spark, 1, 2))
    assert {r.src for r in both.files.collect()} == {r.src for p in (first, second) for r in p.files.collect()} == {"s.jpg", "only.jpg"}


def test_purge_of_a_device(spark, shared_file):
    devices = spark.createDataFrame([(5,)], "device_id long")
    rest = upkeep.purge(shared_file, upkeep.device_chats(shared_file["chat"], devices), devices).archive
    assert {n: df.count() for n, df in rest.items()} == {
        "chat": 0, "message": 0, "media": 0, "source_ref": 0, "attachment": 0, "chat_participant": 0, "device": 1, "high_water": 2}
    assert {r["table_name"]: r["id"] for r in dicts(rest["high_water"])} == {"chat": 2, "message": 20}


def test_replaced_chats_keep_no_attachments_and_no_ids(spark):
    rows = canonical(spark, *[row(str(k), k, chat=str(k % 2), attachments=[FILE]) for k in range(6)])
    chats, archive = specs(spark, "0", "1"), empty_archive(spark)
    for turn in range(3):
        archive = upkeep.replace_chats(archive, chats.select("slug"))
        after = upkeep.apply_changes(archive, upkeep.import_new(rows, chats, archive))
        archive = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in after.items()}
        assert [archive[n].count() for n in ("message", "attachment", "source_ref", "chat")] == [6, 6, 6, 2]
        assert {r["id"] for r in dicts(archive["message"])} == set(range(6 * turn + 1, 6 * turn + 7))
        assert {r["message_id"] for r in dicts(archive["attachment"])} == {r["id"] for r in dicts(archive["message"])}


def test_media_completion(spark):
    messages = spark.createDataFrame([(1, True, "pending"), (2, False, "pending"), (3, False, "pending"), (4, False, "ready")],
                                     "id long, is_me boolean, media_status string")
    attachments = spark.createDataFrame(
        [(1, 0, "x", "image/png", "x.png", True, "", "/x"), (1, 1, "gone", "", "g.mov", False, "", "/gone"), (2, 0, "bad", "video/mp4", "b", False, "", "/bad"),
         (4, 0, "x", "image/png", "x.png", False, "", "/x")],
        "message_id long, position int, source_ref string, mime string, filename string, is_sticker boolean, emoji_desc string, path string")
    files = spark.createDataFrame([("/x", "abcd", 9, True), ("/bad", None, 3, False)], "path string, digest string, bytes long, portrait boolean")
    rows, status = upkeep.complete_media(messages, attachments, files)
    assert [(r["message_id"], r["kind"], r["src"], r["cat"], r["portrait"], r["bytes"]) for r in dicts(rows, "message_id", "position")] == [
        (1, "image", "media/images/ab/abcd.png", "sticker", False, 9), (1, "other", None, None, False, 0)]
    assert {(r.id, r.media_status) for r in status.collect()} == {(1, "ready"), (2, "pending"), (3, "ready")}


def test_mark_seen(spark):
    messages = spark.createDataFrame([(1, 1, "new"), (2, 1, "published"), (3, 2, "new")], "id long, chat_id long, sync_state string")
    cleared, counts = upkeep.mark_seen(messages, ids(spark, 1))
    assert dicts(counts) == [{"chat_id": 1, "marked_seen": 1}]
    assert [r.sync_state for r in cleared.orderBy("id").collect()] == ["published", "published", "new"]


def test_archive_on_disk_rewrites_only_touched_buckets(spark, folder):
    root = folder("archive")
    rows = canonical(spark, *[row(str(k), k, chat=str(k % 10)) for k in range(100)])
    archive = empty_archive(spark)
    after = upkeep.apply_changes(archive, upkeep.import_new(rows, specs(spark, *[str(k) for k in range(10)]), archive))
    sinks.write_archive(after, root, 4)
    stored = sinks.read_archive(spark, root, ["message"])["message"]
    one = stored.filter(F.col("external_id") == "17").withColumn("text", F.lit("changed"))
    before = {r[0] for r in spark.read.parquet(f"{root}/message").select("_metadata.file_path").distinct().collect()}
    sinks.replace_rows(one, root, "message")
    spark.catalog.refreshByPath(f"{root}/message")
    again = spark.read.parquet(f"{root}/message")
    kept = before & {r[0] for r in again.select("_metadata.file_path").distinct().collect()}
    assert kept and again.count() == 100 and [r.external_id for r in again.filter("text = 'changed'").collect()] == ["17"]
    extra = sinks.read_archive(spark, root, ["message"])["message"].filter(F.col("external_id") == "3").withColumn("id", F.lit(999))
    sinks.append_rows(extra, root, "message")
    assert sinks.read_archive(spark, root, ["message"])["message"].count() == 101
    wrong = spark.read.parquet(f"{root}/message").filter(F.pmod(F.xxhash64("chat_id"), F.lit(4)) != F.col("chat_bucket"))
    assert wrong.isEmpty()
