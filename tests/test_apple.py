import datetime

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from parlance.operators import canonical, drift
from parlance.sources import contracts, sqlite_ro, stores

BASE = datetime.datetime(2024, 3, 14, 9, 0, tzinfo=datetime.timezone.utc)
HANDLE = "+491701234567"
DDL = """
    CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT, country TEXT, service TEXT, uncanonicalized_id TEXT, person_centric_id TEXT);
    CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, chat_identifier TEXT, service_name TEXT, display_name TEXT, style INTEGER);
    CREATE TABLE message (ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, attributedBody BLOB, handle_id INTEGER, date INTEGER,
        is_from_me INTEGER, cache_has_attachments INTEGER, associated_message_type INTEGER, associated_message_guid TEXT,
        balloon_bundle_id TEXT, message_summary_info BLOB{extra});
    CREATE TABLE chat_message_join (chat_id INTEGER, message_id INTEGER, message_date INTEGER);
    CREATE TABLE attachment (ROWID INTEGER PRIMARY KEY, filename TEXT, mime_type TEXT, transfer_name TEXT, is_sticker INTEGER);
    CREATE TABLE message_attachment_join (message_id INTEGER, attachment_id INTEGER);
"""
DATES = ", date_edited INTEGER, date_retracted INTEGER"
TEXTS = ["Hey! How's it going?", "All good, thanks! You?", "Good too. Check this out:", "Nice shot!", "Meet tomorrow at 6?",
         "Sure, sounds great!", "Perfect, see you then."]
OFFSETS = [0, 90, 10800, 10860, 93600, 93720, 97200]


def ns(seconds: int) -> int:
    return (int(BASE.timestamp()) + seconds - 978307200) * 1_000_000_000


def fixture_rows(dates: bool = True, more: list[tuple] = ()) -> dict:
    """Seven messages of a direct chat and one reaction on the second."""
    end = (0, 0) if dates else ()
    rows = []
    for k, (text, at) in enumerate(zip(TEXTS, OFFSETS), 1):
        info = b"bplist00\xd0\x08\x00\x00\x00\x00\x00\x00\x01\x01" if k == 6 else None
        rows.append((k, f"MSG-{k:04d}", text, None, 1, ns(at), (k + 1) % 2, int(k == 3), 0, None, None, info, *end))
    rows.append((8, "TAPBACK-0001", "Liked", None, 1, ns(180), 0, 0, 2000, "p:0/MSG-0002", None, None, *end))
    rows += [(*r, *end) for r in more]
    return {
        "handle": [(1, HANDLE, "de", "iMessage", None, None)], "chat": [(1, HANDLE, "iMessage", None, 45)],
        "message": rows, "chat_message_join": [(1, r[0], r[5]) for r in rows],
        "attachment": [(1, "~/Library/Messages/Attachments/aa/00/sample.jpg", "image/jpeg", "sample.jpg", 0),
                       (2, "x", "", "a.pluginPayloadAttachment", 0)],
        "message_attachment_join": [(3, 1), (3, 2)],
    }


def store(spark, sqlite_file, dates=True, more=()):
    path = sqlite_file(DDL.format(extra=DATES if dates else ""), fixture_rows(dates, list(more)))
    return path, stores.read_store(spark, path, stores.APPLE_SCHEMAS)


@pytest.mark.parametrize("dates", [True, False])
def test_seven_messages_and_one_reaction(spark, sqlite_file, dates):
    _, tables = store(spark, sqlite_file, dates)
    rows = dicts(canonical.apple_canonical(tables, "imessage_live:mac", "Owner"), "ts")
    assert [r["text"] for r in rows] == TEXTS
    assert [r["ts"] - int(BASE.timestamp()) for r in rows] == OFFSETS
    assert [r["sender_raw"] for r in rows] == [HANDLE, "Owner"] * 3 + [HANDLE]
    assert [len(r["reactions"]) for r in rows] == [0, 1, 0, 0, 0, 0, 0]
    assert rows[1]["reactions"][0] == {"emoji": "❤️", "label": "loved", "sender": HANDLE, "ts": int(BASE.timestamp()) + 180}
    assert [a["filename"] for a in rows[2]["attachments"]] == ["sample.jpg"]
    assert all(r["edits"] == [] and not r["retracted"] for r in rows)


def test_rows_without_content_and_decoded_bodies(spark, sqlite_file):
    body = b"NSString\x01\x94\x84\x01+\x05later"
    more = [
        (20, "A", None, body, 1, ns(1), 0, 0, 0, None, None, None), (21, "B", "￼", None, 1, ns(2), 0, 0, 0, None, None, None),
        (22, "C", None, None, 1, ns(3), 0, 0, 0, None, "com.apple.Music", None), (23, "D", "no date", None, 1, None, 0, 0, 0, None, None, None),
        (24, "E", None, body, 1, ns(4), 0, 0, 7, None, None, None), (25, "F", None, None, None, ns(5), 0, 1, None, None, None, None),
        (26, "G", None, None, 1, ns(6), 0, 0, 3000, "p:0/MSG-0002", None, None),
    ]
    _, tables = store(spark, sqlite_file, more=more)
    rows = {r["external_id"]: r for r in dicts(canonical.apple_canonical(tables, "s", "Owner"))}
    assert rows["20"]["text"] == "later" and rows["22"]["apps"] == ["🎵 Music shared"]
    assert rows["25"]["text"] is None and rows["25"]["sender_raw"] == "" and rows["25"]["attachments"] == []
    assert not {"21", "23", "24", "26"} & set(rows)
    # The removal at second 6 is older than the reaction at second 180, so the reaction stays.
    assert len(rows["2"]["reactions"]) == 1


def test_last_event_of_a_type_decides(spark):
    def event(at, kind, rowid):
        return (1, kind, "bp:x/T", "s", at, at, rowid)

    names = "chat_id long, associated_message_type long, associated_message_guid string, sender string, ts long, date long, rowid long"
    from parlance.operators import reactions
    rows = [event(1, 2000, 1), event(2, 3000, 2), event(3, 2001, 3), event(3, 3001, 4), event(4, 3003, 5), event(5, 2003, 6), event(6, 2002, 7)]
    found = reactions.folded_reactions(reactions.tapback_events(spark.createDataFrame(rows[::-1], names))).first()
    assert [r.emoji for r in found.reactions] == ["👎", "😂"]


def test_chat_titles(spark, sqlite_file):
    path = sqlite_file(DDL.format(extra=""), {"chat": [(1, "id1", "s", "Name", 43), (2, "id2", "s", "", 45), (3, None, "s", None, None)]})
    rows = dicts(stores.apple_chats(stores.read_store(spark, path, stores.APPLE_SCHEMAS), "mac"), "slug")
    assert [(r["slug"], r["title"], r["is_group"]) for r in rows] == [
        ("mac/chat_1", "Name", True), ("mac/chat_2", "id2", False), ("mac/chat_3", "chat_3", True)]


def columns_of(spark, path, source):
    sqlite_ro.register(spark)
    found = spark.read.format("sqlite_ro").option("path", path).option("table", "@columns").load()
    return found.withColumn("source", F.lit(source))


def probe(spark, path):
    contract = drift.contract_frame(spark, contracts.APPLE_LIVE, contracts.APPLE_VERSION, contracts.APPLE_TABLES)
    return dicts(drift.probe(contract, columns_of(spark, path, contracts.APPLE_LIVE), 5), "kind", "table_name", "column_name")


def test_contract_of_a_healthy_store_has_no_fatal_event(spark, sqlite_file):
    path, _ = store(spark, sqlite_file)
    events = probe(spark, path)
    assert {e["severity"] for e in events} == {"warn"} and {e["kind"] for e in events} == {"missing_optional_column"}


def test_removed_column_and_table_are_fatal(spark, sqlite_file):
    script = DDL.format(extra=DATES).replace("guid TEXT, text TEXT", "text TEXT").replace("handle_id INTEGER, date INTEGER", "handle_id INTEGER, date TEXT")
    path = sqlite_file(script.replace("CREATE TABLE handle", "CREATE TABLE other"))
    fatal = [(e["kind"], e["table_name"], e["column_name"], e["observed"]) for e in probe(spark, path) if e["severity"] == "fatal"]
    assert fatal == [("missing_required_column", "message", "guid", None), ("missing_table", "handle", None, None),
                     ("type_changed", "message", "date", "TEXT")]


def test_odd_stored_values_are_named(spark, sqlite_file):
    path = sqlite_file("CREATE TABLE t (a INTEGER, b TEXT)", {"t": [(1, "x"), ("odd", "y"), (3, b"\x00")]})
    sqlite_ro.register(spark)
    rows = spark.read.format("sqlite_ro").schema("a long, b string, c string, _corrupt string, _file string").option("path", path).option(
        "table", "t").option("rows_per_partition", "2").load()
    assert rows.rdd.getNumPartitions() == 2
    assert {(r["a"], r["b"], r["c"], r["_corrupt"]) for r in dicts(rows)} == {
        (1, "x", None, None), (3, None, None, "b:bytes"), (None, "y", None, "a:str")}
