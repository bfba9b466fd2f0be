from conftest import dicts

from parlance.operators import canonical
from parlance.sources import contracts, stores

BASE = 760000000
DDL = """
    CREATE TABLE ZWACHATSESSION (Z_PK INTEGER, ZSESSIONTYPE INTEGER, ZCONTACTJID VARCHAR, ZPARTNERNAME VARCHAR);
    CREATE TABLE ZWAMESSAGE (Z_PK INTEGER, ZSTANZAID VARCHAR, ZMESSAGEDATE TIMESTAMP, ZTEXT VARCHAR, ZFROMJID VARCHAR, ZISFROMME INTEGER,
        ZMESSAGETYPE INTEGER, ZCHATSESSION INTEGER, ZGROUPMEMBER INTEGER, ZGROUPEVENTTYPE INTEGER);
    CREATE TABLE ZWAMEDIAITEM (Z_PK INTEGER, ZMESSAGE INTEGER, ZMEDIALOCALPATH VARCHAR, ZTITLE VARCHAR, ZLATITUDE FLOAT, ZLONGITUDE FLOAT);
    CREATE TABLE ZWAGROUPMEMBER (Z_PK INTEGER, ZCHATSESSION INTEGER, ZMEMBERJID VARCHAR);
"""
ALICE, GROUP, UNSAVED = "491700000001@s.whatsapp.net", "120363000000000001@g.us", "491700000009@s.whatsapp.net"


def message(pk, off, me, kind, text, session, jid=None, member=None, stanza=True):
    return (pk, f"STANZA-{pk}" if stanza else None, BASE + off, text, jid, me, kind, session, member, 0)


MESSAGES = [
    message(100, 0, 0, 0, "Hey! WhatsApp from Alice", 1, ALICE), message(101, 60, 1, 0, "Got it, thanks!", 1),
    message(102, 3600, 0, 1, None, 1, ALICE), message(103, 3660, 1, 3, None, 1),
    message(104, 7200, 0, 0, "(same Alice, new @lid id)", 1, "89262422757561@lid"),
    message(300, 0, 0, 0, "Standup in 5?", 2, GROUP, 10), message(301, 120, 0, 0, "On my way", 2, GROUP, 11),
    message(302, 240, 1, 0, "Joining now", 2, GROUP), message(303, 360, 0, 99, "weird future type", 2, GROUP, 10),
    message(400, 0, 0, 0, "hi from the phone JID", 3, UNSAVED), message(401, 60, 1, 0, "reply from me", 3),
    message(402, 120, 0, 0, "now from a @lid", 3, "71112223334445@lid"), message(403, 180, 0, 14, None, 3, UNSAVED),
    message(404, 240, 0, 59, None, 3, UNSAVED), message(405, 300, 0, 59, None, 3, UNSAVED),
]
ROWS = {
    "ZWACHATSESSION": [(1, 0, ALICE, "Alice"), (2, 1, GROUP, "Dev Team"), (3, 0, UNSAVED, None)],
    "ZWAMESSAGE": MESSAGES,
    "ZWAMEDIAITEM": [(200, 102, "Media/491700000001/photo.jpg", "photo.jpg", None, None), (201, 103, "Media/491700000001/voice.ogg", None, None, None),
                     (210, 404, "Media/491700000009/newmedia.jpg", "m.jpg", None, None)],
    "ZWAGROUPMEMBER": [(10, 2, "491700000002@s.whatsapp.net"), (11, 2, "491700000003@s.whatsapp.net")],
}


def store(spark, sqlite_file, more=(), media=()):
    rows = dict(ROWS, ZWAMESSAGE=MESSAGES + list(more), ZWAMEDIAITEM=ROWS["ZWAMEDIAITEM"] + list(media))
    return stores.read_store(spark, sqlite_file(DDL, rows), stores.WHATSAPP_SCHEMAS)


def canon(spark, sqlite_file, **kw):
    return {r["external_id"]: r for r in dicts(canonical.whatsapp_canonical(store(spark, sqlite_file, **kw), "whatsapp_live:mac", "Me"))}


def test_fourteen_messages_are_kept(spark, sqlite_file):
    rows = canon(spark, sqlite_file)
    assert len(rows) == 14 and "STANZA-405" not in rows
    assert rows["STANZA-403"]["retracted"] and rows["STANZA-303"]["text"] == "weird future type"
    assert rows["STANZA-404"]["attachments"][0]["source_ref"] == "Media/491700000009/newmedia.jpg"
    assert rows["STANZA-102"]["attachments"][0]["mime"] == "image/jpeg" and rows["STANZA-103"]["attachments"][0]["mime"] == "audio/ogg"
    assert rows["STANZA-100"]["ts"] == BASE + 978307200


def test_senders(spark, sqlite_file):
    rows = canon(spark, sqlite_file)
    assert {rows[f"STANZA-{k}"]["sender_raw"] for k in (100, 102, 104)} == {"Alice"}
    assert [rows[f"STANZA-{k}"]["sender_raw"] for k in (300, 301, 302)] == ["491700000002@s.whatsapp.net", "491700000003@s.whatsapp.net", "Me"]
    assert {rows[f"STANZA-{k}"]["sender_raw"] for k in (400, 402, 403)} == {UNSAVED}


def test_labels_and_dropped_rows(spark, sqlite_file):
    more = [
        message(500, 1, 0, 1, None, 1, ALICE), message(501, 2, 0, 5, None, 1, ALICE), message(502, 3, 0, 5, None, 1, ALICE),
        message(503, 4, 0, 4, None, 1, ALICE), message(504, 5, 0, 6, None, 1, ALICE), message(505, 6, 0, 7, None, 1, ALICE),
        message(506, 7, 0, 7, "You added Bob", 1, ALICE), message(507, 8, 0, None, "plain", 1, ALICE, stanza=False),
        (508, "STANZA-508", None, "no time", ALICE, 0, 0, 1, None, 0), message(509, 9, 0, 10, None, 1, ALICE),
    ]
    media = [(300, 502, None, None, 52.5, 13.25), (301, 509, None, None, None, None)]
    rows = canon(spark, sqlite_file, more=more, media=media)
    apps = {k: rows[f"STANZA-{k}"]["apps"] for k in (500, 501, 502, 503, 504, 506)}
    assert apps == {500: ["🖼️ Image"], 501: ["📍 Location"], 502: ["📍 Location (52.50000, 13.25000)"], 503: ["👤 Contact card"],
                    504: ["📞 Call"], 506: []}
    assert rows["507"]["text"] == "plain"
    assert not {"STANZA-505", "STANZA-508", "STANZA-509"} & set(rows)


def test_unknown_code_and_missing_time_are_reported(spark, sqlite_file):
    tables = store(spark, sqlite_file, more=[(508, "S", None, "no time", ALICE, 0, 0, 1, None, 0)])
    found = dicts(canonical.enum_events(tables, "whatsapp_live", 1, contracts.WHATSAPP_ENUMS, 3))
    assert [(e["column_name"], e["observed"], e["severity"], e["occurrences"]) for e in found] == [("ZMESSAGETYPE", "99", "warn", 1)]
    late = dicts(canonical.whatsapp_failures(tables, "whatsapp_live", 3))
    assert [(e["kind"], e["column_name"], e["observed"]) for e in late] == [("row_parse_failed", "ZMESSAGEDATE", "NULL")]


def test_discovery_lists_busy_chats(spark, sqlite_file):
    tables = store(spark, sqlite_file)
    rows = canonical.whatsapp_canonical(tables, "s", "Me")
    found = canonical.counts_by_chat(rows, stores.whatsapp_chats(tables, "wa"), min_messages=5).collect()
    assert [(r.title, r.total) for r in found] == [("Alice", 5), (UNSAVED, 5)]


def test_two_stores_with_equal_row_ids_stay_apart(spark, folder):
    import sqlite3

    root = folder()
    for name, who in (("one", "Alice"), ("two", "Berta")):
        con = sqlite3.connect(f"{root}/{name}.sqlite")
        con.executescript(DDL)
        con.execute("INSERT INTO ZWACHATSESSION VALUES (1, 0, ?, ?)", (f"{who}@x", who))
        con.executemany("INSERT INTO ZWAMESSAGE VALUES (?, NULL, ?, ?, ?, 0, 0, 1, NULL, 0)",
                        [(k, BASE + k, f"{who} says {k}", f"{who}@x") for k in (1, 2)])
        con.execute("INSERT INTO ZWAMEDIAITEM VALUES (7, 2, ?, NULL, NULL, NULL)", (f"{who}.jpg",))
        con.commit()
        con.close()
    tables = stores.read_store(spark, f"{root}/*.sqlite", stores.WHATSAPP_SCHEMAS)
    names = {f"{root}/one.sqlite": "whatsapp_live:one", f"{root}/two.sqlite": "whatsapp_live:two"}
    rows = dicts(canonical.whatsapp_canonical(tables, names, "Me"), "source", "ts")
    assert [(r["source"], r["sender_raw"], r["text"]) for r in rows] == [
        (f"whatsapp_live:{d}", w, f"{w} says {k}") for d, w in (("one", "Alice"), ("two", "Berta")) for k in (1, 2)]
    plain = canonical.whatsapp_canonical(tables, "whatsapp_live:phone", "Me")
    assert plain.select("source", "external_id").distinct().count() == 4
    chats = stores.whatsapp_chats(tables, {f"{root}/one.sqlite": "one", f"{root}/two.sqlite": "two"}, names)
    assert chats.select("slug").distinct().count() == 2 and "source" in chats.columns

    from parlance.operators import upkeep
    from pyspark.sql import functions as F
    from test_upkeep import empty_archive

    archive = empty_archive(spark)
    changes = upkeep.import_new(canonical.whatsapp_canonical(tables, names, "Me"), chats.withColumn("device_id", F.lit(5).cast("long")), archive)
    stored = upkeep.apply_changes(archive, changes)["message"]
    assert stored.count() == 4 and stored.select("chat_id").distinct().count() == 2


def test_misfit_values_become_events(spark, sqlite_file):
    bad = (900, "STANZA-900", BASE, b"\xff blob as text", ALICE, 0, 0, 1, None, 0)
    tables = store(spark, sqlite_file, more=[bad])
    events = dicts(canonical.misfit_events(tables, "whatsapp_live:mac", 1, 9), "detail")
    assert [(e["source"], e["kind"], e["table_name"], e["observed"]) for e in events] == [
        ("whatsapp_live:mac", "row_parse_failed", "ZWAMESSAGE", "ZTEXT:bytes")]
