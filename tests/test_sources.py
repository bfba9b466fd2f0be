import pytest
import json

from conftest import dicts

from parlance.sources import documents, paths

CONFIG = {
    "_comment": "x",
    "devices": [
        {"type": "mac_live", "id": "m", "slug": "mac", "name": "Mac", "me_name": "Alice", "db": None, "chats": [
            {"slug": "bob", "title": "Bob", "subtitle": "s", "is_group": False, "origin": "apple", "source": "imessage_live", "source_id": "2"},
            {"slug": "plain"}]},
        {"type": "static", "slug": "old", "name": "Old", "chats": [[7, "Eve, [x]", None, "eve", True], [None, "Wa", "sub", "wa", False, "whatsapp"],
                                                                     [3, "W2", None, "w2", False, "whatsapp"]]}],
    "people": {"+49 1": "Ann"},
}


def put(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return folder


def test_configuration_in_both_shapes(spark, folder):
    docs = documents.whole_files(spark, put(folder(), "sources.json", json.dumps(CONFIG, indent=2)))
    rows = dicts(documents.config_chats(docs), "device_position", "position")
    assert [(r["device_slug"], r["slug"], r["title"], r["is_group"], r["origin"], r["source"], r["source_id"]) for r in rows] == [
        ("mac", "bob", "Bob", False, "apple", "imessage_live", "2"), ("mac", "plain", "plain", False, "apple", None, None),
        ("old", "eve", "Eve, [x]", True, "apple", "imessage_live", "7"), ("old", "wa", "Wa", False, "whatsapp", None, None),
        ("old", "w2", "W2", False, "whatsapp", None, "3")]
    assert [(d["slug"], d["me_name"]) for d in dicts(documents.config_devices(docs), "position")] == [("mac", "Alice"), ("old", "Me")]
    assert dicts(documents.config_people(docs)) == [{"handle": "+49 1", "name": "Ann"}]


def test_chat_files(spark, folder):
    import os
    root = folder()
    os.makedirs(f"{root}/mac")
    chat = {"slug": "mac/bob", "title": "Bob", "origin": "apple", "stats": {"total": 2}, "messages": [
        {"t": "msg", "ts": 5, "me": True, "sender": "I", "text": "a", "media": [{"kind": "image", "src": "x.jpg", "cat": "foto"}], "apps": None},
        {"t": "msg", "ts": 6, "me": False, "sender": "Bob", "text": None, "retracted": True, "edits": [{"text": "q", "ts": None}]}]}
    put(f"{root}/mac", "bob.json", json.dumps(chat, indent=1))
    chats = documents.read_chat_files(spark, root)
    owners = spark.createDataFrame([("mac", "Alice Full")], "device_slug string, owner_name string")
    rows = dicts(documents.message_rows(chats, owners), "position")
    assert [(r["sender"], r["media_status"], r["retracted"]) for r in rows] == [("Alice Full", "ready", False), ("Bob", "none", True)]
    assert [(r["position"], r["src"], r["portrait"]) for r in dicts(documents.media_rows(chats))] == [(0, "x.jpg", False)]
    assert dicts(documents.chat_rows(chats))[0]["is_group"] is False


def test_caches(spark, folder):
    root = put(folder(), "t.json", json.dumps({"a.m4a": {"text": "hi", "lang": "en", "prob": 0.9}, "b.m4a": {"text": "", "lang": "", "error": "x"}}))
    rows = dicts(documents.transcripts(documents.whole_files(spark, root)), "src")
    assert [(r["src"], r["text"], r["prob"], r["error"]) for r in rows] == [("a.m4a", "hi", 0.9, None), ("b.m4a", "", None, "x")]
    root = put(folder(), "o.json", json.dumps({"a.jpg": {"text": "x", "lines": 9, "is_screenshot": True}, "b.jpg": {"lines": 0}}))
    rows = dicts(documents.ocr(documents.whole_files(spark, root)), "src")
    assert [(r["src"], r["lines"], r["is_screenshot"]) for r in rows] == [("a.jpg", 9, True), ("b.jpg", 0, False)]


def test_manifest_prefers_the_media_domain(spark):
    manifest = spark.createDataFrame([("aa1", "HomeDomain", "L/x"), ("zz9", "MediaDomain", "L/x"), ("cc3", "HomeDomain", "L/y")],
                                     "fileID string, domain string, relativePath string")
    rows = spark.createDataFrame([("~/L/x",), ("L/y",), ("L/none",), (None,), ("",)], "source_ref string")
    got = {r.source_ref: r.path for r in paths.manifest_paths(rows, manifest).collect()}
    assert got == {"~/L/x": "zz/zz9", "L/y": "cc/cc3", "L/none": None, None: None, "": None}


def test_files_are_hashed(spark, folder):
    import hashlib
    root = put(folder(), "a.bin", "content")
    (row,) = dicts(paths.scan_files(spark, root))
    assert row == {"path": f"{root}/a.bin", "bytes": 7, "digest": hashlib.sha256(b"content").hexdigest()[:16]}


def test_only_absent_tables_are_empty(spark, sqlite_file):
    import sqlite3

    from parlance.sources import sqlite_ro

    sqlite_ro.register(spark)
    path = sqlite_file("CREATE TABLE k (name TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID; CREATE TABLE s (n INTEGER)",
                       {"k": [("a", 1), ("b", 2)], "s": [(1,)]})
    con = sqlite3.connect(path)
    con.executemany("INSERT INTO s (rowid, n) VALUES (?, ?)", [(2 ** 62, 2), (2 ** 61, 3)])
    con.commit()
    con.close()

    def read(table, ddl):
        return spark.read.format("sqlite_ro").schema(ddl).option("path", path).option("table", table).load()

    assert sorted(map(tuple, read("k", "name string, n bigint").collect())) == [("a", 1), ("b", 2)]
    assert sorted(r.n for r in read("s", "n bigint").collect()) == [1, 2, 3]
    assert read("absent", "n bigint").count() == 0
    broken = path + ".txt"
    with open(broken, "w") as f:
        f.write("no database" * 200)
    with pytest.raises(Exception, match="database"):
        spark.read.format("sqlite_ro").schema("n bigint").option("path", broken).option("table", "s").load().count()
