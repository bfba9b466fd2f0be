import io

import pytest
from conftest import dicts

from parlance.operators import export_text
from parlance.sources import chat_export

CHAT = """[03.02.21, 07:15:02] Mira: Is the boat dry yet
[03.02.21, 07:16:40] Jonas: nearly: two more coats
[03.02.21, 07:20:11] Mira: here is the hull \u200e<attached: hull-9.jpg>
[03.02.21, 07:21:00] Jonas: \u200e<attached: answer-3.opus>
[03.02.21, 07:25:59] Mira: This message was deleted.
[03.02.21, 07:30:00] Jonas: see you at the pier
"""


def write(root: str, name: str, text: str) -> str:
    import os
    os.makedirs(f"{root}/{name}", exist_ok=True)
    with open(f"{root}/{name}/_chat.txt", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return root


def read(spark, root, split=64 << 20):
    chat_export.register(spark)
    return spark.read.format("chat_export").option("path", root).option("split_bytes", str(split)).load()


def test_sample_chat(spark, folder):
    rows = dicts(export_text.canonical(read(spark, write(folder(), "a", CHAT)), "Mira"), "ts")
    assert [r["external_id"] for r in rows] == ["1", "2", "3", "4", "5", "6"] and {r["source"] for r in rows} == {"whatsapp_export:a"}
    assert [r["retracted"] for r in rows] == [False] * 4 + [True, False]
    assert [a["filename"] for r in rows for a in r["attachments"]] == ["hull-9.jpg", "answer-3.opus"]
    assert rows[2]["text"] == "here is the hull" and rows[3]["text"] is None and rows[3]["attachments"][0]["mime"] == "audio/ogg"
    assert [r["is_me"] for r in rows[:2]] == [True, False] and rows[1]["text"] == "nearly: two more coats"
    assert rows[0]["ts"] == 1612336502


def test_every_message_of_every_folder_is_imported(spark, folder):
    """Replacing chats by their full export keeps them message by message."""
    from parlance.operators import upkeep
    from test_upkeep import empty_archive, specs

    root = folder()
    for name in ("a", "b"):
        write(root, name, CHAT + "[03.02.21, 07:30:00] Jonas: see you at the pier\n")
    rows = export_text.canonical(read(spark, root), "Mira")
    archive = empty_archive(spark)
    chats = specs(spark, "a", "b")
    for _ in range(2):
        archive = upkeep.replace_chats(archive, chats.select("slug"))
        archive = upkeep.apply_changes(archive, upkeep.import_new(rows, chats, archive))
        got = dicts(archive["message"].select("chat_id", "ts", "text", "external_id"), "chat_id", "external_id")
        assert len(got) == 14 and len({r["chat_id"] for r in got}) == 2
        assert [r["text"] for r in got[:7]] == [r["text"] for r in got[7:]]


def test_one_message_of_very_many_lines(spark):
    lines = [("f", 0, "[01.02.24, 08:00:00] A: first")] + [("f", k, f"line {k}") for k in range(1, 100_001)]
    row = export_text.assemble(export_text.parse_lines(spark.createDataFrame(lines, "folder string, pos long, line string"))).first()
    assert row.body.count("\n") == 100_000 and row.body.endswith("line 100000")


def test_markers(spark, folder):
    text = ("lost line\n[01.02.24, 08:00:00] A: first\nsecond\n\nthird \n"
            "[01.02.24, 08:00:01] A: Messages and calls are end-to-end encrypted. No one\n"
            "[01.02.24, 08:00:02] B: Missed voice call\n[01.02.24, 08:00:03] B: Voice call now\n"
            "[01.02.24, 08:00:04] A: <ANHANG: x.PDF> see <bijlage:y.mp4>\n[32.13.24, 08:00:05] A: bad date\n"
            "[01.02.24, 08:00:06] B: You deleted this message. really\n")
    lines = read(spark, write(folder(), "a", text))
    rows = dicts(export_text.canonical(lines, "A"), "ts")
    assert [r["text"] for r in rows] == ["first\nsecond\n\nthird", None, "Voice call now", "see", None]
    assert rows[1]["apps"] == ["Missed voice call"] and rows[4]["retracted"]
    assert [(a["filename"], a["mime"]) for a in rows[3]["attachments"]] == [("x.PDF", "application/pdf"), ("y.mp4", "video/mp4")]
    bad = dicts(export_text.parse_failures(export_text.assemble(export_text.parse_lines(lines)), 9))
    assert [(e["kind"], e["observed"], e["detail"]) for e in bad] == [("row_parse_failed", "ValueError", "header date in a")]


@pytest.mark.parametrize("line, stamp, key", [
    ("[14.03.24, 21:05:09] A B: x:y", "2024-03-14 21:05:09", "bracket_dd_mm_yy_24h"),
    ("[3/14/24, 9:05:09 PM] A B: x:y", "2024-03-14 21:05:09", "bracket_mdy_12h"),
    ("[3/14/2024, 12:05:09 am] A B: x:y", "2024-03-14 00:05:09", "bracket_mdy_12h"),
    ("[14/03/2024, 21:05:09] A B: x:y", "2024-03-14 21:05:09", "bracket_dmy_24h_slash"),
    ("3/14/24, 9:05 PM - A B: x:y", "2024-03-14 21:05:00", "nobracket_mdy_12h_dash"),
    ("3/14/24, 21:05 - A B: x:y", "2024-03-14 21:05:00", "nobracket_mdy_12h_dash")])
def test_header_formats(spark, line, stamp, key):
    import datetime
    row = export_text.parse_lines(spark.createDataFrame([("f", 0, line)], "folder string, pos long, line string")).first()
    want = datetime.datetime.fromisoformat(stamp + "+00:00").timestamp()
    assert (row.header, row.ts, row.sender, row.line) == (key, want, "A B", "x:y")


def test_wall_clock_zone(spark):
    row = export_text.parse_lines(spark.createDataFrame([("f", 0, "[14.07.24, 12:00:00] A: x")], "folder string, pos long, line string"), "Europe/Berlin").first()
    assert row.ts == 1720951200


def test_probes(spark, folder):
    root = folder()
    write(root, "good", CHAT)
    write(root, "empty", "just words\n")
    write(root, "odd", "2024-03-14 10:00 A: hi\nmore\n")
    write(root, "locale", "[01.02.24, 08:00:00] A: <Bilaga: a.jpg>\n[01.02.24, 08:00:01] A: <vedhæftet: b.jpg> <http://x: c.jpg>\n")
    rows = dicts(export_text.probe_formats(read(spark, root), 1), "folder")
    assert [(r["folder"], r["severity"], r["kind"], r["observed"]) for r in rows] == [
        ("locale", "warn", "unknown_export_locale", "Bilaga"), ("odd", "fatal", "unknown_export_format", "2024-03-14 10:00 A: hi")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_byte_ranges_give_every_line_once(size):
    data = "a\n\nbb\r\nümlaut\rx\n\n[last".encode()
    whole = list(chat_export.range_lines(io.BytesIO(data), 0, len(data)))
    parts = [row for at in range(0, len(data), size) for row in chat_export.range_lines(io.BytesIO(data), at, min(at + size, len(data)))]
    assert parts == whole
    assert [line for _, line in whole] == data.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n")


def test_splits_and_chunks_do_not_matter(spark, folder):
    root = folder()
    for k in range(3):
        write(root, f"c{k}", CHAT + "tail line\n" * 5 + CHAT)
    whole = dicts(export_text.assemble(export_text.parse_lines(read(spark, root))), "folder", "message_no")
    split = dicts(export_text.assemble(export_text.parse_lines(read(spark, root, 100)), 64), "folder", "message_no")
    assert whole == split and len(whole) == 36
