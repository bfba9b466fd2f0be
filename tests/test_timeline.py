import json
import random

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from parlance.model import EDIT, REACTION
from parlance.operators import overview, sinks, timeline

MESSAGE = f"""id long, chat_id long, sender_person_id long, ts long, is_me boolean, text string, retracted boolean, edits array<{EDIT}>,
    reactions array<{REACTION}>, apps array<string>, media_status string, sync_state string"""
MEDIA = "id long, message_id long, kind string, src string, cat string, portrait boolean, bytes long"


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1, 400):
        chat = 1 if rng.random() < 0.8 else rng.randrange(2, 5)
        rows.append((k, chat, rng.randrange(1, 4), 1_700_000_000 + rng.randrange(0, 500) * 600, rng.random() < 0.4, f"t{k}", False, None, None,
                     None, rng.choice(["none", "ready", "pending"]), rng.choice(["new", "published"])))
    return rows, spark.createDataFrame(rows, MESSAGE).repartition(5)


def shown(rows, chat):
    return sorted((r[3], r[0]) for r in rows if r[1] == chat and r[10] != "pending")


def pages(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.chat_id, []).append((r.ts, r.id))
    return {c: sorted(v) for c, v in out.items()}


def test_pages_put_together_are_the_timeline(messages):
    rows, df = messages
    at = 1_700_150_000
    older, newer = pages(timeline.before(df, at, 500)), pages(timeline.since(df, at - 1, 500))
    for chat in (1, 2, 3, 4):
        assert older.get(chat, []) + newer.get(chat, []) == shown(rows, chat)


def test_latest_and_has_more(messages):
    rows, df = messages
    got = timeline.latest(df, 30)
    assert pages(got) == {c: shown(rows, c)[-30:] for c in (1, 2, 3, 4)}
    assert {r.chat_id: r.has_more for r in got.select("chat_id", "has_more").distinct().collect()} == {
        c: len(shown(rows, c)) >= 30 for c in (1, 2, 3, 4)}


def test_keyset_paging_loses_no_tied_rows(messages):
    rows, df = messages
    seen, at, mid = [], 2_000_000_000, 0
    while True:
        page = sorted(((r.ts, r.id) for r in timeline.before(df.filter("chat_id = 1"), at, 50, mid).collect()), reverse=True)
        if not page:
            break
        seen += page
        at, mid = page[-1]
    assert sorted(seen) == shown(rows, 1)


def test_clamp():
    assert [timeline.clamp_page(n) for n in (None, 0, -3, 7, 9999)] == [50, 1, 1, 7, 500]


def test_around(messages):
    rows, df = messages
    at = 1_700_150_000
    got = pages(timeline.around(df, at, 3, 2))[1]
    all_rows = shown(rows, 1)
    assert got == [x for x in all_rows if x[0] < at][-3:] + [x for x in all_rows if x[0] >= at][:2]
    assert all(ts >= at for ts, _ in pages(timeline.around(df, at, 0, 5))[1])


def test_page_records_leave_out_empty_fields(spark):
    edits = [("old", 1), ("new", 2)]
    m = spark.createDataFrame([(1, 1, 7, 5, True, "hi", False, None, None, ["x"], "ready", "new"), (2, 1, None, 6, False, None, True, edits, None, None, "none", "new")], MESSAGE)
    media = spark.createDataFrame([(2, 1, "image", "b.jpg", "foto", True, 1), (1, 1, "image", "a.jpg", None, False, 1), (3, 1, "other", None, None, False, 0)], MEDIA)
    persons = spark.createDataFrame([(7, "Ann", "av.png")], "id long, display_name string, avatar_src string")
    one, two = [json.loads(r["record"]) for r in dicts(timeline.render_page(m, persons, media), "id")]
    assert one == {"t": "msg", "ts": 5, "me": True, "sender": "Ann", "text": "hi", "sender_avatar": "av.png", "apps": ["x", "📎 Anhang fehlt"],
                   "media": [{"kind": "image", "src": "a.jpg"}, {"kind": "image", "src": "b.jpg", "cat": "foto", "portrait": True}]}
    assert two == {"t": "msg", "ts": 6, "me": False, "sender": "?", "edits": [{"text": "old", "ts": 1}, {"text": "new", "ts": 2}], "retracted": True}


def test_new_count(spark):
    m = spark.createDataFrame([(k, 1, 1, k, False, "x", False, None, None, None, "none", "new" if k == 3 else "published") for k in (1, 2, 3)], MESSAGE)
    row = overview.message_counts(m).first()
    assert (row.total, row.new_count, row.me, row.them) == (3, 1, 0, 3)


def test_avatar_only_where_the_counterpart_has_one(spark):
    m = spark.createDataFrame([(1, 1, 2, 1, False, "x", False, None, None, None, "none", "new"), (2, 1, 1, 2, True, "x", False, None, None, None, "none", "new"),
                               (3, 2, 3, 1, False, "x", False, None, None, None, "none", "new")], MESSAGE)
    chats = spark.createDataFrame([(1, False), (2, False)], "id long, is_group boolean")
    persons = spark.createDataFrame([(1, "O", "o.png"), (2, "A", "a.png"), (3, "B", None)], "id long, display_name string, avatar_src string")
    assert dicts(overview.counterpart_avatars(m, chats, persons)) == [{"chat_id": 1, "chat_avatar": "a.png"}]


@pytest.mark.parametrize("counts, levels", [([1, 4, 0, 2], [1, 4, 0, 2]), ([100, 10, 11, 25, 26, 50, 75, 76], [5, 1, 2, 2, 3, 3, 4, 5])])
def test_heatmap_levels(spark, counts, levels):
    rows = [(1, f"2024-01-{k + 1:02d}", n) for k, n in enumerate(counts) if n]
    days = spark.createDataFrame(rows, "chat_id int, d string, n long").select("chat_id", F.to_date("d").alias("day"), "n")
    got = dicts(overview.heatmap(days), "day")
    assert [r["level"] for r in got] == levels and [r["weekday"] for r in got[:3]] == [0, 1, 2]


def test_dialogue_line_and_header(spark):
    m = spark.createDataFrame([(1, 1, 7, 1_525_955_400, False, "hi", False, None, None, ["🎵 Music shared"], "ready", "new")], MESSAGE)
    media = spark.createDataFrame([(2, 1, "video", "v", None, False, 1), (1, 1, "image", "a", "foto", False, 1), (3, 1, "image", "c", "sticker", False, 1),
                                   (4, 1, "other", None, None, False, 0)], MEDIA)
    persons = spark.createDataFrame([(7, "Ann", None)], "id long, display_name string, avatar_src string")
    chats = spark.createDataFrame([(1, "d/c")], "id long, slug string")
    (line,) = sinks.dialogue_lines(m, media, persons, chats).collect()
    assert line.record == "[Donnerstag, 10.05.2018 12:30:00] Ann: [Bild] [Video] [Sticker] [Anhang fehlt] [🎵 Music shared] hi"


def test_search_finds_all_three_kinds(spark):
    m = spark.createDataFrame([(k, 1, 1, k, False, t, False, None, None, None, "none", "new") for k, t in ((1, "A Needle"), (2, None), (3, "x"))], MESSAGE)
    media = spark.createDataFrame([(1, 2, "audio", "a", None, False, 1), (2, 3, "image", "b", None, False, 1)], MEDIA)
    spoken = spark.createDataFrame([("a", "the NEEDLE")], "src string, text string")
    read = spark.createDataFrame([("b", "needles"), ("z", "needle")], "src string, text string")
    got = dicts(timeline.search(m, media, spoken, read, "needle"), "message_id")
    assert [(r["message_id"], r["found_in"]) for r in got] == [(1, "text"), (2, "transcript"), (3, "image")]
    assert [r["message_id"] for r in dicts(timeline.search(m, media, spoken, read, "needle$", regex=True), "message_id")] == [1, 2]
