"""Kept aggregates equal full recomputation after any mix of changes."""

import random

from conftest import dicts
from pyspark.sql import functions as F

from parlance.operators import kept, overview

MESSAGES = "id long, chat_id long, sender_person_id long, ts long, is_me boolean, text string, media_status string, sync_state string"
MEDIA = "id long, message_id long, kind string, src string, bytes long"
DAY = 86_400


def message(rng, k):
    me = rng.random() < 0.4
    return {"id": k, "chat_id": rng.randrange(4), "sender_person_id": 9 if me else rng.choice([1, 2, None]), "ts": 1_700_000_000 + rng.randrange(6 * DAY), "is_me": me, "text": "t",
            "media_status": rng.choice(["none", "ready", "pending"]), "sync_state": rng.choice(["new", "published"])}


def media_of(rng, m, at):
    return [{"id": at + k, "message_id": m["id"], "kind": rng.choice(["image", "video", "file"]), "src": rng.choice(["s", None]), "bytes": rng.choice([None, 5])} for k in range(rng.randrange(3))]


def test_any_mix_of_changes(spark):
    rng = random.Random(9)
    persons = spark.createDataFrame([(1, "a", "x.png"), (2, "b", "y.png"), (9, "me", None)], "id long, display_name string, avatar_src string")
    messages = {k: message(rng, k) for k in range(60)}
    media = {m["id"]: m for k in messages for m in media_of(rng, messages[k], 10 * k)}

    def frames(rows, ddl):
        return spark.createDataFrame(list(rows), ddl)

    state = kept.start(frames(messages.values(), MESSAGES), frames(media.values(), MEDIA)).stored()
    for turn in range(6):
        before, files = dict(messages), dict(media)
        if turn in (0, 3):  # an import
            for k in range(100 * (turn + 1), 100 * (turn + 1) + 12):
                messages[k] = message(rng, k)
                media.update({m["id"]: m for m in media_of(rng, messages[k], 10 * k)})
        elif turn == 1:  # edits and completed media
            for k in rng.sample(sorted(messages), 20):
                messages[k] = dict(messages[k], text="edited", media_status="ready", sync_state="new")
        elif turn == 2:  # a chat is read
            messages = {k: dict(m, sync_state="published") if m["chat_id"] == 1 else m for k, m in messages.items()}
        elif turn == 4:  # a chat is purged
            messages = {k: m for k, m in messages.items() if m["chat_id"] != 2}
            media = {k: m for k, m in media.items() if m["message_id"] in messages}
        else:  # the earliest and latest messages go
            for k in sorted(messages, key=lambda k: messages[k]["ts"])[:5] + sorted(messages, key=lambda k: -messages[k]["ts"])[:5]:
                del messages[k]
            media = {k: m for k, m in media.items() if m["message_id"] in messages}
        leaving = [m for k, m in before.items() if messages.get(k) != m]
        entering = [m for k, m in messages.items() if before.get(k) != m]
        gone, come = [m for k, m in files.items() if k not in media], [m for k, m in media.items() if k not in files]
        now, then = frames(messages.values(), MESSAGES), frames(before.values(), MESSAGES)
        state = kept.after(state, frames(entering, MESSAGES), frames(leaving, MESSAGES), now, kept.owned(frames(come, MEDIA), now), kept.owned(frames(gone, MEDIA), then)).stored()
        stored = frames(media.values(), MEDIA)
        for name, got, want, key in (("activity", kept.activity(state, persons), overview.chat_activity(now, persons), "chat_id"), ("media", kept.media_stats(state), overview.media_stats(now, stored), "chat_id"),
                                     ("days", kept.day_counts(state), overview.day_counts(now), "chat_id"), ("updates", kept.update_counts(state), overview.update_counts(now), "chat_id")):
            columns = sorted(want.columns)
            assert sorted(got.columns) == columns
            assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())), (turn, name)
