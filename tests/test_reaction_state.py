"""Keyed reaction state equals the batch fold over batches, restarts, replays and expiry."""

import random

import pandas as pd
from conftest import dicts

from parlance.operators import reactions
from parlance.session import new_folder
from parlance.streaming import jobs, reaction_state

DDL = "chat_id long, target string, tapback int, added boolean, sender string, ts long, at long, at_id long"


def events_of(seed, n=120, targets=5):
    rng = random.Random(seed)
    rows = [(1 + k % 2, f"m{rng.randrange(targets)}", 2000 + rng.randrange(3), rng.random() < 0.6, None if k % 7 == 0 else f"s{k % 4}", None if k % 9 == 0 else k, k // 3, k)
            for k in range(n)]
    rng.shuffle(rows)
    return rows


def run(spark, folder, sink, checkpoint, per_sender=False, quiet=reaction_state.QUIET):
    stream = jobs.follow_files(spark, folder, spark.createDataFrame([], DDL).schema, 1)
    query = jobs.start(reaction_state.changed_reactions(stream, per_sender, quiet), jobs.batch_folder(sink), checkpoint, "update", available_now=True)
    query.awaitTermination()
    return query


def land(spark, rows, folder):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def state(df, keys):
    return dicts(df.select(*sorted(df.columns)), *keys)


def test_state_over_batches_restarts_and_expiry(spark):
    rows, sink, folder, checkpoint = events_of(3), new_folder(spark, "sink"), new_folder(spark, "landed"), new_folder(spark, "c")
    keys = ["chat_id", "target", "tapback"]
    for a in (0, 40):
        land(spark, rows[a:a + 40], folder)
    run(spark, folder, sink, checkpoint)
    land(spark, rows[80:], folder)
    land(spark, rows[:30], folder)  # a replay
    query = run(spark, folder, sink, checkpoint)
    handed_on = spark.read.parquet(sink).drop(jobs.BATCH)
    want = reactions.last_event(spark.createDataFrame(rows, DDL)).filter("added").drop("added")
    assert state(reaction_state.state_of(handed_on), keys) == state(want, keys)
    assert handed_on.count() < len(rows)
    assert query.lastProgress["stateOperators"][0]["customMetrics"]
    # A quiet time of nothing: each batch finds the state of the one before expired, and the fold is the same.
    again, other = new_folder(spark, "sink"), new_folder(spark, "c")
    run(spark, folder, again, other, quiet=1)
    assert state(reaction_state.state_of(spark.read.parquet(again).drop(jobs.BATCH)), keys) == state(want, keys)


def test_people_apart(spark):
    rows, sink, folder = events_of(5, 60, 2), new_folder(spark, "sink"), new_folder(spark, "landed")
    rows = [(*r[:4], r[4] or "s9", *r[5:]) for r in rows]
    land(spark, rows, folder)
    run(spark, folder, sink, new_folder(spark, "c"), per_sender=True)
    want = reactions.last_event(spark.createDataFrame(rows, DDL), True).filter("added").drop("added")
    keys = ["chat_id", "target", "tapback", "sender"]
    assert state(reaction_state.state_of(spark.read.parquet(sink).drop(jobs.BATCH), True), keys) == state(want, keys)


def test_a_message_that_changes_costs_one_frame(monkeypatch):
    class State:
        hasTimedOut = exists = False

        def getCurrentWatermarkMs(self):
            return 5

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, at):
            self.ends = at

    rows = [(2000, True, "a", 7, 10, 1), (2000, False, None, None, 11, 2), (2001, True, "b", 8, 10, 3), (2001, True, "c", 9, 9, 4)]
    part = pd.DataFrame(rows, columns=["tapback", *reaction_state.FIELDS]).assign(**{reaction_state.ARRIVED: pd.Timestamp("2024-01-01 00:00:01.234567")})

    def again(*_, **__):
        raise AssertionError("types changed after the frame was made")

    monkeypatch.setattr(pd.DataFrame, "astype", again)
    state = State()
    (out,) = reaction_state.last_events(["chat_id", "target"], False, 1000)((3, "t"), iter([part]), state)
    assert [str(t) for t in out.dtypes[2:]] == ["int32", "bool", str(out["sender"].dtype), "Int64", "int64", "int64"]
    assert [tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False)] == [
        (3, "t", 2000, False, None, None, 11, 2), (3, "t", 2001, True, "b", 8, 10, 3)]
    assert state.ends == 1704067201234 + 1000
