import random
import sqlite3

from conftest import dicts
from pyspark.sql import functions as F

from parlance.operators import reactions, sinks
from parlance.plans import live
from parlance.session import new_folder
from parlance.streaming import jobs
from test_upkeep import FILE, canonical, empty_archive, row, specs


def test_store_is_followed_by_row_id(spark, sqlite_file):
    path = sqlite_file("CREATE TABLE t (pk INTEGER PRIMARY KEY, v TEXT)", {"t": [(k, f"v{k}") for k in range(1, 101)]})
    sink, checkpoint = new_folder(spark, "sink"), new_folder(spark, "checkpoint")

    def run():
        stream = jobs.follow_store(spark, path, "t", "pk bigint, v string", rows_per_partition=30)
        jobs.run_available(stream, jobs.batch_folder(sink), checkpoint)
        return spark.read.parquet(sink)

    assert run().select("pk").distinct().count() == 100
    con = sqlite3.connect(path)
    con.execute("INSERT INTO t VALUES (101, 'late')")
    con.commit()
    con.close()
    rows = run()
    assert rows.count() == 101
    newest = rows.agg(F.max("batch_id")).first()[0]
    assert [r.pk for r in rows.filter(F.col("batch_id") == newest).collect()] == [101]


def stream_of(spark, df, files):
    path = new_folder(spark, "landed")
    df.repartition(files).write.parquet(path)
    return jobs.follow_files(spark, path, df.schema, 1)


def test_reaction_stream_equals_batch_fold_in_any_order(spark):
    rng = random.Random(5)
    rows = [(1, f"m{rng.randrange(6)}", 2000 + rng.randrange(6), rng.random() < 0.6, f"s{k % 4}", k, k // 3, k) for k in range(400)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "chat_id long, target string, tapback int, added boolean, sender string, ts long, at long, at_id long")
    sink = new_folder(spark, "sink")
    jobs.run_available(stream_of(spark, events, 5), jobs.batch_fold(jobs.reaction_events, sink), new_folder(spark, "c"))
    state = jobs.reaction_state(spark.read.parquet(sink).drop("batch_id"))
    again = jobs.compacted(spark, sink, lambda df: reactions.last_event(df, keep_order=True))
    assert jobs.reaction_state(spark.read.parquet(again).drop("batch_id")).exceptAll(state).isEmpty()
    keys = ["target", "tapback"]
    assert dicts(state.select(*sorted(state.columns)), *keys) == dicts(reactions.last_event(events).select(*sorted(state.columns)), *keys)
    assert spark.read.parquet(sink).select("batch_id").distinct().count() > 1


def test_archive_stream_adds_each_row_once(spark):
    root, names = new_folder(spark, "archive"), ["person", "person_alias", "handle", "device", "chat", "message", "source_ref", "chat_participant", "attachment"]
    sinks.write_archive(empty_archive(spark), root, 2)
    rows = canonical(spark, *[row(str(k), k, sender=f"p{k % 3}", chat=str(k % 2)) for k in range(40)])
    chats = specs(spark, "0", "1")
    writer = jobs.archive_upsert(root, lambda s: chats, names, new_folder(spark, "n"))
    jobs.run_available(stream_of(spark, rows.unionByName(rows), 2), writer, new_folder(spark, "c"))
    stored = sinks.read_archive(spark, root, names)
    assert stored["message"].count() == stored["source_ref"].count() == 40
    assert stored["message"].select("id").distinct().count() == 40
    assert {r.display_name for r in stored["person"].collect()} == {"Owner", "p0", "p1", "p2"}
    writer(rows, 99)
    assert sinks.read_archive(spark, root, ["message"])["message"].count() == 40


def test_deliveries_are_counted_once(spark):
    rows = spark.createDataFrame([("s", str(k), 1_700_000_000 + k) for k in range(50)], "source string, external_id string, ts long")
    sink = new_folder(spark, "sink")
    jobs.run_available(jobs.once(stream_of(spark, rows.unionByName(rows).unionByName(rows), 3)), jobs.batch_folder(sink), new_folder(spark, "c"))
    assert spark.read.parquet(sink).count() == 50


def test_late_first_deliveries_stay(spark):
    rows = [("s", str(k), 1_700_000_000 - k * 10 * 86400) for k in range(6)]
    df = spark.createDataFrame(rows, "source string, external_id string, ts long")
    path, sink = new_folder(spark, "landed"), new_folder(spark, "sink")
    for k in range(6):
        df.filter(F.col("external_id") == str(k)).coalesce(1).write.mode("append").parquet(path)
    jobs.run_available(jobs.once(jobs.follow_files(spark, path, df.schema, 1), "1 day"), jobs.batch_folder(sink), new_folder(spark, "c"))
    assert spark.read.parquet(sink).count() == 6


def test_late_messages_are_counted(spark):
    rows = [(1, 1_700_000_000 - k * 10 * 86400, "none", "new") for k in range(4)] * 2
    df = spark.createDataFrame(rows, "chat_id long, ts long, media_status string, sync_state string")
    sink = new_folder(spark, "sink")
    jobs.run_available(stream_of(spark, df, 4), jobs.batch_fold(jobs.day_counts, sink), new_folder(spark, "c"))
    assert sorted(r.n for r in jobs.summed_day_counts(spark.read.parquet(sink).drop("batch_id")).collect()) == [2, 2, 2, 2]


def test_a_batch_cut_off_after_any_write_is_completed(spark, monkeypatch):
    names = ["person", "person_alias", "handle", "device", "chat", "message", "source_ref", "chat_participant", "attachment"]
    rows = canonical(spark, *[row(str(k), k, sender=f"+49 {k % 3}", chat="0", attachments=[FILE] if k % 2 else []) for k in range(12)])
    chats = specs(spark, "0")
    append = sinks.append_rows
    for cut in (1, 2, 5, 7):
        root, notices = new_folder(spark, "archive"), new_folder(spark, "n")
        sinks.write_archive(empty_archive(spark), root, 2)
        writer = jobs.archive_upsert(root, lambda s: chats, names, notices, by_handle=True)
        writer(canonical(spark, row("first", 0, sender="+49 0", chat="0")), 0)
        done = []

        def failing(df, root, table):
            append(df, root, table)
            done.append(table)
            if len(done) == cut:
                raise RuntimeError("lost")

        monkeypatch.setattr(sinks, "append_rows", failing)
        try:
            writer(rows, 1)
        except RuntimeError:
            pass
        monkeypatch.setattr(sinks, "append_rows", append)
        writer(rows, 1)
        writer(rows, 1)
        stored = jobs.complete_rows(sinks.read_archive(spark, root, names))
        counts = {n: stored[n].count() for n in ("message", "source_ref", "person", "handle", "chat", "attachment")}
        assert counts == {"message": 13, "source_ref": 13, "person": 4, "handle": 3, "chat": 1, "attachment": 6}, (cut, counts)
        assert spark.read.parquet(notices).agg(F.sum("new")).first()[0] == 12


def test_landed_rows_come_in_runs_of_many_files(spark):
    rows = spark.range(8000).repartition(8).select((F.col("id") % 4000).alias("at"), F.when(F.col("id") >= 0, F.col("id")).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(None, 8000)], rows.schema))
    came = []

    def take(batch, number):
        found = [(r["at"], r["n"]) for r in batch.collect()]
        came.append((batch.rdd.getNumPartitions(), found))

    jobs.run_available(live.landed(rows, F.col("at")), take, jobs.checkpoint_folder(spark))
    assert len(came) == 4 and all(tasks > 1 for tasks, _ in came)
    assert sorted(n for _, found in came for _, n in found) == list(range(8001))
    ends = [(min(a for a, _ in found if a is not None), max(a for a, _ in found if a is not None)) for _, found in came]
    assert all(newer[0] > older[1] for newer, older in zip(ends, ends[1:])) and (None, 8000) in came[-1][1]


def test_landing_nothing_gives_nothing(spark):
    rows = spark.range(0).withColumnRenamed("id", "at")
    root = live.collected(live.landed(rows, F.col("at")), spark)
    assert spark.read.parquet(root).count() == 0
