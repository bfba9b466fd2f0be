"""Event-time windows and late counts together equal the counts of all rows."""

import random

from pyspark.sql import functions as F

from parlance.session import new_folder
from parlance.streaming import day_windows, jobs

DDL = "chat_id long, ts long, media_status string, sync_state string"
DAY = 86_400


def run(spark, rows_by_batch, delay):
    landed, root, sink = new_folder(spark, "landed"), new_folder(spark, "routed"), new_folder(spark, "sink")
    first, second = new_folder(spark, "c"), new_folder(spark, "c")
    for rows in rows_by_batch:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(landed)
        jobs.run_available(jobs.follow_files(spark, landed, spark.createDataFrame([], DDL).schema, 1), day_windows.router(root, delay), first)
        query = jobs.start(day_windows.windows(day_windows.follow(spark, root, 1), delay), jobs.batch_folder(sink), second, "update", available_now=True)
        query.awaitTermination()
    return root, sink, query


def test_rows_days_late_are_counted(spark):
    rng = random.Random(6)
    batches = []
    for b in range(3):
        now = 1_700_000_000 + b * 5 * DAY
        batches.append([(rng.randrange(3), now - rng.choice([0, 1, 2, 20]) * DAY - rng.randrange(DAY), rng.choice(["none", "ready", "pending"]), rng.choice(["new", "published"]))
                        for _ in range(40)])
    root, sink, query = run(spark, batches, DAY)
    want = {}
    for chat, ts, status, state in (r for rows in batches for r in rows):
        if status != "pending":
            n, unread, last = want.get((chat, ts // DAY), (0, 0, 0))
            want[chat, ts // DAY] = n + 1, unread + (state == "new"), max(last, ts)
    got = day_windows.day_counts(spark, root, sink).select("chat_id", F.unix_date("day").alias("d"), "n", "unread", "last").collect()
    assert {(r["chat_id"], r["d"]): (r["n"], r["unread"], r["last"]) for r in got} == want
    assert spark.read.parquet(f"{root}/late").count() > 0
    # Days behind the watermark leave the state, and no row was dropped as late by it.
    progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 0 and progress[-1]["numRowsTotal"] < len(want)


def test_a_repeated_batch_changes_nothing(spark):
    root = new_folder(spark, "routed")
    write, rows = day_windows.router(root, DAY), spark.createDataFrame([(1, 1_700_000_000, "none", "new"), (1, 1_600_000_000, "none", "new")], DDL)
    for batch in (0, 1, 1, 0):
        write(rows, batch)
    timely, late = (spark.read.parquet(f"{root}/{name}") for name in ("timely", "late"))
    assert timely.count() == 3 and late.agg(F.sum("n")).first()[0] == 1
