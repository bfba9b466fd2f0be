"""Running day counts as event-time windows with bounded state, exact for rows that come days late.

Rows are routed by the highest time of all earlier batches, less ``delay``: what is not older goes on to a window aggregate
with a watermark of that delay, whose state forgets days behind it; what is older is counted on its own, batch by batch. The
watermark of the aggregate never runs ahead of the router's, so the aggregate drops nothing, and both parts add up to the
counts of all rows. Windows are handed on in update mode: the latest value of a day and chat holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import timeline
from parlance.session import materialise
from parlance.streaming import jobs

DELAY_SECONDS = 2 * 86_400
COLUMNS = "chat_id bigint, ts bigint, unread boolean"


def router(root: str, delay: int = DELAY_SECONDS) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: rows in time below ``root/timely``, counts of late rows below ``root/late``, and each batch's
    highest time below ``root/seen``. A repeated batch looks at earlier batches only, and overwrites its own folders."""
    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        shown = materialise(timeline.visible(rows).select("chat_id", "ts", (F.col("sync_state") == "new").alias("unread")), "shown")
        shown.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{root}/seen/{jobs.BATCH}={batch_id}")
        seen = spark.read.schema(f"ts bigint, {jobs.BATCH} bigint").option("basePath", f"{root}/seen").parquet(f"{root}/seen")
        highest = seen.filter(F.col(jobs.BATCH) < batch_id).agg(F.max("ts")).first()[0]
        late = F.lit(False) if highest is None else F.col("ts") < highest - delay
        counted(shown.filter(late)).write.mode("overwrite").parquet(f"{root}/late/{jobs.BATCH}={batch_id}")
        shown.filter(~late).write.mode("overwrite").parquet(f"{root}/timely/{jobs.BATCH}={batch_id}")
    return write


def day_of(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chat_id", day_of(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unread").alias("unread"), F.max("ts").alias("last"))


def windows(timely: DataFrame, delay: int = DELAY_SECONDS) -> DataFrame:
    """Counts per chat and UTC day of a stream of timely rows; its state holds the days within the delay."""
    at = timely.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{delay} seconds")
    day = F.window("at", "1 day")
    return at.groupBy("chat_id", day.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unread").alias("unread"), F.max("ts").alias("last")).select(
        "chat_id", F.unix_timestamp("w.start").alias("start"), "n", "unread", "last")


def follow(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    return jobs.follow_files(spark, f"{root}/timely/*", COLUMNS, files_per_batch)


def day_counts(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """chat_id, day, n, unread and last of all rows: the latest windows in ``sink`` and the counts of late rows."""
    kind = f"chat_id bigint, start bigint, n bigint, unread bigint, last bigint, {jobs.BATCH} bigint"
    handed_on = spark.read.schema(kind).option("basePath", sink).parquet(sink)
    latest = handed_on.groupBy("chat_id", "start").agg(F.max_by(F.struct("n", "unread", "last"), jobs.BATCH).alias("w")).select(
        "chat_id", day_of(F.col("start")).alias("day"), "w.*")
    late = spark.read.parquet(f"{root}/late").drop(jobs.BATCH)
    return latest.unionByName(late).groupBy("chat_id", "day").agg(F.sum("n").alias("n"), F.sum("unread").alias("unread"), F.max("last").alias("last"))
