"""Media are counted in shares that the number of shuffle partitions sets, not in those of the scan."""

from pyspark.sql import functions as F

from parlance.operators import joins, overview

MEDIA = "id long, message_id long, kind string, src string, bytes long"


def media_of(spark):
    rows = [(1, 1, "image", "a", 5), (2, 1, "image", "a", 7), (3, 2, "video", "a", 5), (4, 2, "image", "b", None), (5, 3, "x", "c", 1), (6, None, "image", "b", 2), (7, 3, "image", None, 9)]
    return spark.createDataFrame(rows, MEDIA)


def messages_of(spark):
    return spark.createDataFrame([(1, 10, True), (2, 20, False), (3, 10, False)], "id long, chat_id long, is_me boolean")


def dealt_before_counting(df) -> bool:
    """Whether each count per message lies on rows that were dealt for it."""
    return df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_uses_of_files(spark):
    got = joins.used_only_by(media_of(spark), messages_of(spark), spark.createDataFrame([(10,)], "chat_id long"))
    assert dealt_before_counting(got)
    assert sorted((r["src"], r["exclusive"], r["bytes"]) for r in got.collect()) == [("a", False, 7), ("c", True, 1)]


def test_media_counts(spark):
    got = overview.media_counts(messages_of(spark), media_of(spark))
    assert dealt_before_counting(got)
    assert sorted((r["chat_id"], r["kind"], r["is_me"], r["n"], r["bytes"]) for r in got.collect()) == [
        (10, "image", True, 2, 12), (10, "other", False, 1, 1), (20, "image", False, 1, 0), (20, "video", False, 1, 5)]


def test_one_share_per_shuffle_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        shares = joins.dealt(spark.range(1000), "id").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert shares == 7
