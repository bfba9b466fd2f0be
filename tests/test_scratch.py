"""Intermediate results and shuffle files take disk only as long as they are needed."""

import os
import time

import pytest
from conftest import dicts
from pyspark.sql import functions as F
from test_streaming import canonical, empty_archive, row, specs

from parlance import session
from parlance.operators import ranges, sinks
from parlance.plans import live
from parlance.session import SHUFFLES_GO, materialise, new_folder, passing, scratch
from parlance.streaming import jobs

NAMES = ["person", "person_alias", "handle", "device", "chat", "message", "source_ref", "chat_participant", "attachment"]


@pytest.fixture
def work(folder, monkeypatch):
    """The shared folder, empty."""
    path = folder("work")
    monkeypatch.setattr(session, "work_root", lambda spark: path)
    return path


def labels(work):
    return sorted({f.rsplit("-", 1)[0] for f in os.listdir(work)})


def test_a_block_leaves_nothing(spark, work):
    kept = materialise(spark.range(5), "kept")
    with pytest.raises(RuntimeError), scratch(spark):
        with scratch(spark):
            assert materialise(kept, "inner").count() == 5
        assert labels(work) == ["kept"] and spark.conf.get(SHUFFLES_GO) == "true"
        spark.range(1).write.parquet(passing(new_folder(spark, "own")))
        materialise(kept, "outer")
        raise RuntimeError("lost")
    assert labels(work) == ["kept"] and spark.conf.get(SHUFFLES_GO, None) is None and kept.count() == 5


def test_shuffle_files_go_with_their_action(spark, folder):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(local.getAllFiles()) if f.getName().startswith("shuffle_")}

    before = shuffles()
    with scratch(spark):
        materialise(spark.range(1000).repartition(3, "id"), "dealt")
        for _ in range(50):
            if shuffles() <= before:
                break
            time.sleep(0.2)
        assert shuffles() <= before


def test_an_upsert_leaves_the_archive_alone(spark, work, folder):
    """Batches leave no intermediate result behind (F6, F7)."""
    root, chats = f"{folder()}/archive", specs(spark, "0")
    sinks.write_archive(empty_archive(spark), root, 2)
    write = jobs.archive_upsert(root, lambda s: chats, NAMES)
    write(canonical(spark, *[row(str(k), k, chat="0") for k in range(20)]), 0)
    assert os.listdir(work) == [] and sinks.read_archive(spark, root, NAMES)["message"].count() == 20


def test_a_live_sync_leaves_archive_and_digests_alone(spark, work, folder):
    """As many buckets as there are shares and more are rewritten a share at a time, and nothing stays aside (F2)."""
    root, chats = f"{folder()}/archive", specs(spark, *[str(k) for k in range(9)])
    sinks.write_archive(empty_archive(spark), root, 8)
    jobs.begin_live(spark, root, NAMES)
    write = jobs.live_upsert(root, lambda s: chats, NAMES)
    write(canonical(spark, *[row(str(k), k, chat=str(k % 9)) for k in range(36)]), 0)
    write(canonical(spark, *[row(str(k), k, chat=str(k % 9), text=f"edited {k}") for k in range(36)]), 1)
    assert labels(work) == ["digests"]
    got = dicts(sinks.read_archive(spark, root, ["message"])["message"].select("external_id", "text"))
    assert {r["external_id"]: r["text"] for r in got} == {str(k): f"edited {k}" for k in range(36)} and len(got) == 36
    assert len({f for f in os.listdir(f"{root}/message") if f.startswith("chat_bucket=")}) > sinks.REWRITES
    assert ranges.read_mark(spark, root).batch == 1


def test_landed_batches_keep_one_copy(spark, work):
    rows = spark.range(100).withColumn("text", F.lit("x"))
    with scratch(spark):
        live.in_batches(rows, F.col("id") % 3)
        assert labels(work) == ["landed"]
    assert os.listdir(work) == []
