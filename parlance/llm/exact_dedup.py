"""Exact deduplication with DataFrame functions only.

Texts count as equal when they are identical after each run of white space became one space. Rows meet by their 128-bit
digest together with the text itself, so equality is always that of bytes: the digest decides the partition, the text
the group, and copies collapse before the shuffle. Rows then find their group by the digest alone; only where two texts
share a digest do the rows of that digest meet by their texts again.

Null texts count as empty. A row repeated with id and text is a copy like any other: one row of the group is kept.
Null ids come last. An empty table gives no rows.
Texts of any length are compared whole. Other columns are not read, whatever their names; ``without_copies`` hands them on,
but names that begin with ``_llm_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, materialise, whole_text


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), f"[{SPACE}]+", " ")


def _rows(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("_text"))
    return rows.withColumn("_key", digest(F.col("_text").cast("binary")))


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(docs: DataFrame, digest) -> DataFrame:
    rows = _rows(docs, digest)
    sha = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    sizes = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    groups = materialise(rows.groupBy("_key", "_text").agg(*sizes).select("_key", sha, "keep_id", "group_size"),
                         "exact-groups")
    shared = groups.groupBy("_key").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_key")
    # A row repeated with its id counts here, and is spelled out again below with a number.
    members = rows.groupBy("_key", "doc_id").agg(F.count(F.lit(1)).alias("_times"))
    if shared.isEmpty():
        found = members.join(groups, "_key")
    else:
        shared = materialise(shared, "shared-digests")
        meeting = rows.join(shared, "_key", "left_semi")
        apart = meeting.groupBy("_key", "_text").agg(*sizes).withColumn("text_sha256", sha)
        found = members.join(groups.join(shared, "_key", "left_anti"), "_key").unionByName(
            meeting.groupBy("_key", "_text", "doc_id").agg(F.count(F.lit(1)).alias("_times"))
            .join(apart, ["_key", "_text"]).drop("_text"))
    return found.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1))


def exact_groups(docs: DataFrame, digest=_md5) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256. ``digest`` maps binary to its hash."""
    return _groups(docs, digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, digest=_md5) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stay = _groups(docs, digest).filter("kept").select(ident.alias("_llm_id"), F.col("text_sha256").alias("_llm_sha"))
    sha = F.sha2(normalised().cast("binary"), 256)
    return (docs.withColumn("_llm_id", ident).withColumn("_llm_sha", sha)
            .join(stay, ["_llm_id", "_llm_sha"], "left_semi").dropDuplicates(["_llm_id", "_llm_sha"])
            .select(*docs.columns))
