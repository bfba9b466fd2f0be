"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Toxic documents go, then exact copies, then near copies; what stays is mixed to the source weights, in training order and
as often as the mix repeats it; last, it is packed into sequences.

Null and empty texts count as empty: they score 0, are copies of each other, have size 0 in the mix and one piece when packed.
Of repeated rows one stays. Texts of any length are handled whole. Columns beside those of documents are handed on up to the
packing, but names that begin with ``_llm_`` are the stages' own. Empty documents give no rows. A copy is repeated as a document,
so its pieces come once for each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from parlance.llm.common import materialise, table
from parlance.session import ship_code

ship_code()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained network and sampled buckets cannot be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
