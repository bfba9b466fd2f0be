"""Exact top-k search by inner product, a branch-and-bound over dimension blocks in vertical layout.

Vectors and queries are dealt into blocks of bounded size; every pair of a query block and a vector block meets once, in
one task. Inside, a query adds up its product one block of dimensions at a time, the most telling dimensions first. What
the dimensions still to come can add is bounded by the masses (norms) left on both sides: vectors whose upper bound lies
below the k-th best lower bound go, and the columns of the others are compacted. The k best of each pair are merged.

Components are scaled by 256 and rounded down. Vectors that are null or hold null or non-finite components, and rows
without an id, take no part. Blocks with components beyond ``PLAIN`` are compared whole in Python's integers, and their
scores held within the range of a long. Only vectors of equal length are compared. Equal scores go by the smaller id. A
repeated id is one query, by its smallest vector, and as many candidates as it has rows, though none for itself. An empty
table, or one without partners, gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import materialise
from parlance.operators.ordered import first_per_group

K = 5
EVERY = 50
SCALE = 256
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 256
DIMENSIONS = 8
PLAIN = 1 << 24
LONG = (-(1 << 63), (1 << 63) - 1)


def best(columns: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best columns for one query, which is no candidate itself."""
    alive = np.flatnonzero(ids != query_id)
    order = np.argsort(-np.abs(query), kind="stable")
    blocks = [order[a:a + DIMENSIONS] for a in range(0, len(order), DIMENSIONS)]
    score = np.zeros(len(alive), np.int64)
    mass = np.einsum("dn,dn->n", columns, columns, dtype=float)[alive]
    rest = float(np.square(query, dtype=float).sum())
    for at, block in enumerate(blocks):
        part = columns[np.ix_(block, alive)]
        score = score + query[block] @ part
        if at + 1 < len(blocks) and len(alive) > k:
            mass = np.maximum(mass - np.einsum("dn,dn->n", part, part, dtype=float), 0)
            rest = max(rest - float(np.square(query[block], dtype=float).sum()), 0.0)
            more = np.sqrt(mass * rest) * (1 + 1e-9) + 1
            floor = np.partition(score - more, len(alive) - k)[len(alive) - k]
            keep = score + more >= floor
            alive, score, mass = alive[keep], score[keep], mass[keep]
    top = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[top]], score[top]


def whole(columns: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for components of any size."""
    alive = np.flatnonzero(ids != query_id)
    exact = query.astype(object) @ columns.astype(object)[:, alive] if len(query) else np.zeros(len(alive), object)
    score = np.array([min(max(int(x), LONG[0]), LONG[1]) for x in exact], np.int64)
    top = np.lexsort((ids[alive], [-int(x) for x in score]))[:k]
    return ids[alive[top]], score[top]


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per block: its ids, and its vectors dimension by dimension."""

    def lay(block: pd.DataFrame) -> pd.DataFrame:
        columns = np.ascontiguousarray(np.stack(block["vector"].to_numpy()).astype("<i8").T)
        return pd.DataFrame([(block["dims"].iloc[0], block[key].iloc[0], block["vec_id"].to_numpy("<i8").tobytes(), columns.tobytes())],
                            columns=["dims", key, "ids", "columns"])

    return rows.groupBy("dims", key).applyInPandas(lay, f"dims int, {key} int, ids binary, columns binary")


def _block(row, dims: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(getattr(row, f"{prefix}_ids"), "<i8")
    return ids, np.frombuffer(getattr(row, f"{prefix}_columns"), "<i8").reshape(dims, len(ids))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score for each row whose id is divisible by ``every``."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = materialise(
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), scaled.alias("vector")), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dims").agg(F.min("vector").alias("vector"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dims", "vector")).alias("_q")).select("vec_id", "_q.*")
    n_blocks = max(1, -(-rows.count() // VECTORS_PER_BLOCK))
    q_blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))

    def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
        return _packed(df.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), key)

    # Each side is repeated once per block of the other, and the pairs are spread over all tasks.
    v = dealt(rows, "v", n_blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = dealt(asked, "q", q_blocks).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    v = v.withColumnsRenamed({"ids": "v_ids", "columns": "v_columns"})
    q = q.withColumnsRenamed({"ids": "q_ids", "columns": "q_columns"})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, columns = _block(row, row.dims, "v")
                query_ids, queries = _block(row, row.dims, "q")
                plain = max(np.abs(columns).max(initial=0), np.abs(queries).max(initial=0)) < PLAIN and row.dims < PLAIN >> 12
                find = best if plain else whole
                each = [find(columns, ids, queries[:, at], one, k) for at, one in enumerate(query_ids.tolist())]
                yield pd.DataFrame({"query_id": np.repeat(query_ids, [len(found) for found, _ in each]),
                                    "vec_id": np.concatenate([found for found, _ in each]),
                                    "score": np.concatenate([score for _, score in each])})

    found = (v.join(q.hint("shuffle_hash"), ["dims", "v", "q"]).select("dims", "v_ids", "v_columns", "q_ids", "q_columns")
             .mapInPandas(search, "query_id long, vec_id long, score long"))
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    ranked = first_per_group(found, ["query_id"], order, k, "vec_id")
    return (ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .select("query_id", "rank", "vec_id", "score"))
