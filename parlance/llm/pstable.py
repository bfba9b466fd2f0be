"""Near-duplicate vectors by p-stable hashing for Euclidean distance, with exact cosine checks.

Vectors are brought to length 1, where cosine and distance say the same. A hash is ``floor((a.v + b) / WIDTH)`` with normal
``a`` and uniform ``b``; two vectors at distance c share it with the odds ``agreement(c)``. ``key_size`` hashes make the key
of a table, and vectors of equal label and length that share a key in any table are compared by their cosine in double
precision. The size of a key grows with the logarithm of the rows, so that a vector meets about ``STRANGERS`` unrelated ones
a table, and the number of tables grows so that a pair at the threshold itself is missed with odds of ``MISSED`` at most.
Pairs above it are missed more seldom. No pair that shares a key goes untested.

Equal vectors of a label are one node, with as many rows. A pair that meets in several tables is counted in the first of
them only, as the keys of both sides are at hand. Buckets that lie whole within a bucket of one of the first ``EARLY`` tables
are left out, since all their pairs were counted there. Larger buckets are cut into blocks, and each pair of blocks meets in
one task, which adds up how many links each node has and reports a spanning forest of them, never all pairs.

Vectors that are null, zero or hold null or non-finite components link with nothing, and so do those without a label: they
have no links and are components of their own. Rows with the same vec_id are vectors of their own. A null id never names
a component unless all ids of it are null. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialise
from parlance.llm.near_dedup import components

COSINE = 0.93
WIDTH = 3.0
MISSED = 0.002
STRANGERS = 1 / 16
FAR = math.sqrt(2.0)
EARLY = 4
BLOCK_NODES = 2048
STRIP = 512
ROWS_AT_ONCE = 1024
SMALL = 48
SEED = 29


def agreement(distance: float, width: float = WIDTH) -> float:
    """Odds that two vectors at a distance share a hash."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def sizes(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """Hashes of a key, and tables, for labels of up to ``rows`` vectors."""
    close, far = agreement(math.sqrt(max(2 - 2 * cosine, 1e-12))), agreement(FAR)
    key = max(1, math.ceil((math.log(max(rows, 1)) - math.log(STRANGERS)) / -math.log(far)))
    return key, max(1, math.ceil(math.log(MISSED) / math.log1p(-close ** key)))


def projections(dims: int, key: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dims)
    return (rng.standard_normal((dims, key * tables)).astype(np.float32), rng.uniform(0, WIDTH, key * tables).astype(np.float32),
            rng.integers(1, 1 << 62, key, np.int64) * 2 + 1)


def keys_of(unit: np.ndarray, drawn: tuple, tables: int) -> np.ndarray:
    """The key of each vector in each table: (n, tables), 32 bits each."""
    a, b, odd = drawn
    cells = np.floor((unit.astype(np.float32) @ a + b) / np.float32(WIDTH)).astype(np.int64).reshape(len(unit), tables, -1)
    mixed = (cells * odd).sum(2).view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_vectors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 in double precision, and which of them have a direction."""
    x = raw.astype(np.float64)
    good = np.isfinite(x).all(1)
    x = np.where(good[:, None], x, 0)
    top = np.abs(x).max(1, initial=0)
    x = x / np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], good & (norm > 0)


def signed(vectors: DataFrame, key: int, tables: int) -> DataFrame:
    """vec_id, label, node, dims, unit vector and keys per row; rows that link with nothing have no node."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                label, lists = batch.column("label"), batch.column("embedding")
                n = batch.num_rows
                node, unit, keys = [None] * n, [None] * n, [None] * n
                size = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                labelled = np.array([x is not None for x in label.to_pylist()])
                for dims in np.unique(size[(size > 0) & labelled]).tolist():
                    mine = np.flatnonzero((size == dims) & labelled)
                    # A null component reads as NaN here, so its vector has no direction.
                    raw = np.array(lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
                    x, good = unit_vectors(raw)
                    if dims not in drawn:
                        drawn[dims] = projections(dims, key, tables)
                    found = keys_of(x, drawn[dims], tables)
                    for row, v, k, ok, line in zip(mine.tolist(), x, found, good, raw):
                        if ok:
                            head = f"{label[row].as_py()},{dims},".encode()
                            node[row], unit[row], keys[row] = hashlib.md5(head + line.tobytes()).digest(), v.tobytes(), k
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), label, pa.array(node, pa.binary()), pa.array(np.maximum(size, 0), pa.int32()),
                     pa.array(unit, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["vec_id", "label", "node", "dims", "unit", "keys"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        sign, f"vec_id long, label {kind}, node binary, dims int, unit binary, keys array<int>")


def crowded(nodes: DataFrame) -> DataFrame:
    """Members (table, key, label, dims, node) of the buckets whose pairs must be looked at, with the buckets' size n."""
    each = nodes.select("label", "dims", "node", F.slice("keys", 1, EARLY).alias("early"), F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dims", "table", "key"]
    spans = [f(F.col("early")[k]).alias(f"{name}{k}") for k in range(EARLY) for name, f in (("low", F.min), ("high", F.max))]
    # Outside the table itself: all members in one bucket of an early table.
    inside = F.lit(False)
    for k in range(EARLY):
        inside = inside | F.coalesce((F.col("table") > k) & (F.col(f"low{k}") == F.col(f"high{k}")), F.lit(False))
    busy = each.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), *spans).filter((F.col("n") > 1) & ~inside).select(*bucket, "n")
    return each.drop("early").join(busy, bucket)


def in_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pair of blocks of a bucket as rows: bucket columns, low, high, side, node, times, unit, keys."""
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}))
    return (dealt.select("label", "dims", "table", "key", "low", "high", "side", "node")
            .join(nodes.select("node", "times", "unit", "keys"), "node"))


class Block:
    """The rows of one pair of blocks."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.node = rows.column("node").to_pylist()
        self.times = rows.column("times").to_numpy()
        self.side = rows.column("side").to_numpy()
        self.keys = np.stack(rows.column("keys").to_numpy(zero_copy_only=False))
        self.unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(self.node), -1)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what the links i, j hold together: one fewer than its nodes, for each component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return [(int(label[k]), int(k)) for k in np.flatnonzero(label != np.arange(n))]
        label = new


def first_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the pairs i, j share no key in a table before their own."""
    left = np.arange(len(i))
    over = np.zeros(len(i), bool)
    for k in range(int(table.max(initial=0)) + 1):
        done = table[left] <= k
        over[left[done]] = True
        left = left[~done]
        left = left[keys[i[left], k] != keys[j[left], k]]
        if not len(left):
            break
    return over


def tally(block: Block, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Links of each row from the linked pairs i, j that were not counted in an earlier table; repeated rows count each."""
    fresh = first_shared(block.keys, i, j, table)
    i, j, n = i[fresh], j[fresh], len(block.node)
    return (np.bincount(i, block.times[j], n) + np.bincount(j, block.times[i], n)).astype(np.int64)


def large(block: Block, table: int, within: bool, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row, and a forest of them, for one pair of blocks."""
    left = np.flatnonzero(block.side == 0)
    right = left if within else np.flatnonzero(block.side == 1)
    counts, tree = np.zeros(len(block.node), np.int64), []
    for a in range(0, len(left), STRIP):
        rows = left[a:a + STRIP]
        i, j = np.nonzero(block.unit[rows] @ block.unit[right].T >= cosine)
        i, j = rows[i], right[j]
        if within:
            i, j = i[i < j], j[i < j]
        tree = forest(len(counts), *(np.concatenate((x, np.array([t[s] for t in tree], np.int64))) for s, x in enumerate((i, j))))
        counts += tally(block, i, j, np.full(len(i), table))
    return counts, tree


def small(block: Block, bucket: np.ndarray, table: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The same for many small buckets that stand one behind another."""
    apart = [np.flatnonzero(bucket[d:] == bucket[:-d]) for d in range(1, min(SMALL, len(bucket)))]
    i = np.concatenate([np.zeros(0, np.int64), *apart])
    j = np.concatenate([np.zeros(0, np.int64), *(at + d for d, at in enumerate(apart, 1))])
    near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", block.unit[i[a:a + 8192]], block.unit[j[a:a + 8192]]) >= cosine
                                                for a in range(0, len(i), 8192))])
    i, j = i[near], j[near]
    return tally(block, i, j, table[i]), list(zip(i.tolist(), j.tolist()))


def linked(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, links, other): links counted for a node, or a link of the forest where ``other`` is given."""
    place = ["label", "dims", "table", "key", "low", "high"]

    def told(block: Block, found: tuple[np.ndarray, list[tuple[int, int]]]) -> pa.RecordBatch:
        counts, tree = found
        has = np.flatnonzero(counts).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([block.node[k] for k in has] + [block.node[a] for a, _ in tree], pa.binary()), pa.array(counts[has].tolist() + [0] * len(tree), pa.int64()),
             pa.array([None] * len(has) + [block.node[b] for _, b in tree], pa.binary())], ["node", "links", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        now = None

        def one(parts: list[pa.RecordBatch], spot: tuple) -> Iterator[pa.RecordBatch]:
            if sum(p.num_rows for p in parts) > 1:
                block = Block(parts)
                yield told(block, large(block, spot[2], spot[4] == spot[5], cosine))

        for batch in batches:
            # Rows of a place stand together; the last place of a batch may go on in the next.
            spots = list(zip(*(batch.column(c).to_pylist() for c in place)))
            starts = [k for k in range(len(spots)) if k == 0 or spots[k] != spots[k - 1]] + [len(spots)]
            bucket = np.full(len(spots), -1)
            for a, b in zip(starts, starts[1:]):
                if spots[a] == now:
                    waiting.append(batch.slice(a, b - a))
                    continue
                yield from one(waiting, now)
                waiting, now = [], None
                if b == len(spots):
                    waiting, now = [batch.slice(a, b - a)], spots[a]
                elif b - a > SMALL or spots[a][4] != spots[a][5]:
                    yield from one([batch.slice(a, b - a)], spots[a])
                else:
                    bucket[a:b] = a
            few = np.flatnonzero(bucket >= 0)
            if len(few):
                block = Block([batch.take(pa.array(few))])
                yield told(block, small(block, bucket[few], np.array([spots[k][2] for k in few.tolist()]), cosine))
        yield from one(waiting, now)

    sorted_rows = rows.repartition(*place).sortWithinPartitions(*place, "side", "node")
    return sorted_rows.mapInArrow(compare, "node binary, links long, other binary")


def similar_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    largest = given.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rows = materialise(signed(given, *sizes(largest, cosine)), "signed-vectors")
    nodes = materialise(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"),
        *(F.first(c).alias(c) for c in ("label", "dims", "unit", "keys"))), "vector-nodes")
    found = materialise(linked(in_blocks(crowded(nodes), nodes), cosine), "vector-links")
    degree = found.filter(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = (nodes.select("node", "least", "times").join(degree, "node", "left").join(labels.withColumnRenamed("label", "top"), "node", "left")
             .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("top", "node").alias("top")))
    named = materialise(named, "vector-names")
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    placed = named.join(least, "top").select("node", "n_links", "component_id")
    # Rows without a node would all meet in one task of the join.
    bare = rows.filter(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked_rows = rows.filter(F.col("node").isNotNull()).select("vec_id", "node").join(placed, "node").select("vec_id", "n_links", "component_id")
    return linked_rows.unionByName(bare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
