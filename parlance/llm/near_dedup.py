"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words; the weight is the term frequency times a damped inverse document
frequency between 1 and ``1 + SPREAD``, so that what a large group of copies shares still counts beside what sets its
members apart. Document frequencies come from all texts, in a hashed table of fixed size from which the expected share of
other shingles in a slot is taken off. Improved consistent weighted sampling draws ``SAMPLES`` shingles per text; texts
that agree in all samples of a band meet in a bucket. Two texts are linked when their weighted Jaccard similarity, computed
from whole texts, is ``SIMILARITY`` or more. Classes are the connected components of the links.

Texts that are equal but for case and white space are one node. Each node is first held against one leader, the member of
its buckets that meets the most nodes, which is the middle of a group of copies; pairs whose samples agree so seldom that a
similarity of 0.8 has odds below one in 10**5 are passed over. Then classes are joined. Where a bucket still holds several
classes, all its members of different classes are compared: in blocks of bounded size, by matrix products over the shingles
that occur more than once, and a block pair reports one link per pair of classes. No pair of a bucket is left untested.

Texts below five words are one shingle; null and empty texts have none and form one class. Repeated rows belong to one
class. An empty table gives no rows.
Texts of any length are read whole. Other columns are not read, whatever their names; ``without_near_copies`` hands them on,
but names that begin with ``_llm_`` are its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialise, text_chunks, whole_text

SHINGLE = 5
SIMILARITY = 0.8
SPREAD = 0.25
SAMPLES, ROWS_PER_BAND = 64, 4
SLOT_BITS, BLOCK_BITS = 20, 14
POOL_BITS = 12
BLOCK = 1024
BLOCK_NODES, BLOCK_CHARS, COLUMNS = 512, 1_500_000, 1024
ROWS_AT_ONCE, CHARS_AT_ONCE = 512, 1_000_000
AGREEING = 36
CACHED_WORDS = 150_000
CACHED_VECTORS = 8

HASH_BITS = 42

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def node_of(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def shingles(lines: Sequence[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and frequency of the distinct shingles of some texts' words, in order of text and hash."""
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lines)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    count = np.where(sizes == 0, 0, np.maximum(sizes - SHINGLE + 1, 1))
    owner = np.repeat(np.arange(len(lines)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (ends - sizes)[owner]
    value = np.zeros(len(first), np.uint64)
    padded = np.append(flat, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        value += padded[first + k] * _ODD[k]
    for text in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        # Short texts: only their own words, and how many they are.
        at, words = ends[text] - sizes[text], flat[ends[text] - sizes[text]:ends[text]]
        value[first == at] = (words * _ODD[:len(words)]).sum() + np.uint64(len(words))
    # One sort of text number and hash together.
    key = owner.astype(np.uint64) << np.uint64(HASH_BITS) | mixed(value) >> np.uint64(64 - HASH_BITS)
    key.sort()
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    times = np.diff(np.append(starts, len(key)))
    key = key[starts]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), mixed(key & np.uint64((1 << HASH_BITS) - 1)), times


def slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts per slot of shingles, counted over all rows; the table's size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(1 << SLOT_BITS, np.int64), WordHashes()
        for batch in batches:
            for _, texts in text_runs(batch):
                total += np.bincount(slot(shingles(list(map(words_of, texts)), hashes)[1]), minlength=len(total))
        blocks = total.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())],
                                         ["block", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in part["counts"])
        return pd.DataFrame([(part["block"].iloc[0], total.tobytes())], columns=["block", "counts"])

    kind = "block int, counts binary"
    rows = texts.select("text").mapInArrow(count, kind).groupBy("block").applyInPandas(add, kind).collect()
    table = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for row in rows:
        table[row["block"]] = np.frombuffer(row["counts"], "<i8")
    return table.reshape(-1)


def inverse_frequencies(table: np.ndarray, documents: int) -> np.ndarray:
    """Weight of a shingle by slot, between 1 and 1 + SPREAD."""
    others = (table.sum() - table) / (len(table) - 1)
    own = np.clip(table - others, 1, max(documents, 2))
    return (1 + SPREAD * (1 - np.log(own) / np.log(max(documents, 2)))).astype(np.float32)


def pools(seed: int = 5) -> tuple[np.ndarray, ...]:
    """Variates of the sampling: r and c follow Gamma(2, 1), beta is uniform. A shingle draws each from bits of its own.

    Returned as r, 1 / r, log c and beta.
    """
    rng = np.random.default_rng(seed)
    shape = (1 << POOL_BITS, SAMPLES)
    r, c = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c), rng.random(shape)))


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, pool: tuple) -> np.ndarray:
    """Samples of each text as 32-bit marks: (n, SAMPLES)."""
    r_pool, inverse_pool, c_pool, b_pool = pool
    least = np.full((n, SAMPLES), np.inf, np.float32)
    marks = np.zeros((n, SAMPLES), np.uint32)
    mask, log_weight = np.uint64((1 << POOL_BITS) - 1), np.log(weight).astype(np.float32)
    room = np.empty((4, BLOCK, SAMPLES), np.float32)
    for a in range(0, len(value), BLOCK):
        h, who = value[a:a + BLOCK], owner[a:a + BLOCK]
        t, r, beta, rank = room[:, :len(h)]
        at_r = (h & mask).astype(np.int64)
        np.take(inverse_pool, at_r, 0, t, "clip")
        np.take(r_pool, at_r, 0, r, "clip")
        np.take(c_pool, (h >> np.uint64(POOL_BITS) & mask).astype(np.int64), 0, rank, "clip")
        np.take(b_pool, (h >> np.uint64(2 * POOL_BITS) & mask).astype(np.int64), 0, beta, "clip")
        # t = floor(log w / r + beta); rank = log c - r (t - beta + 1)
        t *= log_weight[a:a + BLOCK, None]
        t += beta
        np.floor(t, t)
        beta -= t
        beta -= 1
        beta *= r
        rank += beta
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        low = np.minimum.reduceat(rank, starts, 0)
        texts = who[starts]
        better = low < least[texts]
        low[~better] = -np.inf
        at, sample = np.divmod(np.flatnonzero(rank == np.repeat(low, np.diff(np.append(starts, len(who))), 0)), SAMPLES)
        marks[who[at], sample] = mixed(h[at] + (t[at, sample].astype(np.int64).astype(np.uint64) << np.uint64(6)) * _ODD[0]).astype(np.uint32)
        least[texts] = np.where(better, low, least[texts])
    return marks


def bands(marks: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; different bands never share keys by design of the last step."""
    parts = marks.reshape(len(marks), -1, ROWS_PER_BAND).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS_PER_BAND):
        key = mixed(key * _ODD[1] + parts[:, :, k] + _ODD[2])
    return mixed(key + np.arange(parts.shape[1], dtype=np.uint64) * _ODD[3]).view(np.int64)


def text_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts and where they start, short enough to bound the memory of a worker."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        texts = batch.column("text").slice(at, ROWS_AT_ONCE).to_pylist()
        for a, b in text_chunks(texts, CHARS_AT_ONCE):
            yield at + a, texts[a:b]


def signed(texts: DataFrame, idf) -> DataFrame:
    """node, id, raw, bands and marks per row; rows without shingles have empty arrays."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pool, weights = WordHashes(), pools(), idf.value
        for batch in batches:
            for a, texts in text_runs(batch):
                b, lines = a + len(texts), list(map(words_of, texts))
                owner, value, times = shingles(lines, hashes)
                marks = signatures(owner, value, times * weights[slot(value)], b - a, pool)
                keys, filled = bands(marks), np.bincount(owner, minlength=b - a) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("raw").slice(a, b - a), pa.array(map(node_of, lines), pa.binary()),
                     pa.array([k if f else [] for k, f in zip(keys, filled)], pa.list_(pa.int64())),
                     pa.array([m if f else [] for m, f in zip(marks.view(np.int32), filled)], pa.list_(pa.int32()))],
                    ["doc_id", "raw", "node", "bands", "marks"])

    return texts.mapInArrow(sign, "doc_id long, raw long, node binary, bands array<long>, marks array<int>")


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, kept = WordHashes(), idf.value, OrderedDict()

        def vector(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in kept:
                _, value, times = shingles([words_of(text)], hashes)
                kept[node] = value, times * weights[slot(value)].astype(float)
                if len(kept) > CACHED_VECTORS:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            good = []
            for a, b, left, right in zip(*(batch.column(c) for c in ("a", "b", "a_text", "b_text"))):
                (x, p), (y, q) = vector(a.as_py(), left.as_py()), vector(b.as_py(), right.as_py())
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = np.minimum(p[i], q[j]).sum()
                good.append(bool(both >= similarity * (p.sum() + q.sum() - both) - 1e-9))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"))
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(check, "a binary, b binary")


def block_links(block: pd.DataFrame, weights: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of linked rows with different labels, one pair for each pair of labels; ``block`` has text, label, side.

    Rows of side 0 are compared with those of side 1, or with each other where there is one side. A shingle that occurs
    ``n`` times counts as ``n`` shingles, so that the shared weight is a product of 0/1 matrices.
    """
    owner, value, times = shingles(list(map(words_of, block["text"])), WordHashes())
    weight = weights[slot(value)].astype(float)
    total = np.bincount(owner, weight * times, len(block))
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner, weight = np.repeat(owner, times), np.repeat(weight, times)
    names, column, count = np.unique(mixed(np.repeat(value, times) + nth.astype(np.uint64) * _ODD[4]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column, weight = owner[shared], column[shared], weight[shared]
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    side = block["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    place = np.zeros(len(block), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    new = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
        a, b = np.searchsorted(new, (low, low + COLUMNS))
        rows, at, w = owner[a:b], new[a:b] - low, weight[a:b]
        x, y = (np.zeros((len(part), COLUMNS), np.float32) for part in (left, right))
        on_left, on_right = np.isin(rows, left), np.isin(rows, right)
        x[place[rows[on_left]], at[on_left]] = w[on_left]
        y[place[rows[on_right]], at[on_right]] = 1
        both += x @ y.T
    alike = both >= similarity * (total[left][:, None] + total[right][None, :] - both) * (1 - 1e-6) - 1e-9
    label = np.unique(block["label"].to_numpy(), return_inverse=True)[1]
    i, j = np.nonzero(alike & (label[left][:, None] != label[right][None, :]))
    i, j = left[i], right[j]
    key = np.minimum(label[i], label[j]) * len(block) + np.maximum(label[i], label[j])
    first = np.unique(key, return_index=True)[1]
    return list(zip(i[first].tolist(), j[first].tolist()))


def links_in_blocks(members: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (a, b) between rows of a bucket with different labels; ``members`` has band, node, label."""
    rows = members.join(texts, "node").withColumn("chars", F.length("text"))
    size = rows.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = (rows.drop("chars").join(size, "band").withColumn("own", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        if block["label"].nunique() < 2 or block["low"].iloc[0] != block["high"].iloc[0] and block["side"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []})
        node = block["node"]
        pairs = block_links(block, idf.value, similarity)
        return pd.DataFrame([sorted((node[i], node[j])) for i, j in pairs], columns=["a", "b"])

    return (dealt.select("band", "low", "high", "side", "node", "label", "text").groupBy("band", "low", "high")
            .applyInPandas(compare, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes with links: the smallest node they reach.

    Each round takes the smallest label among the neighbours and then the label of that label; it ends when none changes.
    """
    edges = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    while True:
        labels = materialise(labels, "labels")
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = materialise(step.join(jump, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label")), "labels")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose samples agree often enough to be worth a look."""
    marks = nodes.select("node", "marks")
    both = (pairs.join(marks.withColumnsRenamed({"node": "a", "marks": "x"}), "a")
            .join(marks.withColumnsRenamed({"node": "b", "marks": "y"}), "b"))
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.filter(equal >= AGREEING).select("a", "b")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """Per row: doc_id, hash of its raw text, node, label of its class, class_id, class_size."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("raw", F.xxhash64("text"))
    table = document_frequencies(texts)
    idf = spark.sparkContext.broadcast(inverse_frequencies(table, docs.count()))
    rows = materialise(signed(texts, idf), "signed")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"),
                                                 F.min(F.struct("doc_id", "raw")).alias("at"),
                                                 F.first("bands").alias("bands"), F.first("marks").alias("marks")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("band"))
    crowded = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = materialise(member.join(crowded, "band"), "buckets")
    meeting = member.select("node").distinct()
    # One row stands for a node; it is found again by its id and the hash of its text as it is.
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = nodes.join(meeting, "node", "left_semi").select("node", "at.*").select("node", ident.alias("_id"), "raw")
    near = texts.select(ident.alias("_id"), "raw", "text").join(wanted, ["_id", "raw"]).dropDuplicates(["_id", "raw"])
    near = materialise(near.select("node", "text"), "meeting-texts")
    # One leader per node: the member of its buckets that meets the most nodes.
    central = member.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = materialise(member.join(central, "node").withColumn("rank", F.struct("met", "node")), "ranked")
    leaders = ranked.groupBy("band").agg(F.max("rank").alias("leader"))
    best = ranked.select("band", "node").join(leaders, "band").groupBy("node").agg(F.max("leader").alias("leader"))
    pairs = best.filter(F.col("node") != F.col("leader.node")).select(
        F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
    links = materialise(verified(_agreeing(pairs, nodes), near, idf, similarity), "links")
    labels = components(links)
    placed = member.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    placed = materialise(placed, "placed")
    open_bands = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    rest = materialise(links_in_blocks(placed.join(open_bands, "band"), near, idf, similarity), "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    named = nodes.select("node", "least_id", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "named")
    size = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("rows").alias("class_size"))
    return rows.select("doc_id", "raw", "node").join(named.select("node", "label"), "node").join(size, "label").select(
        "doc_id", "raw", "node", "label", "class_id", "class_size")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id (the smallest id of its class), class_size, and whether the row's id is that one."""
    return _classes(docs, similarity).select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest id, with the columns of ``docs``."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stay = (_classes(docs, similarity).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .groupBy("label").agg(F.min(F.struct(ident.alias("_llm_id"), F.col("raw").alias("_llm_raw"))).alias("_at")).select("_at.*"))
    return (docs.withColumn("_llm_id", ident).withColumn("_llm_raw", F.xxhash64(whole_text()))
            .join(stay, ["_llm_id", "_llm_raw"], "left_semi").dropDuplicates(["_llm_id", "_llm_raw"])
            .select(*docs.columns))
