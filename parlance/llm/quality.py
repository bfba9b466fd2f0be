"""Quality of texts by logistic regression over hashed word n-grams.

Words and pairs of neighbouring words are hashed into ``2 ** BITS`` slots; a text is the sparse vector of its dampened
counts, of length one. The weights are fitted by follow-the-regularised-leader steps, one example at a time, on at most
``PER_CLASS`` labelled texts of each class. Scoring is a sparse dot product per text.

Null and empty texts have no n-grams and get the score of the bias alone. Without labels of both classes every score is
the share of label 1 seen, or one half. Repeated rows get equal scores; an empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import held_out, labelled_sample, text_chunks, whole_text

BITS = 20
PER_CLASS = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3
CACHED_WORDS = 500_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def features(texts: Sequence[str], hashes: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every feature of some texts."""
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    words = [text.split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for line in words for w in line), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    odd = np.uint64(0x9E3779B97F4A7C15)
    follows = np.flatnonzero(row[1:] == row[:-1])
    pair = (flat[follows] * odd) ^ (flat[follows + 1] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    # A word that follows itself, whichever it is, also counts as one common pair.
    again = follows[flat[follows] == flat[follows + 1]]
    slot = np.concatenate([flat * odd, pair * odd, np.full(len(again), odd)]) >> np.uint64(64 - bits)
    key = np.concatenate([row, row[follows], row[again]]).astype(np.int64) << bits | slot.astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row, slot, value = key >> bits, key & (1 << bits) - 1, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    return row, slot, value / norm[row]


def fit(examples: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by per-coordinate follow-the-regularised-leader steps."""
    labels = np.array([y for _, y in examples], float)
    bias = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else 0.0
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << bits, np.float32), float(bias)

    def leader(k: np.ndarray) -> np.ndarray:
        return -np.sign(z[k]) * np.maximum(np.abs(z[k]) - L1, 0) / ((BETA + np.sqrt(n[k])) / ALPHA + L2)

    hashes, rows = WordHashes(), []
    for start, end in text_chunks([t for t, _ in examples]):
        row, slot, value = features([t for t, _ in examples[start:end]], hashes, bits)
        cuts = np.searchsorted(row, np.arange(1, end - start))
        rows += list(zip(np.split(slot.astype(np.int32), cuts), np.split(value.astype(np.float32), cuts)))
    order = np.random.default_rng(seed)
    shift = 0.0
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            slot, value = rows[k]
            w = leader(slot)
            p = 1 / (1 + np.exp(-np.clip(bias + shift + w @ value, -30, 30)))
            g = (p - labels[k]) * value
            z[slot] += g - (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA * w
            n[slot] += g * g
            step = p - labels[k]
            zb += step - (np.sqrt(nb + step * step) - np.sqrt(nb)) / 0.1 * shift
            nb += step * step
            shift = -zb / ((BETA + np.sqrt(nb)) / 0.1)
    return leader(np.arange(1 << bits)).astype(np.float32), float(bias + shift)


def probabilities(texts: Sequence[str], weights: np.ndarray, bias: float, hashes: WordHashes) -> np.ndarray:
    row, slot, value = features(texts, hashes, int(len(weights)).bit_length() - 1)
    dot = np.bincount(row, weights[slot] * value, len(texts))
    return 1 / (1 + np.exp(-np.clip(bias + dot, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    away = held_out(5, 0)
    model = docs.sparkSession.sparkContext.broadcast(fit(list(labelled_sample(docs, labels, "quality", per_class, away))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), hashes = model.value, WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [probabilities(texts[a:b], weights, bias, hashes) for a, b in text_chunks(texts)]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values)],
                                             ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), away.alias("held_out"), whole_text().alias("text"))
    return (scored.mapInArrow(score, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
