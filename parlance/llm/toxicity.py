"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (for words of the training sample) beside a vector made from its characters, so that
unseen forms of a known stem count too: the character layer reads every run of ``CHARS`` characters of the word, and gives
its outputs of the first run beside the largest of each output over all runs. A token of more than ``LONG`` characters, such as a text without white space, enters
as overlapping pieces, which hold every run whole. Characters behind Latin-1 are hashed into a table of their own. Two recurrent passes read a window of ``WINDOW`` words; attention pools their
states into one logit. A text is read in windows that overlap by half, to its end, and its score is that of its worst
window. What the first layer makes of a word does not depend on its neighbours and is computed once per distinct word.

Training sees at most ``PER_CLASS`` labelled texts of each class. Labels belong to texts, not windows: after two rounds
over windows drawn at random, each round trains on the worst window of toxic texts and the worst windows of the others.

Null and empty texts score 0. Without labels of both classes every score is 0. Repeated rows get equal scores; an empty
table gives no rows. Very long texts are read to their end, a run of windows at a time. Other columns of the documents are not
read for a score, whatever their names; ``without_toxic`` hands all of them on as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import held_out, labelled_sample, text_chunks, whole_text

WINDOW, STRIDE = 32, 16
WORDS, WORD_DIM = 4096, 12
CHARS, CHAR_DIM, CHAR_OUT = 8, 6, 16
LONG, PIECE, PIECE_STEP = 24, 16, 8
PLAIN_CODES, HASH_BITS = 256, 12
HIDDEN, ATTENTION = 8, 8
PER_CLASS = 1500
ROUNDS, STEPS, BATCH, RATE = 9, 24, 256, 0.01
THRESHOLD = 0.5
CACHED_WORDS = 100_000
ROWS_AT_ONCE = 256
WORDS_AT_ONCE = 10_000
WINDOWS_AT_ONCE = 1024
CLOSED = 30.0

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    shapes = {"word": (WORDS + 1, WORD_DIM), "char": (PLAIN_CODES, CHAR_DIM), "mix": (CHARS * CHAR_DIM, CHAR_OUT), "mix0": (CHAR_OUT,),
              "in": (WORD_DIM + 2 * CHAR_OUT, 6 * HIDDEN), "in0": (6 * HIDDEN,), "fwd": (HIDDEN, 3 * HIDDEN), "bwd": (HIDDEN, 3 * HIDDEN),
              "att": (2 * HIDDEN, ATTENTION), "att0": (ATTENTION,), "ask": (ATTENTION,), "out": (2 * HIDDEN,), "out0": (1,)}
    made = {}
    for name, shape in shapes.items():
        scale = 0.0 if name.endswith("0") else 0.3 if name in ("word", "char", "ask", "out") else 1 / np.sqrt(shape[0])
        made[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
    more = np.random.default_rng(seed + 1).standard_normal((1 << HASH_BITS, CHAR_DIM)) * 0.3
    made["char"] = np.concatenate([made["char"], more.astype(np.float32)])
    return made


def tokens(text: str) -> list[str]:
    """Lower-cased words; overlong ones as overlapping pieces, the last up to the end."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [part for w in words for part in
            ((w,) if len(w) <= LONG else (w[a:a + PIECE] for a in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)))]


def spell(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``CHARS`` characters of each word, 0 behind its end, and how many runs each word has."""
    text = "".join([w.ljust(CHARS, "\0") for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashed = PLAIN_CODES + (points * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS))
    codes = np.where(points < PLAIN_CODES, points, hashed)
    sizes = np.maximum(np.fromiter(map(len, words), np.int64, len(words)), CHARS)
    counts = sizes - CHARS + 1
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return codes[(np.repeat(np.cumsum(sizes) - sizes, counts) + nth)[:, None] + np.arange(CHARS)], counts


def first_layer(w: Weights, known: np.ndarray, codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Input of both passes for each word: (words, 6 * HIDDEN). Each word has ``counts`` rows of codes, else one."""
    flat = w["char"][codes].reshape(len(codes), -1)
    each = np.tanh(flat @ w["mix"] + w["mix0"])
    starts = np.arange(len(known)) if counts is None else np.cumsum(counts) - counts
    mixed = each if len(known) == len(codes) else np.maximum.reduceat(each, starts, 0)
    x = np.concatenate([w["word"][known], each[starts], mixed], 1)
    return x @ w["in"] + w["in0"], (flat, each, mixed, x)


def passes(inputs: np.ndarray, ids: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, time first; ``inputs`` has 3 * HIDDEN columns and a row per word."""
    steps, rows = ids.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    states, kept = np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        x, g = inputs[ids[t]], h @ u
        gates = sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        if keep:
            kept.append((h, z, r, n, g[:, 2 * HIDDEN:]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def back(kept: list, u: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs (time, rows, 3 * HIDDEN) and of ``u``."""
    d_u, d_h = np.zeros_like(u), np.zeros_like(d_states[0])
    d_in = np.empty((*d_states.shape[:2], 3 * HIDDEN), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        d = d_h + d_states[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * gn * r * (1 - r)
        d_in[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_g = np.concatenate([d_z, d_r, d_n * r], 1)
        d_u += h.T @ d_g
        d_h = d * z + d_g @ u.T
    return d_in, d_u


def halves(inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(inputs[:, :3 * HIDDEN]), np.ascontiguousarray(inputs[:, 3 * HIDDEN:])


def run_windows(w: Weights, inputs: np.ndarray | tuple, ids: np.ndarray, keep: bool = False, pad: int | None = None) -> tuple[np.ndarray, tuple]:
    """Logits of windows: ``ids`` (time, rows) point into ``inputs``, whose row ``pad``, else the last, is padding."""
    ahead, behind = inputs if isinstance(inputs, tuple) else halves(inputs)
    pad = len(ahead) - 1 if pad is None else pad
    fwd, fwd_kept = passes(ahead, ids, w["fwd"], keep)
    bwd, bwd_kept = passes(behind, ids[::-1], w["bwd"], keep)
    states = np.concatenate([fwd, bwd[::-1]], 2)
    seen = np.tanh(states @ w["att"] + w["att0"])
    asked = np.where(ids == pad, np.float32(-1e9), seen @ w["ask"])
    asked = np.exp(asked - asked.max(0))
    share = asked / asked.sum(0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    return pooled @ w["out"] + w["out0"], (fwd_kept, bwd_kept, states, seen, share, pooled)


def padded(inputs: np.ndarray) -> np.ndarray:
    """Inputs with a row that leaves the state as it is."""
    row = np.zeros((1, inputs.shape[1]), np.float32)
    row[0, :HIDDEN] = row[0, 3 * HIDDEN:4 * HIDDEN] = CLOSED
    return np.concatenate([inputs.astype(np.float32), row])


def gradients(w: Weights, known: np.ndarray, codes: np.ndarray, ids: np.ndarray, y: np.ndarray,
              counts: np.ndarray | None = None) -> tuple[Weights, float]:
    """Gradients of the mean logistic loss over windows; ``ids`` equal to len(known) are padding."""
    raw, (flat, each_run, mixed, x) = first_layer(w, known, codes, counts)
    logit, (fk, bk, states, seen, share, pooled) = run_windows(w, padded(raw), ids, True)
    p = sigmoid(logit)
    d_logit = ((p - y) / len(y)).astype(np.float32)
    g: Weights = {"out": pooled.T @ d_logit, "out0": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["out"]
    d_share = np.einsum("bh,tbh->tb", d_pooled, states)
    d_asked = share * (d_share - (share * d_share).sum(0))
    g["ask"] = np.einsum("tb,tba->a", d_asked, seen)
    d_seen = d_asked[:, :, None] * w["ask"] * (1 - seen * seen)
    g["att"], g["att0"] = np.einsum("tbh,tba->ha", states, d_seen), d_seen.sum((0, 1))
    d_states = share[:, :, None] * d_pooled + d_seen @ w["att"].T
    d_fwd, g["fwd"] = back(fk, w["fwd"], d_states[:, :, :HIDDEN])
    d_bwd, g["bwd"] = back(bk, w["bwd"], d_states[::-1, :, HIDDEN:])
    each = np.concatenate([d_fwd, d_bwd[::-1]], 2).reshape(-1, 6 * HIDDEN)
    flat_ids = ids.reshape(-1)
    order = np.argsort(flat_ids, kind="stable")
    d_raw = np.zeros((len(known) + 1, 6 * HIDDEN), np.float32)
    present, first = np.unique(flat_ids[order], return_index=True)
    d_raw[present] = np.add.reduceat(each[order], first, 0)
    d_raw = d_raw[:-1]
    g["in"], g["in0"] = x.T @ d_raw, d_raw.sum(0)
    d_x = d_raw @ w["in"].T
    g["word"] = np.zeros_like(w["word"])
    np.add.at(g["word"], known, d_x[:, :WORD_DIM])
    starts = np.arange(len(known)) if counts is None else np.cumsum(counts) - counts
    d_mixed = d_x[:, WORD_DIM + CHAR_OUT:]
    if len(known) != len(codes):
        word = np.repeat(np.arange(len(known)), counts)
        largest = each_run == mixed[word]
        d_mixed = largest * (d_mixed / np.add.reduceat(largest, starts, 0, dtype=np.float32))[word]
    d_mixed = d_mixed.copy()
    d_mixed[starts] += d_x[:, WORD_DIM:WORD_DIM + CHAR_OUT]
    d_mixed = d_mixed * (1 - each_run * each_run)
    g["mix"], g["mix0"] = flat.T @ d_mixed, d_mixed.sum(0)
    g["char"] = np.zeros_like(w["char"])
    np.add.at(g["char"], codes, (d_mixed @ w["mix"].T).reshape(len(codes), CHARS, CHAR_DIM))
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    return g, loss


def windows(sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of every window, time first, and the text of each window; texts lie one behind another."""
    ends = np.cumsum(sizes)
    count = np.where(sizes == 0, 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1))
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = ((ends - sizes)[owner] + nth * STRIDE).astype(np.int32)
    place = at[None, :] + np.arange(WINDOW, dtype=np.int32)[:, None]
    return np.where(place < ends[owner].astype(np.int32)[None, :], place, np.int32(pad)), owner


def numbered(examples: Iterable[tuple[str, int]]) -> tuple[list[str], np.ndarray, list[np.ndarray], list[int]]:
    """Distinct words by number, in how many texts each occurs, and each text's words as numbers, with the labels.

    Texts without words teach nothing. No text or word of a text is kept.
    """
    number: dict[str, int] = {}
    lines, labels, seen = [], [], Counter()
    for text, y in examples:
        line = np.fromiter((number.setdefault(word, len(number)) for word in tokens(text)), np.int32)
        if len(line):
            lines.append(line)
            labels.append(y)
            seen.update(np.unique(line).tolist())
    return list(number), np.array([seen[k] for k in range(len(number))], np.int64), lines, labels


def all_inputs(w: Weights, known: np.ndarray, codes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first layer of all words for both directions, with the padding row, made ``WORDS_AT_ONCE`` words at a time."""
    ahead, behind = (np.zeros((len(known) + 1, 3 * HIDDEN), np.float32) for _ in range(2))
    for a in range(0, len(known), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(known))
        rows = slice(starts[a], starts[b - 1] + counts[b - 1])
        made = first_layer(w, known[a:b], codes[rows], counts[a:b])[0]
        ahead[a:b], behind[a:b] = made[:, :3 * HIDDEN], made[:, 3 * HIDDEN:]
    ahead[-1, :HIDDEN] = behind[-1, :HIDDEN] = CLOSED
    return ahead, behind


def fit(examples: Iterable[tuple[str, int]], seed: int = 11, rounds: int = ROUNDS) -> tuple[Weights, dict[str, int]] | None:
    """Weights and the numbers of the known words; None without examples of both classes."""
    distinct, texts, lines, labels = numbered(examples)
    if len(set(labels)) < 2:
        return None
    common = sorted(range(len(distinct)), key=lambda k: (-texts[k], distinct[k]))[:WORDS]
    vocabulary = {distinct[k]: at for at, k in enumerate(common, 1)}
    known = np.zeros(len(distinct), np.int32)
    known[common] = np.arange(1, len(common) + 1)
    codes, counts = spell(distinct)
    starts, words = np.cumsum(counts) - counts, len(distinct)
    sizes = np.array(list(map(len, lines)))
    flat = np.concatenate([*lines, np.array([words], np.int32)])
    del distinct, lines
    place, owner = windows(sizes, len(flat) - 1)
    ids = flat[place]
    del place
    label = np.array(labels, np.float32)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    w, rng = initial(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for turn in range(rounds):
        score = rng.random(ids.shape[1])
        if turn >= 2:
            inputs = all_inputs(w, known, codes, counts, starts)
            score = np.concatenate([run_windows(w, inputs, ids[:, a:a + WINDOWS_AT_ONCE])[0] for a in range(0, ids.shape[1], WINDOWS_AT_ONCE)])
            del inputs
        best = np.lexsort((-score, owner))
        rank = np.arange(len(owner)) - np.repeat(cuts, np.diff(np.append(cuts, len(owner))))
        chosen = best[rank < np.where(label[owner] > 0, 1 if turn >= 2 else 3, 3)]
        chosen = np.union1d(chosen, rng.choice(np.flatnonzero(label[owner] == 0), min(len(chosen) // 4, int((label[owner] == 0).sum())), False))
        # Few examples are passed over several times, so that each round takes a fair number of steps.
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS // -(-len(chosen) // BATCH)))])
        for a in range(0, len(chosen), BATCH):
            part = ids[:, chosen[a:a + BATCH]]
            used, local = np.unique(part, return_inverse=True)
            local = local.reshape(part.shape)
            if used[-1] == words:
                used = used[:-1]
            n = counts[used]
            rows = np.arange(n.sum()) + np.repeat(starts[used] - np.cumsum(n) + n, n)
            g, _ = gradients(w, known[used], codes[rows], local, label[owner[chosen[a:a + BATCH]]], n)
            step += 1
            rate = RATE * (1 - turn / (rounds + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
    return w, vocabulary


class Reader:
    """Scores texts; keeps the first layer's result of the words it has met. Row 0 stands for padding."""

    def __init__(self, model: tuple[Weights, dict[str, int]]):
        self.weights, self.vocabulary = model
        self.rows: dict[str, int] = {}
        self.ahead, self.behind = halves(padded(np.zeros((0, 6 * HIDDEN), np.float32)))

    def _learn(self, lines: list[list[str]]) -> None:
        if len(self.rows) > CACHED_WORDS:
            self.rows = {}
        fresh = list({word for line in lines for word in line} - self.rows.keys())
        if not fresh:
            return
        start, end = len(self.rows) + 1, len(self.rows) + 1 + len(fresh)
        if end > len(self.ahead):
            room = np.zeros((end + end // 4 - start, 3 * HIDDEN), np.float32)
            self.ahead, self.behind = (np.concatenate([part[:start], room]) for part in (self.ahead, self.behind))
        for a in range(0, len(fresh), WORDS_AT_ONCE):
            part = fresh[a:a + WORDS_AT_ONCE]
            known = np.array([self.vocabulary.get(word, 0) for word in part])
            made = first_layer(self.weights, known, *spell(part))[0].astype(np.float32)
            self.ahead[start + a:start + a + len(part)], self.behind[start + a:start + a + len(part)] = halves(made)
        self.rows.update(zip(fresh, range(start, end)))

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        lines = [tokens(text) for text in texts]
        self._learn(lines)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(lines)), np.int32, int(sizes.sum()))
        flat = np.append(flat, np.int32(0))
        place, owner = windows(sizes, len(flat) - 1)
        worst = np.zeros(len(texts))
        for a in range(0, len(owner), 4096):
            logit, _ = run_windows(self.weights, (self.ahead, self.behind), flat[place[:, a:a + 4096]], pad=0)
            np.maximum.at(worst, owner[a:a + 4096], sigmoid(logit.astype(float)))
        return worst


def scores(batch: pa.RecordBatch, reader: Reader | None) -> np.ndarray:
    """Scores of a batch's texts, read a few rows at a time to bound the memory of a worker."""
    out = [np.zeros(0)]
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        texts = [text or "" for text in batch.column("text").slice(at, ROWS_AT_ONCE).to_pylist()]
        out += [reader(texts[a:b]) if reader else np.zeros(b - a) for a, b in text_chunks(texts, 1_000_000)]
    return np.concatenate(out)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The fitted model as a broadcast value."""
    model = fit(labelled_sample(docs, labels, "toxic", per_class, held_out(5, 0)))
    return docs.sparkSession.sparkContext.broadcast(model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    model = trained(docs, labels, per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value) if model.value else None
        for batch in batches:
            found = scores(batch, reader)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())],
                                             ["doc_id", "held_out", "score"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), whole_text().alias("text")]
    return (docs.select(*columns).mapInArrow(score, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with their own columns."""
    model = trained(docs, labels, per_class)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value) if model.value else None
        for batch in batches:
            yield batch.filter(pa.array(scores(batch, reader) < threshold))

    return docs.mapInArrow(keep, docs.schema)
