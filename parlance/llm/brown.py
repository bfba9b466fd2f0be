"""Language-model scoring with class-based bigrams, the classes found by exchange clustering.

All training tokens are counted in Spark. The ``CLUSTERED`` commonest words are moved between ``CLASSES`` classes, one word
at a time, as long as the likelihood of the class bigrams grows; this needs only a table of bounded size, whose counts come
from all training texts. All other words start in a class per rank band of the head, or in the class of the tail. Each of
them, down to words that occur once, is then moved by the same exact gain, among all classes in use: the classes before
and after each of its occurrences are added up in its hash bucket, and the words of a bucket choose at once. The class
bigrams are counted anew from all training texts with the classes so found.

A token's probability is that of its class after the class before it, smoothed towards the class's own share, times that of
the word within the class, where a word weighs its count plus one. Unseen words count as one more of the tail's class; the
end of a text is a class of its own.

The head has a fixed size and is broadcast. Tail words stay distributed: texts send their tail words, packed by hash
bucket, to the counts and classes of that bucket, and get back both. What a text keeps is the path of its classes.

Null texts count as empty and consist of the end alone. Without training texts all counts are 0. Repeated rows are scored
apart; an empty table gives no rows.
Texts of any length are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import held_out, materialise, text_chunks, whole_text

HEAD = 1 << 16
CLUSTERED = 1 << 10
CLASSES = 48
PASSES = 6
SMOOTHING = 50.0
WORDS_PER_BUCKET = 20_000
TOKENS_PER_BUCKET = 5_000_000
FLUSH = 300_000
CELLS = 500_000
CHARS = 1_000_000
BLOCK = 256
BANDS = (HEAD // CLUSTERED).bit_length() - 1
TAIL, END = CLUSTERED + BANDS, CLUSTERED + BANDS + 1
SYMBOLS = END + 1


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8; only A-Z are lower-cased and only ASCII white space parts words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbols(ids: np.ndarray) -> np.ndarray:
    """Clustered words stand for themselves, other head words for their band; ids are ranks, -1 outside the head."""
    band = CLUSTERED + np.log2(np.maximum(ids, CLUSTERED) / CLUSTERED).astype(np.int64)
    return np.where(ids < 0, TAIL, np.where(ids < CLUSTERED, ids, band))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The commonest words, at most ``limit``, in order of falling counts and then by word.

    The least count that belongs is found on tables of fixed size: words by power of two, then by 1024 steps of the power
    in which the limit falls.
    """
    power = F.length(F.bin("n")) - 1
    left, least = limit, None
    for row in sorted(counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("w")).collect(), key=lambda r: -r["p"]):
        if row["w"] <= left:
            left, least = left - row["w"], 1 << row["p"]
            continue
        low, step = 1 << row["p"], max(1, (1 << row["p"]) >> 10)
        inner = counts.filter(power == row["p"]).groupBy(F.floor((F.col("n") - low) / step).alias("k")).agg(F.count(F.lit(1)).alias("w"))
        for part in sorted(inner.collect(), key=lambda r: -r["k"]):
            if part["w"] > left:
                break
            left, least = left - part["w"], low + part["k"] * step
        break
    if least is None:
        return []
    rows = counts.filter(F.col("n") >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def numbered(texts: list[str], head: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Head numbers of all tokens with an end (-2) after each text, where each text starts, and the places and words of the
    tokens outside the head (-1)."""
    lines = [words_of(text) for text in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    words = list(chain.from_iterable(lines))
    found = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
    at = np.arange(len(words)) + np.repeat(np.arange(len(lines)), sizes - 1)
    ids = np.full(len(words) + len(lines), -2)
    ids[at] = found
    tail = np.flatnonzero(found == -1)
    return ids, np.cumsum(sizes) - sizes, at[tail], [words[x] for x in tail.tolist()]


def to_symbols(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each token and of the token before it; texts begin after an end."""
    now = np.where(ids == -2, END, symbols(ids))
    before = np.concatenate(([END], now[:-1]))
    before[starts] = END
    return before, now


def symbol_pairs(docs: DataFrame, head) -> np.ndarray:
    """Counts of symbol pairs over all texts: SYMBOLS x SYMBOLS, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = head.value, np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_chunks(texts):
                ids, starts, *_ = numbered(texts[a:b], known)
                before, now = to_symbols(ids, starts)
                total += np.bincount(before * SYMBOLS + now, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SYMBOLS * SYMBOLS)
    table[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(float)
    return table.reshape(SYMBOLS, SYMBOLS)


def exchange(pairs: np.ndarray, n_words: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of every symbol. The first ``n_words`` symbols move, all others keep a class of their own."""
    total = len(pairs)
    groups = min(classes, max(n_words, 1))
    owner = np.concatenate([np.arange(n_words) % groups, groups + np.arange(total - n_words)])
    size = groups + total - n_words
    table = np.zeros((size, size))
    np.add.at(table, (owner[:, None], owner[None, :]), pairs)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(passes):
        moved = 0
        for word in range(n_words):
            itself = pairs[word, word]
            right, left = pairs[word].copy(), pairs[:, word].copy()
            right[word] = left[word] = 0
            r, c = np.bincount(owner, right, size), np.bincount(owner, left, size)
            home = owner[word]
            table[home] -= r
            table[:, home] -= c
            table[home, home] -= itself
            rows, columns = table[:groups], table[:, :groups].T
            k = np.arange(groups)
            grown = f(rows + r) - f(rows)
            grown_down = f(columns + c) - f(columns)
            gain = grown.sum(1) + grown_down.sum(1) - grown[k, k] - grown_down[k, k]
            own = table[k, k]
            gain += f(own + r[:groups] + c[:groups] + itself) - f(own)
            for marginal, part in ((rows.sum(1) + c[:groups], r.sum() + itself), (columns.sum(1) + r[:groups], c.sum() + itself)):
                gain -= f(marginal + part) - f(marginal)
            best = int(gain.argmax())
            if gain[best] <= gain[home] + 1e-9:
                best = home
            moved += best != home
            owner[word] = best
            table[best] += r
            table[:, best] += c
            table[best, best] += itself
        if not moved:
            break
    return owner


def tidy(owner: np.ndarray, n_words: int) -> np.ndarray:
    """Classes numbered without gaps; symbols that stand for no word share the tail's."""
    used = owner.copy()
    used[n_words:CLUSTERED] = owner[TAIL]
    return np.unique(used, return_inverse=True)[1].reshape(-1)


def class_table(pairs: np.ndarray, owner: np.ndarray) -> np.ndarray:
    size = int(owner.max()) + 1
    table = np.zeros((size, size))
    np.add.at(table, (owner[:, None], owner[None, :]), pairs)
    return table


def best_classes(table: np.ndarray, home: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The class in which each word adds most to the likelihood, all others staying; its own where no other is better.

    ``right`` and ``left`` count the classes after and before each word, ``itself`` how often it follows itself.
    """
    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    best, k = home.copy(), np.arange(len(allowed))
    sides = table[allowed].T, table[:, allowed]
    marginals, diagonal = (table.sum(1)[allowed], table.sum(0)[allowed]), table.diagonal()[allowed]
    for a in range(0, len(home), BLOCK):
        h, r, c, s = home[a:a + BLOCK], right[a:a + BLOCK].astype(float), left[a:a + BLOCK].astype(float), itself[a:a + BLOCK, None].astype(float)
        at_home = np.searchsorted(allowed, h)[:, None] == k
        gain = np.zeros(at_home.shape)
        # Only what a word stands beside changes; its own occurrences are first taken out of its home.
        for counts, others, side in ((r, c[:, allowed], sides[0]), (c, r[:, allowed], sides[1])):
            w, beside = np.nonzero(counts)
            if not len(w):
                continue
            n = counts[w, beside][:, None]
            before = side[beside] - at_home[w] * n - (beside == h[w])[:, None] * (others[w] + at_home[w] * s[w])
            grown = np.where(allowed == beside[:, None], 0, f(before + n) - f(before))
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(grown, first, axis=0)
        both = r[:, allowed] + c[:, allowed] + s
        own = diagonal - at_home * both
        gain += f(own + both) - f(own)
        for marginal, counts in zip(marginals, (r, c)):
            part = counts.sum(1, keepdims=True) + s
            rest = marginal - at_home * part
            gain -= f(rest + part) - f(rest)
        top = gain.argmax(1)
        i = np.arange(len(h))
        best[a:a + BLOCK] = np.where(gain[i, top] > gain[at_home] + 1e-9, allowed[top], h)
    return best


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def neighbours(docs: DataFrame, head, owner: np.ndarray, clustered: int, buckets: int) -> DataFrame:
    """(bucket, words, places, codes, ns): how often each word that is not clustered stands after and before each class.

    Codes are classes, those behind a word by ``size`` + 1 more; ``size`` itself is the word's own neighbourhood.
    """
    size = int(owner.max()) + 1
    width = size + 1
    code = code_type(size)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], names: list[bytes], fresh: dict[bytes, int]) -> pa.RecordBatch:
        cells, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells, first = np.unique(cells[order], return_index=True)
        n = np.add.reduceat(n[order], first) if len(first) else n
        key, codes = np.divmod(cells, 2 * width)
        present, which = np.unique(key, return_inverse=True)
        tail = list(fresh)
        words = [names[x] if x < len(names) else tail[x - len(names)] for x in present.tolist()]
        bucket = bucket_of(words, buckets)[which]
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        blobs, places = [], []
        for part in np.split(order, first[1:]) if len(order) else []:
            of, at = np.unique(which[part], return_inverse=True)
            blobs.append(b"\n".join([words[x] for x in of.tolist()]))
            places.append((at.astype("<i4").tobytes(), codes[part].astype(code).tobytes(), n[part].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary()), *(pa.array([p[x] for p in places], pa.binary()) for x in range(3))],
            ["bucket", "words", "places", "codes", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        names, fresh, held = list(known), {}, []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_chunks(texts, CHARS):
                ids, starts, places, words = numbered(texts[a:b], known)
                before, now = to_symbols(ids, starts)
                left, right = owner[before], np.append(owner[now][1:], owner[END])
                ids[places] = [len(names) + fresh.setdefault(w, len(fresh)) for w in words]
                same = ids[1:] == ids[:-1]
                left[1:][same] = size
                right[:-1][same] = size
                at = np.flatnonzero(ids >= clustered)
                held.append(np.unique(np.concatenate((ids[at] * 2 * width + left[at], ids[at] * 2 * width + width + right[at])), return_counts=True))
                if sum(len(x) for x, _ in held) > CELLS or len(fresh) > FLUSH // 2:
                    yield packed(held, names, fresh)
                    fresh, held = {}, []
        if held:
            yield packed(held, names, fresh)

    return docs.select("text").mapInArrow(count, "bucket int, words binary, places binary, codes binary, ns binary")


def code_type(size: int) -> np.dtype:
    return np.dtype("<u1" if 2 * (size + 1) <= 256 else "<u2")


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, and which of them each row is; found by a hash and compared."""
    key = rows @ np.random.default_rng(0).integers(-1 << 62, 1 << 62, rows.shape[1])
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    kinds = rows[first]
    if (kinds[kind] != rows).any():
        kinds, kind = np.unique(rows, axis=0, return_inverse=True)
    return kinds, kind.reshape(-1)


def once_classes(table: np.ndarray, tail: int, allowed: np.ndarray) -> np.ndarray:
    """Best class of a tail word that occurs once, by the classes before and after it."""
    size = len(table)
    left, right = (x.ravel() for x in np.indices((size, size)))
    one = np.eye(size)
    best = best_classes(table, np.full(size * size, tail), one[right], one[left], np.zeros(size * size), allowed)
    return best.reshape(size, size)


def word_classes(asked: DataFrame, counts: DataFrame, head, table: np.ndarray, owner: np.ndarray, clustered: int) -> DataFrame:
    """(bucket, word, n, class) of all words that are not clustered, each moved to the class that suits it best."""
    size = len(table)
    width, code = size + 1, code_type(size)
    taken = table.sum(0) + table.sum(1) > 0
    taken[owner[END]] = False
    allowed = np.flatnonzero(taken)
    once = once_classes(table, int(owner[TAIL]), allowed) if taken[owner[TAIL]] else None

    def choose(key, asked: pa.Table, counts: pa.Table) -> pa.Table:
        known, words = head.value, counts["word"].to_pylist()
        rank = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        free = (rank < 0) | (rank >= clustered)
        counts, rank = counts.filter(pa.array(free)), rank[free]
        home = owner[symbols(rank)]
        number = {w: k for k, w in enumerate(counts["word"].to_pylist())}
        single = (rank < 0) & (counts["n"].to_numpy() == 1)
        many = np.flatnonzero(~single)
        place = np.cumsum(~single) - 1
        sides = np.zeros((2, len(number)), np.int64)
        seen = np.zeros((len(many), 1 + 2 * width), np.int64)
        seen[:, 0] = home[many]
        for blob, places, codes, ns in zip(*(asked[c].to_pylist() for c in ("words", "places", "codes", "ns"))):
            at = np.array([number[w] for w in blob.split(b"\n")])[np.frombuffer(places, "<i4")]
            codes, alone = np.frombuffer(codes, code).astype(np.int64), single[at]
            sides[codes[alone] // width, at[alone]] = codes[alone] % width
            seen[place[at[~alone]], 1 + codes[~alone]] += np.frombuffer(ns, "<i8")[~alone]
        if single.any():
            home[single] = once[sides[0, single], sides[1, single]]
        if len(many):
            # Words seen alike choose alike.
            kinds, kind = distinct(seen)
            left, right = kinds[:, 1:1 + size], kinds[:, 1 + width:1 + width + size]
            home[many] = best_classes(table, kinds[:, 0], right, left, kinds[:, 1 + size], allowed)[kind]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(home), pa.int32()), "word": counts["word"].cast(pa.binary()), "n": counts["n"],
                         "class": pa.array(home.astype(np.int32))})

    return asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(choose, "bucket int, word binary, n long, class int")


def _answers(code: np.dtype, unseen: int):
    """Class and count of each tail token that a run of texts asks for."""
    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        number = {w: k for k, w in enumerate(counts["word"].to_pylist())}
        ns, classes = np.append(counts["n"].to_numpy(), 0).astype("<i8"), np.append(counts["class"].to_numpy(), unseen).astype(code)
        out = []
        for blob in asked["words"].to_pylist():
            words = blob.split(b"\n")
            at = np.fromiter(map(number.get, words, repeat(len(number))), np.int64, len(words))
            out.append((ns[at].tobytes(), classes[at].tobytes()))
        return pa.table({"chunk": asked["chunk"], "places": asked["places"], "ns": pa.array([n for n, _ in out], pa.binary()),
                         "classes": pa.array([c for _, c in out], pa.binary())})
    return answer


def _filled(code: np.dtype):
    """Texts of a run with the tail tokens' classes in their paths, and what their counts add."""
    def fill(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("nth")
        path = np.frombuffer(b"".join(docs["path"].to_pylist()), code).copy()
        ends = np.cumsum(docs["n_tokens"].to_numpy())
        logs, known = docs["logs"].to_numpy().copy(), docs["known"].to_numpy().copy()
        for places, ns, classes in zip(*(answers[c].to_pylist() for c in ("places", "ns", "classes"))):
            at, n = np.frombuffer(places, "<i4"), np.frombuffer(ns, "<i8")
            path[at] = np.frombuffer(classes, code)
            of = np.searchsorted(ends, at, "right")
            logs += np.bincount(of, np.log10(n + 1.0), len(ends))
            known += np.bincount(of, n > 0, len(ends)).astype(np.int64)
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "known": pa.array(known),
                         "logs": pa.array(logs), "path": _cut(path, ends)})
    return fill


def _cut(path: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The paths of a run's texts, one binary each."""
    offsets = np.concatenate(([0], ends)) * path.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(path.tobytes())])


def path_steps(paths: list[bytes], code: np.dtype, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, of the token before it, and where each text starts."""
    now = np.frombuffer(b"".join(paths), code).astype(np.int64)
    sizes = np.array([len(p) for p in paths]) // code.itemsize
    starts = np.cumsum(sizes) - sizes
    before = np.append(end, now[:-1])
    before[starts] = end
    return before, now, starts


def class_pairs(paths: DataFrame, size: int, end: int) -> np.ndarray:
    """Counts of class pairs over paths: size x size."""
    code = code_type(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            all_ = batch.column("path").to_pylist()
            for a, b in text_chunks(all_):
                before, now, _ = path_steps(all_[a:b], code, end)
                total += np.bincount(before * size + now, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    rows = paths.select("path").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(size * size)
    for r in rows:
        table[r["cell"]] = r["n"]
    return table.reshape(size, size)


def log_steps(table: np.ndarray) -> np.ndarray:
    """log10 of class given class before."""
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + SMOOTHING * share) / (table.sum(1, keepdims=True) + SMOOTHING))


NAMES = ["chunk", "nth", "doc_id", "held_out", "n_tokens", "known", "logs", "path", "bucket", "places", "words"]
_DOC = "doc_id long, held_out boolean, n_tokens long, known long, logs double, path binary"


def bucket_column(buckets: int):
    return (F.crc32("word") % buckets).cast("int")


def class_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, classes: int = CLASSES, passes: int = PASSES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), whole_text().alias("text"))
    training = texts.filter(~F.col("held_out"))
    counts = materialise(word_counts(training), "word-counts")
    row = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_docs = training.select("doc_id").count()
    n_train, v = row["n"] + train_docs, row["v"] + (train_docs > 0)
    top = head_words(counts, HEAD)
    head = spark.sparkContext.broadcast({word: k for k, (word, _) in enumerate(top)})
    head_counts = np.array([n for _, n in top], float)
    clustered = min(CLUSTERED, len(top))
    pairs = symbol_pairs(training, head)
    owner = tidy(exchange(pairs, clustered, classes, passes), clustered)
    table = class_table(pairs, owner)
    size, end, unseen = len(table), int(owner[END]), int(owner[TAIL])
    code = code_type(size)

    buckets = max(1, -(-row["v"] // WORDS_PER_BUCKET), -(-n_train // TOKENS_PER_BUCKET))
    asked = neighbours(training, head, owner, clustered, buckets)
    found = materialise(word_classes(asked, counts.withColumn("bucket", bucket_column(buckets)), head, table, owner, clustered), "word-classes")
    least = top[-1][1] if top else None
    in_tail = F.lit(True) if least is None else F.col("n") < least
    class_of = owner[symbols(np.arange(len(top)))]
    for r in found.filter(~in_tail).select("word", "class").collect():
        class_of[head.value[bytes(r["word"])]] = r["class"]
    mass = np.zeros(size)
    np.add.at(mass, class_of[:clustered], head_counts[:clustered] + 1)
    for r in found.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        mass[r["class"]] += r["n"]
    mass[unseen] += 1
    tables = spark.sparkContext.broadcast((class_of, np.log10(head_counts + 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        own, logs = tables.value
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            whole, ids_of, held = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("held_out")
            for a, b in text_chunks(whole):
                ids, starts, places, words = numbered(whole[a:b], known)
                in_head = ids >= 0
                path, base = np.where(ids == -2, end, unseen).astype(code), np.zeros(len(ids))
                path[in_head], base[in_head] = own[ids[in_head]], logs[ids[in_head]]
                ends = np.append(starts[1:], len(ids))
                chunk, n = f"{part}-{k}", b - a
                k += 1
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n), pa.array(np.arange(n, dtype=np.int32)), ids_of.slice(a, n), held.slice(a, n), pa.array(ends - starts),
                     pa.array(np.add.reduceat(in_head, starts, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), _cut(path, ends),
                     pa.nulls(n, pa.int32()), nothing, nothing], NAMES)
                yield tail_rows(chunk, places, words)

    def tail_rows(chunk: str, places: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        bucket = bucket_of(words, buckets)
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        parts = np.split(order, first[1:]) if len(order) else []
        n = len(parts)
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
        return pa.RecordBatch.from_arrays([
            pa.array([chunk] * n, pa.string()), *empty, pa.array(present[:n].astype(np.int32), pa.int32()),
            pa.array([places[p].astype("<i4").tobytes() for p in parts], pa.binary()),
            pa.array([b"\n".join([words[x] for x in p.tolist()]) for p in parts], pa.binary())], NAMES)

    scanned = materialise(texts.mapInArrow(read, f"chunk string, nth int, {_DOC}, bucket int, places binary, words binary"), "scanned")
    tail = scanned.filter("bucket IS NOT NULL").select("bucket", "chunk", "places", "words")
    answers = (tail.groupBy("bucket").cogroup(found.filter(in_tail).groupBy("bucket"))
               .applyInArrow(_answers(code, unseen), "chunk string, places binary, ns binary, classes binary"))
    paths = materialise(scanned.filter("bucket IS NULL").drop("bucket", "places", "words").groupBy("chunk").cogroup(answers.groupBy("chunk"))
                        .applyInArrow(_filled(code), _DOC), "paths")
    step = log_steps(class_pairs(paths.filter(~F.col("held_out")), size, end))
    within = np.log10(np.maximum(mass, 1))
    within[end] = 0.0
    end_log, known_end, per_token = float(np.log10(train_docs + 1.0)), int(train_docs > 0), float(np.log10(n_train + v + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column("path").to_pylist()
            for a, b in text_chunks(all_):
                before, now, starts = path_steps(all_[a:b], code, end)
                part = batch.slice(a, b - a)
                sizes, logs = part.column("n_tokens").to_numpy(), part.column("logs").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("n_tokens"), pa.array(part.column("known").to_numpy() + known_end),
                     pa.array(np.full(b - a, n_train, np.int64)), pa.array(logs + end_log - sizes * per_token),
                     pa.array(logs + np.add.reduceat(step[before, now] - within[now], starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return paths.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
