"""Phrase collocation mining by dynamic itemset counting over shards of the corpus.

A phrase is a run of words inside a piece of text. Single words are counted from the first shard on; a longer phrase becomes
active once both phrases one word shorter, its beginning and its rest, have been seen ``THRESHOLD`` times so far. The shards
are scanned in turn, round and round. Each scan counts phrases of all lengths that are in their cycle at once, and a phrase
leaves after one full cycle, when it has met every shard once and its count is exact. Scans end when no cycle is open.

When a phrase became active is kept in a table of ``2 ** SLOT_BITS`` bytes, by hash: phrases that share a slot start together,
the earliest step counting, but none before the phrases it consists of. So some phrases are counted that needn't be, but every phrase that may reach the threshold is, and
all for exactly ``shards`` scans in a row, so no count depends on the table. Its size is fixed, and only it is broadcast.

Texts are split once: the words of a shard are stored as numbers, 64-bit hashes of word and language, in chunks with a local
alphabet of at most 65,536. Should two words share a number, which the table of words shows, the texts are split again with
other hashes. A scan counts runs of local codes by sorting them. What a task found travels as one blob for each bucket of phrase
hashes, and buckets, whose number grows with the words, are added up side by side: a row in these tables is a block of phrases.

Null texts count as empty; a null language counts as ``und``. Case is folded for A-Z only. A document given twice counts
twice. Texts of any length are read whole: pieces longer than a chunk go on in the next, which repeats their last words as
context. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import materialise, text_chunks
from parlance.operators.ordered import first_per_group
from parlance.session import new_folder

LONGEST = 3
THRESHOLD = 10
SHARDS = 2
CONTAINED = 50
TOP = 2000
UNKNOWN = "und"

SLOT_BITS, BLOCK_BITS = 23, 14
NEVER = 255
CHUNK_WORDS, ALPHABET = 200_000, 1 << 16
RUN_CHARS, SLICE_BYTES = 1_000_000, 1_000_000
LONG_WORD = 256
KNOWN_WORDS = 300_000
ROWS_HELD, WORDS_A_BUCKET = 1_500_000, 500_000
ROWS_AT_ONCE = 512
ATTEMPTS = 8

BREAK, BLANK = 10, 32
FOLD = bytes(BREAK if c in b".,;:!?\n\x0b\x0c\r" else BLANK if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Splitter:
    """Words of texts as numbers, by a rolling hash over whole runs of text."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.byte = rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 8 + 3 & (1 << 64) - 1
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.languages: dict[str, int] = {}

    def _reach(self, size: int) -> None:
        if size > len(self.powers):
            n = max(size, SLICE_BYTES)
            back = pow(self.base, -1, 1 << 64)
            self.powers, self.inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (self.base, back))

    def language(self, name: str) -> int:
        if name not in self.languages:
            self.languages[name] = _number(f"{self.seed},{name}".encode("utf-8", "surrogatepass"))
        return self.languages[name]

    def __call__(self, text: bytes, starts: np.ndarray, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number, piece, start and end of each word of folded text, whose documents have these starts and languages. No word
        has the number 0."""
        b = np.frombuffer(text, np.uint8)
        self._reach(len(b) + 1)
        inside = (b != BREAK) & (b != BLANK)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[b] * self.powers[:len(b)], dtype=np.uint64)))
        value = (sums[end] - sums[start]) * self.inverse[start]
        # Long words are hashed on their own: a rolling hash is weak on them.
        for k in np.flatnonzero(end - start > LONG_WORD).tolist():
            value[k] = _number(self.seed.to_bytes(4, "little") + text[start[k]:end[k]])
        spoken = languages[np.searchsorted(starts, start, "right") - 1]
        number = mixed(mixed(value + (end - start).astype(np.uint64) * _ODD[0]) + spoken)
        number[number == 0] = 1
        breaks = np.flatnonzero(b == BREAK)
        return number, np.searchsorted(breaks, start), start, end


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut folded text at blanks or breaks into slices of about a size; a word is never cut."""
    a = 0
    while a < len(text):
        b = min(a + size, len(text))
        if b < len(text):
            ends = [p for p in (text.rfind(b" ", a, b), text.rfind(b"\n", a, b)) if p > a]
            if ends:
                b = max(ends)
            else:
                ends = [p for p in (text.find(b" ", b), text.find(b"\n", b)) if p >= 0]
                b = min(ends, default=len(text))
        yield a, b
        a = b


class Chunks:
    """Collects the words of one shard and cuts them into chunks of bounded size and alphabet."""

    def __init__(self, shard: int, longest: int, size: int = CHUNK_WORDS):
        self.shard, self.longest, self.size = shard, longest, size
        self.parts, self.held, self.tail = [], 0, np.zeros(0, np.uint64)

    def add(self, numbers: np.ndarray, fresh: bool) -> Iterator[tuple]:
        """Numbers with 0 between pieces; ``fresh`` where the first does not go on with the piece before."""
        if fresh and (self.held or len(self.tail)):
            self.parts.append(np.zeros(1, np.uint64))
        self.parts.append(numbers)
        self.held += len(numbers)
        if self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.concatenate([self.tail, *self.parts])
        at = len(self.tail)
        while at < len(stream):
            low, cut = max(at - self.longest + 1, 0), min(at + self.size, len(stream))
            while True:
                ids, codes = np.unique(stream[low:cut], return_inverse=True)
                if len(ids) <= ALPHABET:
                    break
                cut = at + (cut - at) // 2
            yield self.shard, at - low, ids, codes.astype("<u2")
            at = cut
        self.tail, self.parts, self.held = stream[max(len(stream) - self.longest + 1, 0):], [], 0


CHUNK_TYPES = [("shard", pa.int32()), ("context", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()),
               ("words", pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string())]))),
               ("spoken", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))]
CHUNK_DDL = ("shard int, context int, ids binary, codes binary, words array<struct<id: long, lang: string, word: string>>, "
             "spoken array<struct<lang: string, n: long>>")


def split(docs: DataFrame, seed: int, shards: int, longest: int) -> DataFrame:
    """Chunks of all texts: shard, context, ids, codes, the words that are new to the task, and words per language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, chunks = Splitter(seed), [Chunks(k, longest) for k in range(shards)]
        known: set[int] = set()
        words: list[dict] = []
        spoken: dict[str, int] = {}

        def rows(made: list[tuple]) -> pa.RecordBatch:
            columns = [[m[0] for m in made], [m[1] for m in made], [m[2].tobytes() for m in made], [m[3].tobytes() for m in made],
                       [words] + [[]] * (len(made) - 1), [[{"lang": k, "n": n} for k, n in spoken.items()]] + [[]] * (len(made) - 1)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, CHUNK_TYPES)], [n for n, _ in CHUNK_TYPES])
            words.clear()
            spoken.clear()
            return batch

        def run(texts: list[bytes], langs: list[str], where: list[int]) -> Iterator[tuple]:
            folded = [t.translate(FOLD) for t in texts]
            whole = folded[0] if len(folded) == 1 else b"\n".join(folded)
            cuts = slices(whole) if len(folded) == 1 else [(0, len(whole))]
            begin = np.cumsum([0, *(len(t) + 1 for t in folded)])[:-1]
            tongue, home = np.array([splitter.language(x) for x in langs], np.uint64), np.array(where)
            fresh = True
            for a, b in cuts:
                part = whole[a:b]
                number, piece, start, end = splitter(part, begin, tongue)
                if not len(number):
                    fresh = fresh or b"\n" in part
                    continue
                owner = np.searchsorted(begin, start, "right") - 1
                ids, first = np.unique(number, return_index=True)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for n, k in zip(ids.view(np.int64).tolist(), first.tolist()):
                    if n not in known:
                        known.add(n)
                        words.append({"id": n, "lang": langs[owner[k]], "word": part[start[k]:end[k]].decode("utf-8", "replace")})
                for k, n in enumerate(np.bincount(owner, minlength=len(langs)).tolist()):
                    if n:
                        spoken[langs[k]] = spoken.get(langs[k], 0) + n
                # The first piece of a slice goes on with the slice before, unless a break lies between.
                fresh = fresh or piece[0] > 0
                for chunk in chunks:
                    mine = home[owner] == chunk.shard
                    if mine.any():
                        yield from chunk.add(np.insert(number[mine], np.flatnonzero(np.diff(piece[mine])) + 1, np.uint64(0)), fresh)
                fresh = part.find(b"\n", int(end[-1])) >= 0

        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            texts, langs, where = (batch.column(c).to_pylist() for c in ("text", "lang", "shard"))
            for a, b in text_chunks(texts, RUN_CHARS):
                # A very long text stands alone, so that it can be cut.
                cuts = [a, *(k for k in range(a + 1, b) if len(texts[k]) > RUN_CHARS), b]
                for c, d in zip(cuts, cuts[1:]):
                    made = list(run([t.encode("utf-8", "surrogatepass") for t in texts[c:d]], langs[c:d], where[c:d]))
                    if made:
                        yield rows(made)
        made = [m for chunk in chunks for m in chunk.flush()]
        if not made and (words or spoken):
            made = [(0, 0, np.zeros(0, np.uint64), np.zeros(0, "<u2"))]
        if made:
            yield rows(made)

    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(UNKNOWN))
    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    return docs.select(text.alias("text"), lang.alias("lang"), home.alias("shard")).mapInArrow(read, CHUNK_DDL)


def phrase_slot(parts: list[np.ndarray]) -> np.ndarray:
    """Slot of a phrase in the table of activation steps; the parts are the numbers of its words."""
    value = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        value = mixed(value * _ODD[1] + p)
    return (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def due_phrases(table: np.ndarray, ids: np.ndarray, codes: np.ndarray, context: int, step: int, shards: int,
                longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, steps of activation) of the phrases of a chunk that are in their cycle at a step."""
    stream = ids[codes]
    at = np.flatnonzero(stream != 0)
    begun = np.zeros(len(at), np.uint8)
    for length in range(1, longest + 1):
        if length > 1:
            # When the phrases one shorter became active, by place; NEVER where there is none.
            active = np.full(len(stream) + 1, NEVER, np.uint8)
            marked = table[phrase_slot([ids])][codes[at]] if length == 2 else table[phrase_slot([stream[at + k] for k in range(length - 1)])]
            # A slot may be marked early for another phrase; none is active before its own parts are.
            active[at] = np.maximum(marked, begun)
            begun = np.maximum(active[at], active[at + 1])
            at, begun = at[begun < NEVER], begun[begun < NEVER]
        due = (begun < step) & (begun.astype(np.int64) + shards >= step) & (at + length - 1 >= context)
        yield length, at[due], begun[due]


BLOBS_DDL = "kind int, bucket int, words binary, since binary, counts binary"
RUNNING, DONE, RISING = 0, 1, 2


@dataclass
class Tally:
    """Phrases side by side: the numbers of their words (0 behind the end), when they became active, how often they were seen."""

    words: np.ndarray
    since: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, parts: list[Tally], longest: int) -> Tally:
        if not parts:
            return cls(np.zeros((0, longest), np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("words", "since", "counts")))

    @classmethod
    def read(cls, words: bytes, since: bytes, counts: bytes, longest: int) -> Tally:
        return cls(np.frombuffer(words, "<u8").reshape(-1, longest), np.frombuffer(since, np.uint8), np.frombuffer(counts, "<i8"))

    def blobs(self) -> tuple[bytes, bytes, bytes]:
        return self.words.tobytes(), self.since.tobytes(), self.counts.tobytes()

    def __getitem__(self, rows) -> Tally:
        return Tally(self.words[rows], self.since[rows], self.counts[rows])

    def __len__(self) -> int:
        return len(self.counts)

    def order(self) -> np.ndarray:
        """A 64-bit hash of each phrase, by which phrases are sorted and dealt into buckets."""
        value = np.zeros(len(self), np.uint64)
        for k in range(self.words.shape[1]):
            value = mixed(value * _ODD[2] + self.words[:, k] + _ODD[3])
        return value

    def summed(self) -> tuple[Tally, np.ndarray]:
        """Each phrase once, in the order of the hashes, which come along."""
        value = self.order()
        at = np.argsort(value)
        value = value[at]
        other = self._other(at)
        if (other & (value[1:] == value[:-1])).any():
            # Different phrases with one hash: sort by the words themselves as well.
            at = np.lexsort((*self.words.T, self.order()))
            other = self._other(at)
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), other)))
        counts = np.add.reduceat(self.counts[at], starts) if len(starts) else np.zeros(0, np.int64)
        value, at = value[starts], at[starts]
        return Tally(self.words[at], self.since[at], counts), value

    def _other(self, at: np.ndarray) -> np.ndarray:
        """Whether a phrase differs from the one before it, in an order; column by column, without a copy of all words."""
        other = np.zeros(max(len(at) - 1, 0), bool)
        for column in self.words.T:
            column = column[at]
            other |= column[1:] != column[:-1]
        return other


def scan(chunks: DataFrame, active, step: int, shards: int, longest: int, buckets: int) -> DataFrame:
    """Counts of the phrases in their cycle at a step, as blobs for each bucket of hashes."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def dealt(parts: list[Tally]) -> Iterator[pa.RecordBatch]:
        """The parts, which are let go, added up; a bucket at a time, so that no second copy of all is made."""
        held = Tally.of(parts, longest)
        parts.clear()
        tally, value = held.summed()
        del held
        cuts = np.append(np.searchsorted(value, edges), len(value))
        del value
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([RUNNING], pa.int32()), pa.array([k], pa.int32()), *(pa.array([b], pa.binary()) for b in tally[cuts[k]:cuts[k + 1]].blobs())],
                                             ["kind", "bucket", "words", "since", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for context, ids, codes in zip(batch.column("context").to_pylist(), batch.column("ids"), batch.column("codes")):
                ids, codes = np.frombuffer(ids.as_buffer(), np.uint64), np.frombuffer(codes.as_buffer(), "<u2")
                for length, at, begun in due_phrases(active.value, ids, codes, context, step, shards, longest):
                    if not len(at):
                        continue
                    each = [codes[at + k] for k in range(length)]
                    if length <= 3:
                        key = np.zeros(len(at), np.int64)
                        for p in each:
                            key = key << 16 | p
                        first, n = np.unique(key, return_index=True, return_counts=True)[1:]
                    else:
                        first, n = np.unique(np.stack(each, 1), axis=0, return_index=True, return_counts=True)[1:]
                    words = np.zeros((len(first), longest), np.uint64)
                    for k, p in enumerate(each):
                        words[:, k] = ids[p[first]]
                    parts.append(Tally(words, begun[first], n.astype(np.int64)))
                    held += len(first)
                if held >= ROWS_HELD:
                    yield from dealt(parts)
                    held = 0
        if parts:
            yield from dealt(parts)

    return chunks.filter(F.col("shard") == (step - 1) % shards).select("context", "ids", "codes").mapInArrow(count, BLOBS_DDL)


def added_up(blobs: DataFrame, step: int, shards: int, longest: int, threshold: int) -> DataFrame:
    """The blobs of each bucket as one of each kind: what is still in its cycle, what has completed it and reached the
    threshold, and once more what has reached it on the way. The rest is forgotten."""

    def add(part: pa.Table) -> pa.Table:
        columns = [[x.as_buffer() for x in part.column(c)] for c in ("words", "since", "counts")]
        bucket = part.column("bucket")[0].as_py()
        held = Tally.of([Tally.read(w, s, c, longest) for w, s, c in zip(*columns)], longest)
        del columns, part
        tally = held.summed()[0]
        del held
        ended, often = tally.since.astype(np.int64) + shards <= step, tally.counts >= threshold
        rows = [(kind, tally[chosen].blobs()) for kind, chosen in ((RUNNING, ~ended), (DONE, ended & often), (RISING, ~ended & often)) if chosen.any()]
        return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), *(pa.array([b[k] for _, b in rows], pa.binary()) for k in range(3))],
                        names=["kind", "bucket", "words", "since", "counts"])

    return blobs.groupBy("bucket").applyInArrow(add, BLOBS_DDL)


def activate(table: np.ndarray, frequent: DataFrame, step: int, longest: int) -> bool:
    """Enter the step in the slots of phrases that may begin or end a longer one; whether any slot was free."""
    size, block = 1 << SLOT_BITS, 1 << BLOCK_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                words = np.frombuffer(blob, "<u8").reshape(-1, longest)
                length = (words != 0).sum(1)
                for k in range(1, longest):
                    mine = words[length == k]
                    bits[phrase_slot([mine[:, j] for j in range(k)])] = True
        rows = bits.reshape(-1, block)
        used = np.flatnonzero(rows.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(rows[k]).tobytes() for k in used], pa.binary())], ["block", "bits"])

    def either(part: pd.DataFrame) -> pd.DataFrame:
        found = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in part["bits"]])
        return pd.DataFrame([(part["block"].iloc[0], found.tobytes())], columns=["block", "bits"])

    kind, any_free = "block int, bits binary", False
    for row in frequent.select("words").mapInArrow(mark, kind).groupBy("block").applyInPandas(either, kind).collect():
        slots = table[row["block"] * block:(row["block"] + 1) * block]
        free = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool) & (slots == NEVER)
        slots[free] = step
        any_free = any_free or bool(free.any())
    return any_free


def as_rows(blobs: DataFrame, longest: int) -> DataFrame:
    """Counted phrases as rows w1 ..., n."""
    names = [f"w{k + 1}" for k in range(longest)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                words = np.frombuffer(w, "<i8").reshape(-1, longest)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(words[:, k])) for k in range(longest)), pa.array(np.frombuffer(c, "<i8"))], [*names, "n"])

    return blobs.select("words", "counts").mapInArrow(rows, ", ".join(f"{n} long" for n in [*names, "n"]))


@dataclass
class Counts:
    """``phrases``: w1 ..., n of all phrases of at least the threshold; ``words``: id, lang, word; ``spoken``: lang, n."""

    phrases: DataFrame
    words: DataFrame
    spoken: DataFrame
    steps: int


def _split_whole(docs: DataFrame, shards: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Chunks by shard, and the table of words, with a hash under which no two words share a number."""
    spark = docs.sparkSession
    for seed in range(ATTEMPTS):
        path = new_folder(spark, "phrase-chunks")
        split(docs, seed, shards, longest).write.partitionBy("shard").parquet(path)
        chunks = spark.read.schema(CHUNK_DDL).parquet(path)
        each = chunks.select(F.explode("words").alias("w")).select("w.id", "w.lang", "w.word")
        spelled = F.struct("lang", "word")
        words = materialise(each.groupBy("id").agg(F.min(spelled).alias("w"), (F.min(spelled) != F.max(spelled)).alias("shared")), "phrase-words")
        if words.filter("shared").isEmpty():
            return chunks, words.select("id", "w.lang", "w.word")
    raise RuntimeError("words share hashes under every seed")


def dynamic_counts(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, longest: int = LONGEST) -> Counts:
    """Exact counts of all phrases of 1 to ``longest`` words that occur ``threshold`` times."""
    if not 0 < longest * shards < NEVER:
        raise ValueError("too many steps for a byte")
    spark = docs.sparkSession
    chunks, words = _split_whole(docs, shards, longest)
    spoken = materialise(chunks.select(F.explode("spoken").alias("s")).groupBy("s.lang").agg(F.sum("s.n").alias("n")), "phrase-languages")
    buckets = max(1, -(-(spoken.agg(F.sum("n")).first()[0] or 0) // WORDS_A_BUCKET))
    table = np.full(1 << SLOT_BITS, NEVER, np.uint8)
    running = done = None
    step = last = 0
    while step < last + shards:
        step += 1
        active = spark.sparkContext.broadcast(table)
        blobs = scan(chunks, active, step, shards, longest, buckets)
        blobs = blobs if running is None else blobs.unionByName(running)
        path = new_folder(spark, "phrase-counts")
        added_up(blobs, step, shards, longest, threshold).write.partitionBy("kind").parquet(path)
        active.destroy()
        counted = spark.read.schema(BLOBS_DDL).parquet(path)
        running, finished = (counted.filter(F.col("kind") == k) for k in (RUNNING, DONE))
        done = finished if done is None else done.unionByName(finished)
        if activate(table, counted.filter(F.col("kind") != RUNNING), step, longest):
            last = step
    return Counts(materialise(as_rows(done, longest), "phrases"), words, spoken, step)


def _score(k: int) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts below 10**14: ``div`` of decimals gives a long."""
    a, l, r = (f"cast({c} as decimal(14, 0))" for c in ("a", f"l{k}", f"r{k}"))
    return F.expr(f"(1000000BD * {a} * {a}) div ({l} * {r})")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, longest: int = LONGEST,
                 contained: int = CONTAINED, top: int = TOP) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = dynamic_counts(docs, threshold, shards, longest)
    names = [f"w{k + 1}" for k in range(longest)]
    none = F.lit(0).cast("long")
    phrases = counts.phrases.withColumn("size", sum((F.col(c) != 0).cast("int") for c in names))

    def part(words: list[Column], prefix: str) -> list[Column]:
        return [w.alias(f"{prefix}{k}") for k, w in enumerate(words + [none] * (longest - len(words)))]

    def counted_by(prefix: str, value: str) -> DataFrame:
        return counts.phrases.select(*(F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(names)), F.col("n").alias(value))

    scored = None
    for size in range(2, longest + 1):
        mine = phrases.filter(F.col("size") == size).select(*names, F.col("n").alias("a"))
        w = [F.col(c) for c in names[:size]]
        for k in range(1, size):
            left, right = f"l{k}_", f"r{k}_"
            mine = mine.select("*", *part(w[:k], left), *part(w[k:], right))
            for prefix, value in ((left, f"l{k}"), (right, f"r{k}")):
                keys = [f"{prefix}{j}" for j in range(longest)]
                mine = mine.join(counted_by(prefix, value), keys).drop(*keys)
        cuts = [F.struct(_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        best = (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("best")
        mine = mine.select(*names, "a", best).select(*names, "a", "best.l", "best.r", "best.score")
        scored = mine if scored is None else scored.unionByName(mine)
    # The most frequent longer candidate around each phrase.
    around = None
    for size in range(3, longest + 1):
        mine = phrases.filter(F.col("size") == size)
        w = [F.col(c) for c in names[:size]]
        for inner in range(2, size):
            for at in range(size - inner + 1):
                found = mine.select(*part(w[at:at + inner], "_w"), F.col("n").alias("outer"))
                around = found if around is None else around.unionByName(found)
    if around is not None:
        around = around.groupBy(*(f"_w{k}" for k in range(longest))).agg(F.max("outer").alias("outer"))
        same = [F.col(c) == F.col(f"_w{k}") for k, c in enumerate(names)]
        scored = (scored.join(around, same, "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * contained))
                  .select(*names, "a", "l", "r", "score"))
    spelled = None
    for size in range(2, longest + 1):
        mine = scored.filter(F.col(names[size - 1]) != 0)
        mine = mine if size == longest else mine.filter(F.col(names[size]) == 0)
        for k, c in enumerate(names[:size]):
            mine = mine.join(counts.words.select(F.col("id").alias(c), *([F.col("lang")] if k == 0 else []), F.col("word").alias(f"_{c}")), c)
        mine = mine.select("lang", F.concat_ws(" ", *(f"_{c}" for c in names[:size])).alias("phrase"), "a", "l", "r", "score")
        spelled = mine if spelled is None else spelled.unionByName(mine)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = first_per_group(spelled, ["lang"], order, top, "phrase")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(counts.spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
