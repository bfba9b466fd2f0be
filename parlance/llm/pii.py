"""Personal data by base expressions and bootstrapped contextual extraction.

Base expressions find emails, addresses, cards and phones. Their finds are seeds: the words around them are lexical
patterns, and every other token with a digit or an at sign is a candidate, and so is every longest run of number-like
tokens with nothing but blanks between them, with its parts that begin like a number (``parts_of``), as long as they have no
more digits than a card. In a context any word with a digit or an at sign is the same placeholder, and what lies before a text
is a boundary mark; a member of a list of identifiers also takes the two words before the list as its context. Spark scores the graph of patterns and
instances in rounds: a pattern is as sure of a kind as its distinct instances are, an instance as sure as the patterns
that name it together. Scores only grow, up to a bound; the rounds end when no score grew by more than ``TOLERANCE``.
Candidates above ``SURE`` become spans of that kind, beside the base spans, which all stay; of nested ones the longest.

A pattern counts once ``SUPPORT`` distinct instances have met in it, so that a passage copied into many documents says no
more than once. Null texts count as empty and have no spans. Repeated rows are found apart; an empty table gives no rows.
Texts of any length are searched whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import WORDS, materialise, whole_text

KINDS = ("email", "ip", "card", "phone")
TOLERANCE = 1e-4
SUPPORT = 4
SURE = 0.8
LEAST = 0.1
# Kinds whose base forms may hold blanks.
BLANKS = (2, 3)
CARD_DIGITS = 19
NAME = 200

# Base expressions as the contract gives them; the domain part and the digit guard below keep their scans linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile("[0-9@]")
_TRIM = "\"'()[]{}<>,;:!?."
_PART = re.compile("[0-9+()./-]+")
# No word holds a tab.
_NUMBER, _EDGE = "\t#", "\t^"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, number of the kind, end), in order."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _fits(kind: int, value: str) -> bool:
    """The least an identifier of a kind looks like."""
    digits = sum(c.isdigit() for c in value)
    return (("@" in value), (digits >= 3 and value.count(".") + value.count(":") >= 2), digits >= 8, 6 <= digits <= 15)[kind]


def runs(text: str, words: list[tuple[int, int]], free: list[bool]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first word, word after) of the longest runs of at least two number-like words between blanks.

    ``free`` tells the words that no base span touches. Signs may stand alone inside a run; other marks at the edge of a
    word end it there.
    """
    k = 0
    while k < len(words):
        first, numbers, begin, end, after = k, 0, 0, 0, k
        while k < len(words) and free[k]:
            a, b = words[k]
            word = text[a:b]
            core = word.strip(_TRIM) or word
            left = word.index(core)
            has_digit = bool(_DIGIT.search(core))
            if not _PART.fullmatch(core) or not (numbers or has_digit):
                break
            if numbers and (word[:left].strip("(") or text[words[k - 1][1]:a].strip(" ")):
                break
            if has_digit:
                begin = begin if numbers else a + left
                numbers, end, after = numbers + 1, a + left + len(core), k + 1
            k += 1
            if word[left + len(core):].strip(")"):
                break
        if numbers > 1:
            yield begin, end, first, after
        k = max(k, first + 1)


def parts_of(text: str, words: list[tuple[int, int]], begin: int, end: int, first: int, after: int) -> list[tuple[int, int, int, int]]:
    """The parts of a run that may be identifiers, as the run itself is given: from one number start to before another.

    A number starts with the run, or at a word with a plus, a bracket or a nought in front. A run of more digits than a card
    has and without such starts is cut at every word. Parts have at most ``CARD_DIGITS`` digits, so they are few for each start.
    """
    inside = [k for k in range(first, after) if _DIGIT.search(text, *words[k])]
    opens = [k for k in inside[1:] if text[words[k][0]] in "+(0"]
    total = sum(c.isdigit() for c in text[begin:end])
    if total > CARD_DIGITS and not opens:
        opens = inside[1:]
    if not opens:
        return [(begin, end, first, after)]
    cuts = [first, *opens, after]
    out = []
    for at, k in enumerate(cuts[:-1]):
        for place in range(at + 1, len(cuts)):
            last = inside[bisect_left(inside, cuts[place]) - 1]
            a = begin if k == first else words[k][0]
            b = end if last == inside[-1] else words[last][0] + len(text[slice(*words[last])].rstrip(_TRIM))
            if sum(c.isdigit() for c in text[a:b]) > CARD_DIGITS:
                break
            out.append((a, b, k, last + 1))
    return out


def named(pattern: str) -> str:
    """A pattern as a name of bounded length, different for different patterns."""
    return pattern if len(pattern) <= NAME else pattern[:NAME // 2] + hashlib.md5(pattern.encode("utf-8", "surrogatepass")).hexdigest()


def occurrences(text: str, spans: list[Span]) -> list[dict]:
    """Seeds and candidates with the patterns around them: the two words before, and the words on both sides."""
    if not _MARK.search(text):
        return []
    words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    starts = [(a, b, kind) for a, kind, b in spans]
    marked, covered, free = [], 0, [True] * len(words)
    for k, (a, b) in enumerate(words):
        while covered < len(starts) and starts[covered][1] <= a:
            covered += 1
        if covered < len(starts) and starts[covered][0] < b:
            free[k] = False
            if starts[covered][0] >= a:
                s, e, kind = starts[covered]
                after = k
                while after < len(words) and words[after][0] < e:
                    after += 1
                marked.append((s, e, kind, k, after))
            continue
        if _MARK.search(text, a, b):
            value = text[a:b]
            left = len(value) - len(value.lstrip(_TRIM))
            core = value.strip(_TRIM)
            if core and any(_fits(kind, core) for kind in range(len(KINDS))):
                marked.append((a + left, a + left + len(core), None, k, k + 1))
    for run in runs(text, words, free):
        for s, e, first, after in parts_of(text, words, *run):
            if after > first + 1 and sum(c.isdigit() for c in text[s:e]) <= CARD_DIGITS and any(_fits(kind, text[s:e]) for kind in BLANKS):
                marked.append((s, e, None, first, after))
    # Where a list of identifiers, one right behind another, begins that ends before a word.
    list_start: dict[int, int] = {}
    for _, _, _, first, after in sorted(marked, key=lambda m: m[3:]):
        list_start[after] = min(list_start.get(first, first), list_start.get(after, first))

    def around(k: int) -> str:
        if k < 0:
            return _EDGE
        word = text[slice(*words[k])]
        return _NUMBER if _MARK.search(word) else word.lower()

    out = []
    for s, e, kind, first, after in marked:
        word = [around(first - 2), around(first - 1)]
        right = around(after) if after < len(words) else ""
        patterns = [f"b {' '.join(word)}", f"a {word[-1]} _ {right}"]
        if first in list_start:
            head = list_start[first]
            patterns.append(f"b {around(head - 2)} {around(head - 1)}")
        value = text[s:e]
        kinds = BLANKS if after > first + 1 else range(len(KINDS))
        fits = [kind] if kind is not None else [j for j in kinds if _fits(j, value)]
        out.append({"start": s, "end": e, "kind": kind, "value": value[:64] + hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest(),
                    "patterns": list(map(named, patterns)), "fits": fits})
    return out


FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "base array<struct<start:long,kind:int,end:long>>, "
         "seen array<struct<start:long,end:long,kind:int,value:string,patterns:array<string>,fits:array<int>>>")
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()),
                   ("patterns", pa.list_(pa.string())), ("fits", pa.list_(pa.int32()))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, base, seen = [], [], []
        for value in batch.column("text"):
            text = value.as_py()
            spans = base_spans(text)
            for kind, column in enumerate(counts):
                column.append(sum(s[1] == kind for s in spans))
            digests.append(hashlib.sha256(listed(spans).encode()).hexdigest())
            base.append([{"start": a, "kind": kind, "end": b} for a, kind, b in spans])
            seen.append(occurrences(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
             pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "seen"])


def instance_scores(edges: DataFrame, tolerance: float = TOLERANCE, support: int = SUPPORT) -> DataFrame:
    """(value, kind, score) of candidates at the fixpoint; ``edges`` has (pattern, value, kind or null, fits)."""
    edges = materialise(edges, "pattern-edges")
    seeds = edges.filter("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    open_edges = edges.filter("kind IS NULL").select("pattern", "value", "fits")
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    wide_edges = materialise(edges.select("pattern", "value").join(wide, "pattern"), "wide-edges")
    scores, before = seeds, None
    while True:
        patterns = (wide_edges.join(scores, "value").groupBy("pattern", "kind")
                    .agg((F.sum("score") / (F.first("n") + 1)).alias("trust")).filter(F.col("trust") >= LEAST))
        named = (open_edges.join(patterns, "pattern").filter(F.array_contains("fits", F.col("kind")))
                 .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score")))
        candidates = materialise(named, "instance-scores")
        if before is None:
            grown = candidates.agg(F.max("score")).first()[0]
        else:
            old = before.select("value", "kind", F.col("score").alias("old"))
            grown = candidates.join(old, ["value", "kind"], "left").agg(F.max(F.col("score") - F.coalesce("old", F.lit(0.0)))).first()[0]
        if (grown or 0.0) <= tolerance:
            return candidates
        # A value may be a seed in one place and a candidate in another.
        scores, before = seeds.unionByName(candidates).groupBy("value", "kind").agg(F.max("score").alias("score")), candidates


def personal_data(docs: DataFrame, tolerance: float = TOLERANCE, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, and all spans as one string."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = materialise(texts.mapInArrow(_find, FOUND).withColumn("_row", F.monotonically_increasing_id()), "spans")
    seen = found.select("_row", F.explode("seen").alias("o")).select("_row", "o.*")
    edges = (seen.select(F.explode("patterns").alias("pattern"), "value", "kind", "fits")
             .groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.first("fits").alias("fits")))
    scores = instance_scores(edges, tolerance, support).filter(F.col("score") >= sure)
    best = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    wider = F.max("end").over(Window.partitionBy("_row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    added = (seen.filter("kind IS NULL").select("_row", "start", "end", "value").join(best, "value")
             .withColumn("wider", wider).filter("wider IS NULL OR wider < end").groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")))
    rows = found.join(added, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", _listed(every).alias("spans"),
                       F.size(F.coalesce("added", F.array())).cast("long").alias("n_added"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
