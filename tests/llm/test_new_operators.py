"""Phrase mining, p-stable vector links and the Merkle manifest against plain versions, and on odd input."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle, phrases, pstable
from parlance.llm.common import table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("rank", "group", "key", "leaf", "size", "digest", "path", "seen", "w1", "n", "since", "shard", "words", "node", "unit", "keys", "_salt", "_part")


def with_clashes(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# 11 phrases

def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counts_of(rows, longest=3):
    found = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", folded(text or "")):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                found["und" if lang is None else lang].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    return found


def best_phrases(rows, threshold=10, longest=3, top=2000):
    out = []
    for lang, c in counts_of(rows, longest).items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        candidates = {k: v for k, v in c.items() if len(k) > 1 and v >= threshold}
        held = {k for k, v in candidates.items() for big, w in candidates.items() if len(big) > len(k) and 100 * w >= 50 * v
                and any(big[s:s + len(k)] == k for s in range(len(big) - len(k) + 1))}
        ranked = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for place, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, place, p.decode(), -a, l, r, n, -score))
    return sorted(out)


PIECES = [("One two one two one two one two, one two three", "en"), ("one\ttwo  ONE two. Ünï two!", "en"), (None, "en"), ("", None), (" \t\n ", "de"),
          ("to be or not to be " * 12, None), ("to be or not to be " * 12, "und"), ("a b c d " * 30, "en"), ("É é É é É é", "fr"),
          ("x" * 300 + " y " + "x" * 300 + " y", "fr"), (". , ; : ! ?", "en"), ("a\x0bb\x0cc\rd a b", "en"), ("one two", "en"), ("one two", "en")]


def documents(spark, rows):
    return spark.createDataFrame([(k % 5 if k else None, t, lang, "s", None) for k, (t, lang) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("shards,longest,threshold", [(1, 3, 3), (3, 3, 2), (2, 4, 2), (2, 2, 5)])
def test_phrases_equal_plain_counts(spark, shards, longest, threshold):
    docs = with_clashes(documents(spark, PIECES * 2))
    got = phrases.collocations(docs, threshold, shards, longest)
    assert sorted(map(tuple, got.collect())) == best_phrases(PIECES * 2, threshold, longest)


def test_dynamic_counts_are_whole(spark):
    rows = [(r["text"], r["lang"]) for r in table(spark, SMALL, "documents").select("text", "lang").collect()]
    found = phrases.dynamic_counts(table(spark, SMALL, "documents"), shards=4)
    words = {r["id"]: (r["lang"], r["word"]) for r in found.words.collect()}
    got = Counter()
    for r in found.phrases.collect():
        parts = [words[w] for w in (r["w1"], r["w2"], r["w3"]) if w]
        got[parts[0][0], tuple(w for _, w in parts)] = r["n"]
    want = {(lang, p): n for lang, c in counts_of(rows).items() for p, n in c.items() if n >= 10}
    # A phrase is only counted once what it consists of has been frequent, and then completely.
    assert got == want and found.steps > 4


def test_phrases_with_slots_marked_early_wait_for_their_words():
    # The pairs share slots with phrases frequent from step 1 on, but the first word is frequent only from step 2 on.
    words = [np.array([k], np.uint64) for k in (5, 6, 7)]
    ids, codes, due = np.array([5, 6, 7], np.uint64), np.array([0, 1, 2]), []
    for step in range(1, 6):
        table = np.full(1 << phrases.SLOT_BITS, phrases.NEVER, np.uint8)
        for since, parts in ((2, words[:1]), (1, words[1:2]), (1, words[2:]), (1, words[:2]), (1, words[1:])):
            if since < step:
                table[phrases.phrase_slot(parts)] = since
        due += [step for length, at, _ in phrases.due_phrases(table, ids, codes, 0, step, 2, 3) if length == 3 and len(at)]
    # One whole cycle over both shards.
    assert due == [3, 4]


def test_first_of_a_language_only(spark):
    rows = [(" ".join(f"w{k} v{k}." for k in range(30)) * (2 + s), "en") for s in range(2)] + [("p q. p q. r s. r s.", "de")]
    got = sorted(map(tuple, phrases.collocations(documents(spark, rows), threshold=2, top=7).collect()))
    assert got == best_phrases(rows, 2, top=7)
    assert Counter(r[0] for r in got) == {"en": 7, "de": 2}


def test_long_texts_are_cut_between_words(monkeypatch):
    text = folded("alpha beta gamma, delta " * 40 + "y" * 90 + " alpha beta").encode().translate(phrases.FOLD)
    cuts = list(phrases.slices(text, 50))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert b"".join(text[a:b] for a, b in cuts).split() == text.split()
    assert [w for a, b in cuts for w in text[a:b].split()] == text.split()
    # Chunks of three words give the same runs as the whole.
    stream = np.array([5, 6, 0, 7, 8, 9, 5, 6, 7, 8, 0, 9, 5, 6], np.uint64)
    chunks = phrases.Chunks(0, 3, 3)
    made = [c for part in (stream[:4], stream[4:9], stream[9:]) for c in chunks.add(part, False)] + list(chunks.flush())
    active = np.zeros(1 << phrases.SLOT_BITS, np.uint8)
    runs = Counter()
    for _, context, ids, codes in made:
        for length, at, _ in phrases.due_phrases(active, ids, codes, context, 1, 1, 3):
            runs.update(tuple(ids[codes[k:k + length]].tolist()) for k in at.tolist())
    want = Counter(tuple(stream[k:k + n].tolist()) for n in (1, 2, 3) for k in range(len(stream) - n + 1) if (stream[k:k + n] != 0).all())
    assert runs == want


def test_huge_pieces_go_on_in_the_next_slice(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RUN_CHARS", 300)
    rows = [("ab cd ef " * 60, "en"), ("ab, cd ef" * 70, "en"), ("gh", "en")]
    monkeypatch.setattr(phrases.slices, "__defaults__", (64,))
    assert sorted(map(tuple, phrases.collocations(documents(spark, rows), threshold=2).collect())) == best_phrases(rows, 2)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10 ** 13 - 7, 10 ** 13 - 3, 10 ** 13 - 1
    got = spark.createDataFrame([(a, l, r)], "a long, l1 long, r1 long").select(phrases._score(1)).first()[0]
    assert got == 1000000 * a * a // (l * r)


# 12 vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, cosine=0.93):
    """Links of each row and the smallest id of its component."""
    def usable(x):
        return x is not None and len(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)
    unit = [np.array(x, np.float64) / np.abs(np.array(x, np.float64)).max() if label is not None and usable(x) else None for _, x, label in rows]
    links = defaultdict(set)
    for i, (_, _, a) in enumerate(rows):
        for j, (_, _, b) in enumerate(rows):
            if i != j and unit[i] is not None and unit[j] is not None and a == b and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / math.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= cosine:
                    links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def near_groups(rng, n, dims=24, spread=0.05):
    rows = []
    for g in range(n):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (centre + rng.standard_normal(dims) * spread * rng.integers(0, 5)).astype(np.float32).tolist(), g % 3))
    return rows


def test_links_equal_brute_force(spark, monkeypatch):
    rows = near_groups(np.random.default_rng(3), 60)
    want = plain_links(rows)
    assert sum(w[1] for w in want) > 100
    df = with_clashes(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, pstable.similar_vectors(df).collect()), key=repr) == want
    # Buckets cut into many blocks count the same links.
    monkeypatch.setattr(pstable, "BLOCK_NODES", 3)
    monkeypatch.setattr(pstable, "STRIP", 2)
    monkeypatch.setattr(pstable, "SMALL", 3)
    assert sorted(map(tuple, pstable.similar_vectors(df).collect()), key=repr) == want


def test_odd_vectors(spark):
    v, tiny = [1.0, 2.0, -3.0], [1e-38, 2e-38, -3e-38]
    rows = [(1, v, 0), (1, v, 0), (2, [2.0, 4.0, -6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, -3.0], 0),
            (8, [float("nan"), 2.0, 1.0], 0), (9, [float("inf"), 2.0, 1.0], 0), (None, v, 0), (None, [5.0, -1.0, 0.0], 2), (10, [1.0, 2.0], 0), (11, [], 0),
            (12, tiny, 0), (13, [3e38, 3e38, -3e38], 3), (14, [1.0, 1.0, -1.0], 3), (15, [-1.0, -2.0, 3.0], 0)]
    got = sorted(map(tuple, pstable.similar_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert got == plain_links(rows)
    assert pstable.similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_tables_reach_the_odds_they_promise():
    """Pairs at the threshold itself meet in some table, at the stated odds."""
    rng = np.random.default_rng(8)
    key, tables = pstable.sizes(5000)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = pstable.COSINE * x + math.sqrt(1 - pstable.COSINE ** 2) * y
    drawn = pstable.projections(64, key, tables)
    met = (pstable.keys_of(x, drawn, tables) == pstable.keys_of(y, drawn, tables)).any(1).mean()
    assert met > 1 - 4 * pstable.MISSED
    assert pstable.agreement(0.374) == pytest.approx(0.9, abs=0.01) and pstable.agreement(0) == 1
    assert pstable.sizes(10 ** 6)[0] > key


# 13 manifest

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encode(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root, and for each leaf its levels as (left siblings, right siblings)."""
    ways, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 3, len(nodes))) for a in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    ways[leaf].append(([nodes[x] for x in run if x < k], [nodes[x] for x in run if x > k]))
        under = [[leaf for k in run for leaf in under[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], ways


def checks_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r, h("".join(encode(r[k]) for k in (0, 3, 2, 4, 1)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([leaf for _, leaf in groups[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for (r, leaf), way in zip(groups[s], trees[s][1]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            way = way + above[place]
            up = h("".join(map(encode, (r[0], r[3], r[2], r[4], text))))
            for left, right in way:
                up = h("".join([*left, up, *right]))
            out.append((r[0], leaf, trees[s][0], root, h("".join("".join(a + b) for a, b in way)), up, up == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PACK", 3 ** levels)
    rows = [(k, f"text {k}\nand more" if k % 3 else "no line feed", "en", f"s{k % 4}" if k % 7 else None, 5) for k in range(61)]
    rows += [(100, None, None, "only", None), (None, "no id\n", "en", "s1", 3), (None, "no id\n", "en", "s1", 3), (5, "text", "en", "s1", 1), (5, "texu", "en", "s1", 1),
             (7, "", "en", "é", 0), (8, "long\n" * 60000, "de", "ß", 300000), (9, "same", "en", "s2", 4), (9, "same", "en", "s2", 4), (9, "same", "en", "s2", 4)]
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    got = merkle.proof_checks(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == checks_of(rows)


def test_one_row_and_none(spark):
    one = [(1, "a\nb", "en", "s", 3)]
    assert sorted(map(tuple, merkle.proof_checks(spark.createDataFrame(one, DOCS)).collect()), key=repr) == checks_of(one)
    assert merkle.proof_checks(spark.createDataFrame([], DOCS)).count() == 0


def test_records_are_addressed_by_content(spark):
    made = merkle.manifest(table(spark, SMALL, "documents"))
    seen = {}
    for pack in made.packs.select("records").unionByName(made.top_packs.select("records")).collect():
        for record in pack["records"]:
            assert record["digest"] == h("".join(record["children"]))
            seen[record["digest"]] = record["children"]
    leaves = {r["leaf"] for r in made.leaves.collect()}
    todo, reached = [made.root], set()
    while todo:
        digest = todo.pop()
        if digest in seen:
            todo += seen[digest]
        else:
            reached.add(digest)
    assert reached == leaves


def test_adding_up_phrases_makes_no_second_copy_of_their_words():
    rng = np.random.default_rng(3)
    n = 200_000
    words = rng.integers(1, 1 << 40, (n, 3)).astype(np.uint64)
    tally = phrases.Tally(np.concatenate((words, words[::2])), np.ones(n + n // 2, np.uint8), np.ones(n + n // 2, np.int64))
    tracemalloc.start()
    added, value = tally.summed()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(added) == n and added.counts.sum() == n + n // 2 and (np.diff(value.view(np.int64) ^ np.int64(-1 << 63)) > 0).all()
    assert {tuple(w) for w in added.words[added.counts == 2].tolist()} == {tuple(w) for w in words[::2].tolist()}
    assert most < 72 * len(tally)
