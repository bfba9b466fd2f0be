"""The operators of the training-data subpackage against plain versions, and on odd input."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import (brown, exact_dedup, mixing, near_dedup, packing, pii, plans, quality, token_counts, tokens, topk,
                          toxicity)
from parlance.llm.common import held_out, table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], DOCS)
    if extra:
        # Names that operators use inside or return.
        for name in ("size", "target", "taken", "score", "kept", "length", "node", "label", "_size", "_key", "_row", "bucket", "band", "norm", "piece"):
            df = df.withColumn(name, F.lit("x"))
    return df


PROSE = " ".join(f"word{k % 97} and{k % 13}" for k in range(400))
ODD = [(1, None, "a"), (2, "", "b"), (3, "  \n\t ", None), (4, "one", "a"), (4, "one", "a"), (5, PROSE * 30, "a"), (None, "no id here at all", "b"),
       (6, "é<|endoftext|>☃ x", "c"), (7, PROSE, None), (8, PROSE + " end", "a"), (9, "﻿\x00\x1f\x85 y z", "c"), (10, "a  b", "b"), (11, "a b", "b")]


def results(spark, docs, vectors=None):
    labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(1, 12)], LABELS)
    yield "op1", mixing.curriculum(docs)
    yield "op2", toxicity.toxicity_scores(docs, labels)
    yield "op3", quality.quality_scores(docs, labels)
    yield "op5", brown.class_scores(docs)
    yield "op6", exact_dedup.exact_groups(docs)
    yield "op7", near_dedup.near_classes(docs)
    yield "op8", pii.personal_data(docs)
    yield "op10", token_counts.token_counts(docs)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_documents_have_a_row_each(spark, extra):
    docs = docs_of(spark, ODD, extra)
    for name, df in results(spark, docs):
        ids = Counter(r["doc_id"] for r in df.collect())
        assert ids == Counter(i for i, _, _ in ODD), name
    lengths = {(r["doc_id"], r["piece"]) for r in packing.pack(docs).collect()}
    assert {i for i, _ in lengths} == {i for i, _, _ in ODD}
    labels = spark.createDataFrame([], LABELS)
    for stage in (lambda d: toxicity.without_toxic(d, labels), exact_dedup.without_copies, near_dedup.without_near_copies, mixing.training_order):
        out = stage(docs)
        assert out.columns == docs.columns
        assert out.count() > 0


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], LABELS)
    for name, df in results(spark, docs):
        assert df.count() == 0, name
    assert packing.pack(docs).count() == 0
    for stage in (lambda d: toxicity.without_toxic(d, labels), exact_dedup.without_copies, near_dedup.without_near_copies, mixing.training_order):
        assert stage(docs).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 1 mixing

def shared_out(sizes, weights, total):
    """Hand out by weight, cut at twice the size, and hand out what is left over again."""
    target = {k: 0.0 for k in sizes}
    left = total
    while left > 1e-9:
        open_ = [k for k in sizes if target[k] < 2 * sizes[k] - 1e-9]
        if not open_:
            break
        unit = left / sum(weights[k] for k in open_)
        for k in open_:
            add = min(unit * weights[k], 2 * sizes[k] - target[k])
            target[k] += add
            left -= add
    return target


def test_mix_meets_its_targets(spark):
    docs = table(spark, SMALL, "documents")
    rows = mixing.curriculum(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = shared_out(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s in names:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.curriculum(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_schedules_invert():
    for schedule in mixing.SCHEDULES:
        share = np.linspace(0, 1, 201)
        time = mixing.inverse(share, schedule)
        assert np.allclose(mixing.integral(time, schedule), share) and (np.diff(time) >= 0).all()


def test_training_order_is_by_position(spark):
    mixed = mixing.curriculum(table(spark, SMALL, "documents"))
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    ordered = [r["doc_id"] for r in mixing.training_order(table(spark, SMALL, "documents")).collect()]
    assert Counter(ordered) == Counter({k: n for k, n in copies.items() if n})


# 2 and 3 classifiers

def test_network_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in toxicity.initial(1).items()}
    known, codes = rng.integers(0, 50, 20), rng.integers(0, 256, (20, toxicity.CHARS))
    ids, y = rng.integers(0, 21, (6, 5)), np.array([0, 1, 0, 1, 1.0])
    ids[0] = 3
    g, _ = toxicity.gradients(w, known, codes, ids, y)
    for name in w:
        at = {"word": (known[3], 0), "char": (codes[3, 0], 0)}.get(name, tuple(0 for _ in w[name].shape))
        w[name][at] += 1e-3
        up = toxicity.gradients(w, known, codes, ids, y)[1]
        w[name][at] -= 2e-3
        down = toxicity.gradients(w, known, codes, ids, y)[1]
        w[name][at] += 1e-3
        assert float(g[name][at]) == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-5), name


def test_windows_cover_each_text():
    sizes = np.array([0, 1, 32, 33, 48, 49, 200])
    place, owner = toxicity.windows(sizes, int(sizes.sum()))
    ends = np.cumsum(sizes)
    for k, n in enumerate(sizes):
        seen = set(place[:, owner == k].reshape(-1).tolist()) - {int(sizes.sum())}
        assert seen == set(range(ends[k] - n, ends[k]))


def test_network_gradients_of_long_words():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in toxicity.initial(1).items()}
    codes, counts = toxicity.spell(["short", "averylongcompound", "другоедлинноеслово", "x", "otherlongword"])
    known, ids, y = np.arange(5), rng.integers(0, 6, (6, 5)), np.array([0, 1, 0, 1, 1.0])
    ids[0] = 1
    g, _ = toxicity.gradients(w, known, codes, ids, y, counts)
    for name, at in (("char", (ord("c"), 0)), ("char", (int(codes[-10, 0]), 2)), ("mix", (5, 3)), ("mix0", (1,)), ("in", (20, 4)), ("word", (1, 0))):
        w[name][at] += 1e-4
        up = toxicity.gradients(w, known, codes, ids, y, counts)[1]
        w[name][at] -= 2e-4
        down = toxicity.gradients(w, known, codes, ids, y, counts)[1]
        w[name][at] += 1e-4
        assert float(g[name][at]) == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-5), name


def test_all_characters_are_read():
    rng = random.Random(2)
    fill = lambda: "".join(rng.choice("aeioulnrst") for _ in range(9))
    examples = [(" ".join([fill() for _ in range(12)] + [fill() + "zwqk" + fill()] * (k % 2) + [fill() for _ in range(12)]), k % 2) for k in range(600)]
    reader = toxicity.Reader(toxicity.fit(examples))
    clean = ["".join(fill() for _ in range(n)) for n in (3, 30, 300) for _ in range(20)]
    bad = [t + fill() + "zwqk" + fill() for t in clean]
    assert np.mean(reader(bad) > reader(clean)) > 0.9
    words = [fill() * 2 + "zwqk" for _ in range(50)]
    assert np.mean(reader(words) > reader([w[:-4] for w in words])) > 0.9
    assert set("".join(toxicity.tokens("ab" * 500 + "c"))) == set("abc")
    letters, latin = (set(toxicity.spell([x])[0][0].tolist()) - {0} for x in ("šũŤжあ漢", "asTc6B"))
    assert not letters & latin and len(letters) == 6


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in table(spark, sf, "labels").collect()}
    return labels, {k: plans.queries()[k](spark, sf).collect() for k in ("op2_toxicity", "op3_quality")}


# Some texts are labelled toxic at random, without anything toxic in them.
@pytest.mark.parametrize("name,label,threshold,least", [("op2_toxicity", "toxic", 0.5, 0.93), ("op3_quality", "quality", 0.3, 0.95)])
def test_held_out_ranking(scored, name, label, threshold, least):
    labels, rows = scored
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows[name])
    assert all(r["predicted"] == int(r["score"] >= threshold) for r in rows[name])
    pairs = [(r["score"], labels[r["doc_id"]][label]) for r in rows[name] if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)) / len(good) / len(bad)
    assert wins > least


# 4 top-k

def test_top_k_on_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.5, -1.25, rng.random()]) for _ in range(12)]) for k in range(150)]
    rows += [(200, None), (201, [float("nan")] * 12), (202, [1.0] * 11 + [float("inf")]), (203, [None] * 12), (None, [1.0] * 12),
             (204, [2.0, 3.0]), (250, [1.0, 1.0]), (300, []), (205, rows[0][1]), (205, rows[0][1]), (400, [3e12] + [0.0] * 11)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for r in topk.top_k(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, x in ok:
        if q % 50 == 0:
            all_ = sorted((-min(max(sum(a * b for a, b in zip(x, y)), topk.LONG[0]), topk.LONG[1]), k) for k, y in ok if k != q and len(y) == len(x))[:5]
            assert sorted(got[q]) == [(n, k, -s) for n, (s, k) in enumerate(all_, 1)], q


# 5 language model

def test_base_counts_and_better_model(spark):
    docs = table(spark, SMALL, "documents")
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", low(r["text"])) + [None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = Counter(w for k, t in texts.items() if not held[k] for w in t)
    n, v = sum(count.values()), len(count)
    for r in brown.class_scores(docs).collect():
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0


def test_tail_words_meet_their_counts(spark, monkeypatch):
    """With a head of a few words nearly all counts come by the buckets."""
    docs = docs_of(spark, [(k, " ".join(random.Random(k).choices([f"w{j}" for j in range(60)], k=50)), "a") for k in range(60)])
    want = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in brown.class_scores(docs).collect()}
    monkeypatch.setattr(brown, "HEAD", 8)
    monkeypatch.setattr(brown, "WORDS_PER_BUCKET", 7)
    for r in brown.class_scores(docs).collect():
        assert (r["n_known"], pytest.approx(r["base_score"])) == want[r["doc_id"]]


def test_head_is_the_commonest_words(spark):
    counts = [(f"w{k}".encode(), n) for k, n in enumerate([5000, 4999, 4100, 2047, 2047, 64, 64, 9, 2, 1, 1, 1])]
    df = spark.createDataFrame(counts, "word binary, n long")
    for limit in range(14):
        head = brown.head_words(df, limit)
        assert head == sorted(counts, key=lambda x: (-x[1], x[0]))[:len(head)] and len(head) <= limit
        # All words of one count belong or none does.
        assert {n for _, n in head}.isdisjoint({n for _, n in counts[len(head):]})
    assert len(brown.head_words(df, 12)) == 12 and len(brown.head_words(df, 5)) == 5


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(np.outer(rng.gamma(1, 1, 30), rng.gamma(1, 1, 30)) * 3).astype(float)

    def likelihood(owner):
        size = owner.max() + 1
        t = np.zeros((size, size))
        np.add.at(t, (owner[:, None], owner[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    values = [likelihood(brown.exchange(pairs, 26, 5, passes)) for passes in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:])) and values[-1] > values[0]


def test_best_class_is_that_of_the_greatest_likelihood():
    rng = np.random.default_rng(2)
    words, size = 12, 5
    pairs = rng.poisson(np.outer(rng.gamma(1, 1, words), rng.gamma(1, 1, words)) * 4).astype(float)
    owner = rng.integers(0, size, words)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()

    def likelihood(owner):
        t = np.zeros((size, size))
        np.add.at(t, (owner[:, None], owner[None, :]), pairs)
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    table = np.zeros((size, size))
    np.add.at(table, (owner[:, None], owner[None, :]), pairs)
    others = pairs * (1 - np.eye(words))
    right = np.array([np.bincount(owner, others[w], size) for w in range(words)])
    left = np.array([np.bincount(owner, others[:, w], size) for w in range(words)])
    best = brown.best_classes(table, owner, right, left, pairs.diagonal(), np.arange(size))
    for w in range(words):
        values = [likelihood(np.where(np.arange(words) == w, k, owner)) for k in range(size)]
        assert values[best[w]] == pytest.approx(max(values))
    assert (best != owner).any()


def test_words_outside_the_commonest_get_the_class_that_suits_them(spark, monkeypatch):
    """Rare words always in front and rare words always behind: only their classes tell the two orders apart."""
    for name, value in {"HEAD": 12, "CLUSTERED": 4, "CLASSES": 2, "BANDS": 2, "TAIL": 6, "END": 7, "SYMBOLS": 8, "TOKENS_PER_BUCKET": 500}.items():
        monkeypatch.setattr(brown, name, value)
    free = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 != 2]
    asked = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rnd = random.Random(5)
    word = lambda kind: f"{kind}{rnd.randrange(2) if rnd.random() < 0.7 else rnd.randrange(2, 40)}"
    rows = [(k, " ".join(f"{word('a')} {word('b')}" for _ in range(6)), "s") for k in free[:400]]
    front, back = "a17 b23 a30 b9 a11 b35", "b23 a17 b9 a30 b35 a11"
    assert set(front.split()) <= {w for _, t, _ in rows for w in t.split()}
    got = {r["doc_id"]: r for r in brown.class_scores(docs_of(spark, [*rows, (asked[0], front, "s"), (asked[1], back, "s")]), classes=2).collect()}
    right, wrong = got[asked[0]], got[asked[1]]
    assert right["held_out"] and wrong["held_out"] and right["n_known"] == 7 and right["base_score"] == pytest.approx(wrong["base_score"])
    assert right["score"] > wrong["score"] + 1


def test_the_model_is_a_probability(spark, monkeypatch):
    """Over all texts of one word, an unseen one included, and the empty text, probabilities add up to that of at most one word."""
    asked = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    for name, value in {"HEAD": 6, "CLUSTERED": 2, "BANDS": 2, "TAIL": 4, "END": 5, "SYMBOLS": 6}.items():
        monkeypatch.setattr(brown, name, value)
    free = [k for k in range(300) if zlib.crc32(str(k).encode()) % 7 != 2]
    words = [f"w{j}" for j in range(30)]
    rows = [(k, " ".join(random.Random(k).choices(words, weights=range(1, 31), k=8)), "s") for k in free]
    some = [(k, t, "s") for k, t in zip(asked, ["", *words, "unseen"])]
    got = {r["doc_id"]: r["score"] for r in brown.class_scores(docs_of(spark, rows + some), classes=2).collect()}
    assert 0 < sum(10 ** got[k] for k, _, _ in some) <= 1


# 6 exact dedup

def test_exact_groups_survive_colliding_digests(spark):
    rows = [(k, t, "a") for k, t in enumerate(["a b", "a\t b", "c", "c", "d", None, "", "a b "])] + [(9, "e", "a"), (9, "e", "a")]
    docs = docs_of(spark, rows)
    want = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    weak = lambda x: F.lit("same").cast("binary") if True else x
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, weak).collect())) == want
    by_id = {r[0]: r for r in want}
    assert by_id[1][1:4] == (0, 2, False) and by_id[6][1:4] == (5, 2, False) and by_id[7][1] == 7
    assert [r[3] for r in want if r[0] == 9] == [False, True]
    assert sorted(r["doc_id"] for r in exact_dedup.without_copies(docs).collect()) == [0, 2, 4, 5, 7, 9]


# 7 near dedup

@pytest.mark.parametrize("block,agreeing", [(near_dedup.BLOCK_NODES, near_dedup.AGREEING), (4, near_dedup.SAMPLES + 1)])
def test_near_classes_against_all_pairs(spark, monkeypatch, block, agreeing):
    """By leaders first, and, with no leader good enough, by small blocks alone."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", block)
    monkeypatch.setattr(near_dedup, "AGREEING", agreeing)
    rng = random.Random(8)
    base = [[f"t{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))] for _ in range(12)]
    rows = []
    for words in base:
        for copy in range(9):
            w = list(words)
            for _ in range(copy % 4 * len(w) // 120):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w).upper() if copy == 8 else " ".join(w), "a"))
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    texts = docs.select("text")
    idf = near_dedup.inverse_frequencies(near_dedup.document_frequencies(texts), len(rows))
    vectors = []
    for r in rows:
        _, value, times = near_dedup.shingles([near_dedup.words_of(r[1])], near_dedup.WordHashes())
        vectors.append(dict(zip(value.tolist(), (times * idf[near_dedup.slot(value)]).tolist())))
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = sum(min(x, vectors[b][k]) for k, x in vectors[a].items() if k in vectors[b])
        if both >= 0.8 * (sum(vectors[a].values()) + sum(vectors[b].values()) - both) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert [got[k] for k in range(len(rows))] == label
    kept = sorted(r["doc_id"] for r in near_dedup.without_near_copies(docs).collect())
    assert kept == sorted(set(label))


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(2)
    pool = near_dedup.pools()
    for share in (0.5, 0.8, 0.95):
        n = 3000
        value = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        common = rng.random(len(value)) < share
        left = np.sort(np.concatenate([value[common], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
        right = np.sort(value[common])
        one, two = (near_dedup.signatures(np.zeros(len(x), int), x, np.ones(len(x)), 1, pool)[0] for x in (left, right))
        assert abs((one == two).mean() - len(right) / len(left)) < 0.2


# 8 personal data

def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_against_plain_expressions():
    rng = random.Random(4)
    texts = ["4111 1111-1111 1111 +49 (170) 123-4567 1.2.3.4.5.6.7.8 256.1.1.1 a@b.c@d.e.f x..@y-z.q.w", "9" * 5000, "a" * 5000 + "@"]
    texts += ["".join(rng.choice("a@.1+ -2(") for _ in range(60)) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"please ring us on +49 170 55512{k:02d} today or write", "a") for k in range(20)]
    rows += [(100, "please ring us on 0170-5551234 today or write", "a"), (101, "the year 0170-5551234 was long", "a")]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(spark, rows)).collect()}
    assert spans[100] == "phone:18:30"
    assert spans[0].startswith("phone:18:")
    lone = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(spark, rows[-1:])).collect()}
    assert lone[101] == ""


def found_by_context(spark, rows):
    return {r["doc_id"]: (r["spans"], r["n_added"]) for r in pii.personal_data(docs_of(spark, rows)).collect()}


def test_contexts_with_numbers_and_text_starts_count(spark):
    rows = [(k, f"phone {k} +49 170 55512{k:02d} mobile", "a") for k in range(20)]
    rows += [(100, "phone 2 0170-5551234 mobile", "a")]
    rows += [(200 + k, f"+49 171 55512{k:02d} is my line", "a") for k in range(20)] + [(300, "0171-5551234 is my line", "a")]
    spans = found_by_context(spark, rows)
    assert spans[100] == ("phone:8:20", 1)
    assert spans[300] == ("phone:0:12", 1)


def test_candidates_with_blanks(spark):
    rows = [(k, f"please ring us on +49 170 55512{k:02d} today or write", "a") for k in range(20)]
    rows += [(100, "please ring us on 0170 555 1234 today or write", "a"), (101, "please ring us on (0170) 555 - 1234, today or write", "a"),
             (102, "please ring us on 0170 555\n1234 today or write", "a")]
    spans = found_by_context(spark, rows)
    assert spans[100] == ("phone:18:31", 1)
    assert spans[101] == ("phone:19:35", 1)
    assert "18:30" not in spans[102][0] and "18:31" not in spans[102][0]


def test_long_contexts_are_told_apart(spark):
    long = "x" * 300
    rows = [(k, f"{long}A +49 170 55512{k:02d}", "a") for k in range(20)] + [(100, f"{long}A 0170-5551234", "a"), (101, f"{long}B 0170-5551235", "a")]
    spans = found_by_context(spark, rows)
    assert spans[100] == ("phone:302:314", 1) and spans[101] == ("", 0)
    assert pii.named(long + "A") != pii.named(long + "B") and len(pii.named(long * 9)) < 200 and pii.named("b us on") == "b us on"


def test_numbers_in_a_row(spark):
    rows = [(k, f"please ring us on +49 170 55512{k:02d} today or write", "a") for k in range(20)]
    rows += [(100, "please ring us on 0170 555 1234 0171 555 9999 today", "a"), (101, "please ring us on 0170-5551234, 0171-5559999", "a")]
    spans = found_by_context(spark, rows)
    assert spans[100] == ("phone:18:31,phone:32:45", 2)
    assert spans[101] == ("phone:18:30,phone:32:44", 2)


def test_parts_of_runs_against_all_windows():
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice(["0170", "+49", "555", "1234", "(0171)", "12345678"]) for _ in range(rng.randrange(2, 9)))
        words = [(m.start(), m.end()) for m in re.finditer("[^ ]+", text)]
        run = (0, len(text), 0, len(words))
        opens = [k for k in range(1, len(words)) if text[words[k][0]] in "+(0"]
        if not opens and sum(c.isdigit() for c in text) > 19:
            opens = list(range(1, len(words)))
        cuts = [0, *opens, len(words)]
        want = {(cuts[i], cuts[j]) for i in range(len(cuts)) for j in range(i + 1, len(cuts))
                if opens == [] or sum(c.isdigit() for c in text[words[cuts[i]][0]:words[cuts[j] - 1][1]]) <= 19}
        assert {(first, after) for _, _, first, after in pii.parts_of(text, words, *run)} == want, text


def test_scores_reach_candidates_over_many_hops(spark):
    # Each instance of a link is named by the pattern before and seeds the next one.
    edges = [("p0", f"s{k}", 3, [3]) for k in range(40)]
    for hop in range(8):
        edges += [(f"p{hop + h}", f"v{hop}-{k}", None, [3]) for k in range(40) for h in (0, 1)]
    df = spark.createDataFrame(edges, "pattern string, value string, kind int, fits array<int>")
    scores = {r["value"]: r["score"] for r in pii.instance_scores(df).collect()}
    assert all(f"v{hop}-0" in scores for hop in range(8))


# 9 and 10 tokens

def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.VOCABULARY)


def test_ids_equal_the_tokenizer(spark):
    plain, fast = whole_tokenizer(), tokens.encoder()
    rng = random.Random(5)
    texts = [r["text"] or "" for r in table(spark, SMALL, "documents").collect()] + [t or "" for _, t, _ in ODD]
    texts += ["".join(rng.choice("ab 'sé\n\t1²ª×ǅ\x1c\x85\xa0.,’☃") for _ in range(40)) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_keeps_every_token(spark):
    docs = table(spark, SMALL, "documents")
    fast = tokens.encoder()
    ids = {r["doc_id"]: np.append(np.frombuffer(fast(r["text"] or ""), "<u4"), np.uint32(2)) for r in docs.collect()}
    rows = packing.pack(docs).collect()
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, whole in ids.items():
        at = 0
        for k in range(len(pieces[key])):
            r = pieces[key][k]
            part = whole[at:at + r["length"]]
            assert r["start"] == at and zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(whole) and (len(whole) > 1024 or len(pieces[key]) == 1)
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 1024
    total = sum(map(len, ids.values()))
    assert len(places) <= math.ceil(total / 1024) * 1.05 + 1


def test_fullest_combination_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 90)
        pool = [k for k, n in counts.items() for _ in range(n)]
        want = max(s for r in range(len(pool) + 1) for c in itertools.combinations(pool, r) if (s := sum(c)) <= room)
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == want and all(n <= counts[k] for k, n in got.items())


def test_sections_against_offsets(spark):
    plain = whole_tokenizer()
    texts = ["a\n\n\nb c\n", "\n", "", "x", "é☃\n\n ☃ü\nz", "one\ntwo\n\n\n\nthree \n four"]
    rows = token_counts.token_counts(docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert sum(r["section_tokens"]) == r["n_tokens"] == len(plain.encode(raw.decode(), add_special_tokens=False).ids)
        borders = token_counts.sections(raw).tolist()
        sizes = tokens.encoder().sizes[np.frombuffer(tokens.encoder()(raw.decode()), "<u4")].tolist()
        want, at = [0] * (len(borders) - 1), 0
        for n in sizes:
            shares = [max(0, min(at + n, b) - max(at, a)) for a, b in zip(borders, borders[1:])]
            want[shares.index(max(shares))] += 1
            at += n
        assert r["section_tokens"] == want and at == len(raw)


# the pipeline

def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SMALL)
        assert out.columns == docs.columns
        before, after = Counter(r["doc_id"] for r in seen.collect()), Counter(r["doc_id"] for r in out.collect())
        assert set(after) <= set(before)
        seen = spark.createDataFrame(out.collect(), out.schema)
        if name == "exact_dedup":
            assert {r["doc_id"] for r in exact_dedup.exact_groups(seen).collect() if r["group_size"] > 1} == set()
        if name == "near_dedup":
            assert {r["class_size"] for r in near_dedup.near_classes(seen).collect()} == {1}
    assert corpus_pipeline.run(spark, SMALL).columns[:2] == ["doc_id", "piece"]


def test_held_out_of_null_ids(spark):
    row = spark.createDataFrame([(None,), (3,)], "doc_id long").select(held_out(5, 0).alias("h")).collect()
    assert [r["h"] for r in row] == [True, zlib.crc32(b"3") % 5 == 0]
