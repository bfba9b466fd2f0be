"""The numeric operators against plain loops."""

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from parlance.llm import mixing, quality, toxicity
from parlance.llm.common import labelled_sample, held_out, table

SMALL = "/root/testdata/sf0.001"


# 2 toxicity

def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_pass(w, inputs, u):
    h, states = np.zeros(toxicity.HIDDEN), []
    for x in inputs:
        z, r, n = (x[k * toxicity.HIDDEN:(k + 1) * toxicity.HIDDEN] for k in range(3))
        gz, gr, gn = (h @ u[:, k * toxicity.HIDDEN:(k + 1) * toxicity.HIDDEN] for k in range(3))
        gate, reset = 1 / (1 + np.exp(-(z + gz))), 1 / (1 + np.exp(-(r + gr)))
        new = np.tanh(n + reset * gn)
        h = (1 - gate) * new + gate * h
        states.append(h)
    return states


def plain_score(model, text):
    """The worst window of a text, one word after another."""
    w, vocabulary = model
    words = toxicity.tokens(text)
    inputs = []
    for word in words:
        codes, _ = toxicity.spell([word])
        runs = [np.tanh(np.concatenate([w["char"][c] for c in run]) @ w["mix"] + w["mix0"]) for run in codes]
        x = np.concatenate([w["word"][vocabulary.get(word, 0)], runs[0], np.max(runs, 0)])
        inputs.append(x @ w["in"] + w["in0"])
    worst, size, step = 0.0, toxicity.WINDOW, toxicity.STRIDE
    for a in range(0, max(1, len(words) - size + step) if words else 0, step):
        part = inputs[a:a + size]
        ahead = plain_pass(w, [x[:3 * toxicity.HIDDEN] for x in part], w["fwd"])
        behind = plain_pass(w, [x[3 * toxicity.HIDDEN:] for x in reversed(part)], w["bwd"])[::-1]
        states = [np.concatenate(s) for s in zip(ahead, behind)]
        asked = [math.exp(np.tanh(s @ w["att"] + w["att0"]) @ w["ask"]) for s in states]
        pooled = sum(a * s for a, s in zip(asked, states)) / sum(asked)
        worst = max(worst, sigmoid(float(pooled @ w["out"] + w["out0"][0])))
    return worst


def test_scores_equal_a_plain_forward_pass():
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    model = toxicity.initial(3), {word: k for k, word in enumerate(pool[:40], 1)}
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 48, 49, 100)]
    assert np.allclose(toxicity.Reader(model)(texts), [plain_score(model, t) for t in texts], atol=1e-5)


def test_training_in_small_runs_is_the_same(monkeypatch):
    rng = random.Random(2)
    examples = [(" ".join(rng.choice(["good", "fine", "bad", "vile", f"w{rng.randrange(40)}"][:3 + 2 * (k % 2)]) for _ in range(40)), k % 2) for k in range(40)]
    whole = toxicity.fit(iter(examples), rounds=4)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 5)
    parts = toxicity.fit(examples, rounds=4)
    assert whole[1] == parts[1] and all(np.allclose(whole[0][k], parts[0][k], atol=1e-3) for k in whole[0])


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 6, f"text {k} " * (1 + k)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    away = held_out(5, 9)
    every = list(labelled_sample(docs, labels, "toxic", 10, away))
    # Of an id's texts one is taken, and of many characters only so many.
    assert Counter(y for _, y in every) == {0: 3, 1: 3}
    assert len(list(labelled_sample(docs, labels, "toxic", 1, away))) == 2
    few = list(labelled_sample(docs, labels, "toxic", 10, away, chars=40))
    assert all(sum(len(t) for t, y in few if y == v) <= 40 for v in (0, 1))


# 3 quality

def plain_weights(examples, bits, epochs, seed):
    hashes = quality.WordHashes()
    rows = []
    for text, _ in examples:
        _, slot, value = quality.features([text], hashes, bits)
        rows.append(list(zip(slot.tolist(), value.astype(np.float32).tolist())))
    labels = [y for _, y in examples]
    bias = math.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))
    z, n, zb, nb, shift = defaultdict(float), defaultdict(float), 0.0, 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -math.copysign(abs(z[k]) - quality.L1, z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in order.permutation(len(rows)):
            now = {k: weight(k) for k, _ in rows[at]}
            p = sigmoid(bias + shift + sum(now[k] * v for k, v in rows[at]))
            for k, v in rows[at]:
                g = (p - labels[at]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * now[k]
                n[k] += g * g
            step = p - labels[at]
            zb += step - (math.sqrt(nb + step * step) - math.sqrt(nb)) / 0.1 * shift
            nb += step * step
            shift = -zb / ((quality.BETA + math.sqrt(nb)) / 0.1)
    return {k: weight(k) for k in z}, bias + shift


def test_updates_and_dot_products_equal_plain_ones():
    rng = random.Random(8)
    examples = [(" ".join(rng.choice("aa bb cc dd ee ff".split()[2 * (k % 2):]) for _ in range(12)), k % 2) for k in range(60)]
    weights, bias = quality.fit(examples, bits=12, epochs=2, seed=3)
    want, offset = plain_weights(examples, 12, 2, 3)
    assert bias == pytest.approx(offset, abs=1e-6)
    assert all(weights[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert set(np.flatnonzero(weights)) <= set(want)
    texts = ["", "aa bb aa", "zz", " ".join("cc dd" for _ in range(40))]
    for text, p in zip(texts, quality.probabilities(texts, weights, bias, quality.WordHashes())):
        _, slot, value = quality.features([text], quality.WordHashes(), 12)
        assert p == pytest.approx(sigmoid(bias + sum(float(weights[s]) * v for s, v in zip(slot.tolist(), value.tolist()))), abs=1e-9)


# 1 mixing

def test_positions_and_order_equal_plain_ones(spark):
    docs = table(spark, SMALL, "documents")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    rows = mixing.curriculum(docs).collect()
    names = sorted({*source.values()}, key=lambda s: (s is None, (s or "").encode()))
    kind = {s: k % len(mixing.SCHEDULES) for k, s in enumerate(names)}
    target = {source[r["doc_id"]]: r["target"] for r in rows}
    demand = Counter()
    for s, t in target.items():
        demand[kind[s]] += t
    grid = np.linspace(0, 1, 200_001)
    shares = [mixing.integral(grid, schedule) for schedule in mixing.SCHEDULES]
    before = Counter()
    for r in sorted(rows, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"])):
        s = source[r["doc_id"]]
        for k, position in enumerate(r["positions"]):
            share = (k * r["source_size"] + before[s]) / r["target"] if r["target"] else 0.0
            time = bisect.bisect_left(shares[kind[s]], share)
            low, high = (sum(demand[j] * shares[j][min(max(time + d, 0), 200_000)] for j in demand) for d in (-2, 2))
            assert math.floor(low) - 1 <= position <= high + 1
        before[s] += r["size"]
    at = defaultdict(list)
    for r in rows:
        for position in r["positions"]:
            at[position].append(r["doc_id"])
    ordered = [r["doc_id"] for r in mixing.training_order(docs).collect()]
    place = 0
    for position in sorted(at):
        assert sorted(ordered[place:place + len(at[position])]) == sorted(at[position])
        place += len(at[position])
    assert place == len(ordered)
