import itertools
import plistlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions.decode import edit_versions, typed_stream_text
from parlance.functions.diff import TASK_BYTES, diff_runs, tasks_for


def blob(text: str, tag: bytes | None = None) -> bytes:
    raw = text.encode()
    n = len(raw)
    if tag is None:
        tag = bytes([n]) if n < 128 else b"\x81" + n.to_bytes(2, "little") if n < 65536 else b"\x82" + n.to_bytes(4, "little")
    return b"streamtyped NSMutableString NSString\x01\x94\x84\x01+" + tag + raw


def test_typed_streams_of_every_length_class():
    for text in ("Hi", "x" * 127, "ü" * 200, "y" * 70000):
        assert typed_stream_text(blob(text)) == text
    assert typed_stream_text(blob("abc", b"\x80\x03")) == "abc"


def test_unusable_streams_are_empty():
    assert [typed_stream_text(b) for b in (None, b"", b"no class", b"NSString without mark", b"NSString+")] == [""] * 5


def plist(parts) -> bytes:
    return plistlib.dumps({"ec": parts}, fmt=plistlib.FMT_BINARY)


def test_history_skips_empty_and_repeated_versions():
    parts = {"0": [{"t": blob("one"), "d": 10.5}, {"t": blob("one")}, {"t": b""}, "junk"], "1": [{"t": "two", "d": 0}]}
    assert edit_versions(plist(parts)) == ([{"text": "one", "ts": 978307210}, {"text": "two", "ts": None}], None)


def test_one_distinct_version_is_no_history():
    assert edit_versions(plist({"0": [{"t": "a"}, {"t": "a"}]})) == ([], None)
    assert edit_versions(b"bplist00\xd0 broken") == ([], None)
    assert edit_versions(None) == ([], None)


def test_misshapen_history_is_reported():
    assert edit_versions(plist({"0": 5})) == ([], "TypeError")


def longest_common(a, b):
    """Length of the longest common subsequence, by trying all subsequences of the shorter list."""
    short, long = sorted((a, b), key=len)

    def within(part):
        rest = iter(long)
        return all(token in rest for token in part)

    return max(n for n in range(len(short) + 1) if any(map(within, itertools.combinations(short, n))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc "), max_size=9), st.lists(st.sampled_from("abc "), max_size=14))
def test_diff_keeps_as_much_as_it_can(a, b):
    runs = diff_runs(a, b)
    assert "".join(r["text"] for r in runs if r["op"] != "ins") == "".join(a)
    assert "".join(r["text"] for r in runs if r["op"] != "del") == "".join(b)
    assert sum(len(r["text"]) for r in runs if r["op"] == "keep") == longest_common(a, b)
    ops = [r["op"] for r in runs]
    assert all(x != y and (x, y) != ("ins", "del") for x, y in zip(ops, ops[1:]))


def test_diff_of_long_texts():
    a = [f"w{k % 97}" for k in range(3000)]
    b = a[:1000] + ["new"] + a[1100:]
    runs = diff_runs(a, b)
    assert "".join(r["text"] for r in runs if r["op"] != "ins") == "".join(a)
    assert "".join(r["text"] for r in runs if r["op"] != "del") == "".join(b)


def plain_runs(a, b):
    """The whole table of common lengths, and the walk through it."""
    most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            most[i][j] = most[i + 1][j + 1] + 1 if a[i] == b[j] else max(most[i + 1][j], most[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("keep", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and most[i + 1][j] >= most[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return [[t for op, t in out if op != side] for side in ("ins", "del")], {op: "".join(t for o, t in out if o == op) for op in ("keep", "del", "ins")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=200), st.lists(st.sampled_from("abcd"), max_size=200))
def test_diff_takes_the_same_steps_as_the_whole_table(a, b):
    runs = diff_runs(a, b)
    _, want = plain_runs(a, b)
    assert {op: "".join(r["text"] for r in runs if r["op"] == op) for op in want} == want


def test_diff_of_very_long_texts_in_little_memory():
    import random
    import tracemalloc

    rng = random.Random(1)
    a = [f"w{rng.randrange(5000)}" for _ in range(20000)]
    b = [w for w in a if rng.random() > 0.1]
    b = [x for w in b for x in ((w, f"n{rng.randrange(900)}") if rng.random() < 0.1 else (w,))]
    tracemalloc.start()
    runs = diff_runs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(r["text"] for r in runs if r["op"] != "ins") == "".join(a)
    assert "".join(r["text"] for r in runs if r["op"] != "del") == "".join(b)
    assert peak < 20_000_000


def test_pairs_are_spread_by_their_bytes(spark):
    # Spark estimates a join by the product of its sides, here some 10 ** 13 bytes.
    side = spark.range(100_000).withColumn("text", F.col("id").cast("string"))
    pairs = side.withColumnRenamed("text", "old").join(side.withColumnRenamed("text", "new"), "id")
    assert tasks_for(pairs, "old", "new") == 4 * spark.sparkContext.defaultParallelism
    long = pairs.filter("id < 8").withColumns({"old": F.repeat(F.lit("x"), 10 * TASK_BYTES), "new": F.lit(None).cast("string")})
    assert tasks_for(long, "old", "new") == max(4 * spark.sparkContext.defaultParallelism, 80)
    assert tasks_for(pairs.filter("id < 0"), "old", "new") == 4 * spark.sparkContext.defaultParallelism
