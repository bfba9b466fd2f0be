import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.ordered import first_per_group, number_rows, previous_row, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", k, rng.randrange(10)) for k in range(2000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(7)


def by_group(rows):
    out = {}
    for g, k, v in sorted(rows):
        out.setdefault(g, []).append((k, v))
    return out


@pytest.mark.parametrize("size", [1, 37, 5000])
def test_running_total_is_exact_for_any_chunk(skewed, size):
    rows, df = skewed
    got = {(r.g, r.k): r.t for r in running_total(df, ["g"], F.floor(F.col("k") / size), ["k"], F.col("v"), "t").collect()}
    want = {}
    for g, items in by_group(rows).items():
        total = 0
        for k, v in items:
            total += v
            want[g, k] = total
    assert got == want


@pytest.mark.parametrize("size", [1, 37, 5000])
def test_previous_row_reaches_across_chunks(skewed, size):
    rows, df = skewed
    found = previous_row(df, ["g"], F.floor(F.col("k") / size), ["k"], ["k", "v"], "p").collect()
    got = {(r.g, r.k): None if r.p is None else (r.p.k, r.p.v) for r in found}
    want = {(g, k): (items[i - 1] if i else None) for g, items in by_group(rows).items() for i, (k, _) in enumerate(items)}
    assert got == want


def test_first_per_group_keeps_exactly_the_first(skewed):
    rows, df = skewed
    got = sorted((r.g, r.k) for r in first_per_group(df, ["g"], [F.desc("k")], 17, "k", salts=5).collect())
    want = sorted((g, k) for g, items in by_group(rows).items() for k, _ in items[-17:])
    assert got == want


def test_limit_is_pushed_below_both_shuffles(skewed):
    _, df = skewed
    plan = first_per_group(df, ["g"], [F.desc("k")], 17, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_numbers_do_not_depend_on_partitioning(spark):
    rows = [(f"key{k}", k % 3) for k in range(500)]
    results = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "key string, day int").repartition(parts)
        out = number_rows(df, F.col("key"), "n", 100, F.col("day")).collect()
        results.append(sorted((r.n, r.key, r.day) for r in out))
    assert results[0] == results[1] == results[2]
    assert [n for n, _, _ in results[0]] == list(range(101, 601))
    assert [d for _, _, d in results[0]] == sorted(d for _, d in rows)
