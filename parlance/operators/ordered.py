"""Ordered work that stays spread out when one group holds a large share of all rows.

A plain window puts a whole group into one task. Here each group is cut into chunks along its order,
the window runs per chunk, and one small row per chunk carries the state across the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_SALTS = 64


def running_total(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column,
                  name: str) -> DataFrame:
    """Add the running sum of ``value`` per group; ``chunk`` must not decrease along the order."""
    cut = df.withColumn("_chunk", chunk)
    sums = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.sum(value).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_chunk", "_before", "_inside")
    )


def previous_row(df: DataFrame, keys: list[str], chunk: Column, order: list[str], fields: list[str],
                 name: str) -> DataFrame:
    """Add a struct of ``fields`` from the row before, NULL on the first row of a group."""
    cut = df.withColumn("_chunk", chunk)
    row = F.struct(*fields)
    last = cut.groupBy(*keys, "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = last.select(*keys, "_chunk", F.lag("_last").over(along).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_inside", F.lag(row).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_chunk", "_carry", "_inside")
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, spread_by: str,
                    salts: int = TOP_SALTS) -> DataFrame:
    """The first ``n`` rows of every group, whole and exact.

    Each (group, salt) keeps its own first ``n``, so a task sees a slice of a large group; the second
    round ranks at most ``salts * n`` rows per group. Spark limits both ranks before their shuffles.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def number_rows(df: DataFrame, key: Column, name: str, start: Column | int = 0,
                before: Column | None = None) -> DataFrame:
    """Add consecutive numbers ``start + 1 ...`` over distinct keys, the same for any partitioning.

    The order is ``before`` (a coarse value such as a day) and then the key's MD5. Rows are counted per
    (before, first hash digits). Counts are added up within each ``before``; only one total per ``before``
    passes through one task.
    """
    marked = (
        df.withColumn("_before", F.lit(0) if before is None else before)
        .withColumn("_md5", F.md5(key.cast("binary")))
        .withColumn("_bucket", F.substring("_md5", 1, 3))
    )
    counts = marked.groupBy("_before", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("_before").agg(F.sum("_n").alias("_n"))
    days = Window.orderBy("_before").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_before", F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_start"))
    along = Window.partitionBy("_before").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("_before", "_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_within"))
    offsets = within.join(starts, "_before").select("_before", "_bucket", (F.col("_start") + F.col("_within")).alias("_offset"))
    inside = Window.partitionBy("_before", "_bucket").orderBy("_md5")
    base = F.lit(start) if isinstance(start, int) else start
    return (
        marked.withColumn("_at", F.row_number().over(inside))
        .join(offsets, ["_before", "_bucket"])
        .withColumn(name, (base + F.col("_offset") + F.col("_at")).cast("bigint"))
        .drop("_before", "_md5", "_bucket", "_offset", "_at")
    )
