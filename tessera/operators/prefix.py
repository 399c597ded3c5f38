"""Running values over addresses, and ranks, without bringing all rows together.

Running values: addresses are cut into stretches of bounded length. Each stretch is reduced, the totals of the stretches
are accumulated (in the same way, if they are many), and within a stretch a window adds to what came before it. Ranks:
rows are dealt by ranges of all their keys, sorted within, and numbered from the count of earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Cells of a stretch: a share of a small array, and never more than the second number.
LEAST_STRETCH, MOST_STRETCH = 1024, 1 << 18
#: Totals that are accumulated in one window.
MOST_TOTALS = 1 << 16
#: Rows of a range: a share of a small table, and a fixed number of a large one.
LEAST_RANGE, RANGE = 1 << 17, 1 << 18

COMBINE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "prod": (F.product, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def stretch_of(n: int) -> int:
    return min(MOST_STRETCH, max(LEAST_STRETCH, -(-n // 64)))


def ranges_of(n: int) -> int:
    """Ranges that n rows are dealt into."""
    return max(1, min(64, n // LEAST_RANGE), n // RANGE)


def running(df: DataFrame, n: int, columns: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), stretch: int | None = None) -> DataFrame:
    """df with running values: name to (how, what). by: columns whose values are accumulated each for itself. df has addr below n."""
    stretch = stretch or stretch_of(n)
    bucketed = df.withColumn("_b", F.call_function("div", F.col("addr"), F.lit(stretch).cast("bigint")))
    for name, (_, what) in columns.items():
        bucketed = bucketed.withColumn(f"_in_{name}", what)
    within = Window.partitionBy(*by, "_b").orderBy("addr").rowsBetween(Window.unboundedPreceding, 0)
    again = {"count": "sum"}
    pick = lambda how, c, over: COMBINE[how][0](c).over(over)
    totals = bucketed.groupBy(*by, "_b").agg(*[(F.max_by(F.col(f"_in_{k}"), F.when(F.col(f"_in_{k}").isNotNull(), F.col("addr"))) if how == "last" else COMBINE[how][0](f"_in_{k}")).alias(f"_t_{k}") for k, (how, _) in columns.items()])
    if -(-n // stretch) > MOST_TOTALS:
        upto = running(totals.withColumnRenamed("_b", "addr"), -(-n // stretch), {f"_p_{k}": (again.get(how, how), F.col(f"_t_{k}")) for k, (how, _) in columns.items()}, by)
        before = upto.select(*by, (F.col("addr") + 1).alias("_b"), *[f"_p_{k}" for k in columns])
        if by:  # a stretch without rows of this group has no total: what came before it is carried over
            filled = totals.select(*by, "_b").unionByName(before, allowMissingColumns=True).groupBy(*by, "_b").agg(*[F.max(f"_p_{k}").alias(f"_p_{k}") for k in columns])
            before = filled.select(*by, "_b", *[F.last(f"_p_{k}", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b")).alias(f"_p_{k}") for k in columns])
    else:
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*by, "_b", *[pick(again.get(how, how), f"_t_{k}", earlier).alias(f"_p_{k}") for k, (how, _) in columns.items()])
    own = bucketed.select("*", *[pick(how, f"_in_{k}", within).alias(f"_o_{k}") for k, (how, _) in columns.items()])
    named = before.select(*[F.col(c).alias(f"_j_{c}") for c in (*by, "_b")], *[f"_p_{k}" for k in columns])
    joined = own.join(named, [F.col(f"_j_{c}").eqNullSafe(F.col(c)) if c != "_b" else F.col("_j__b") == F.col("_b") for c in (*by, "_b")], "left")
    return joined.select(*df.columns, *[COMBINE[how][1](F.col(f"_p_{k}"), F.col(f"_o_{k}")).alias(k) for k, (how, _) in columns.items()])


def in_ranges(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """df dealt into ranges of the order and sorted, with the number of its range as `_b` and its place there as `_o`.

    It is written to the shared folder: Spark samples the bounds of ranges anew for each plan, so two plans that read the
    ranges from one exchange need not agree on them.
    """
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_b", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")


def ranked(df: DataFrame, keys: list[tuple[str, bool]], n: int, name: str = "rank") -> DataFrame:
    """df with the place from 0 of each row in the order of the keys (column, descending), nulls last; the last key is addr.

    Ranges are of all keys, addr included, so equal values don't meet in one task either.
    """
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
    parts = ranges_of(n)
    if parts < 2:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = in_ranges(df, order, parts)
    counts = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_b").alias("_x"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    return dealt.join(F.broadcast(before), F.col("_b") == F.col("_x")).select(*df.columns, (F.col("_o") + F.col("_p")).alias(name))  # a row for each range
