"""Row sources: constants, sequences, grids, random values and recurrences."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def guess_shape(nested) -> tuple[int, ...]:
    """Lengths of the axes; stops at a level whose parts differ."""
    shape: list[int] = []
    level = [nested]
    while level and all(isinstance(x, list | tuple) for x in level) and len({len(x) for x in level}) == 1:
        shape.append(len(level[0]))
        level = [y for x in level for y in x]
    return tuple(shape)


def flat(nested, depth: int) -> list:
    level = [nested]
    for _ in range(depth):
        level = [y for x in level for y in x]
    return level


def guess_kind(values: list) -> str:
    some = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in some) and some:
        return "boolean"
    if all(isinstance(v, int) for v in some) and some:
        return "int64"
    if all(isinstance(v, int | float) for v in some):
        return "float64"
    return "object"


def parse(text: str, kind: str = "float64") -> list:
    """Values between blanks or commas; a semicolon ends a row, _ is masked."""
    one = {"boolean": lambda x: x not in ("0", "false"), "object": str}.get(kind, float if kind.startswith("float") else int)
    rows = [[None if x == "_" else one(x) for x in re.split(r"[\s,]+", row.strip()) if x] for row in text.strip().strip(";").split(";")]
    return rows[0] if len(rows) == 1 else rows


def parsed(df: DataFrame, text: str, key: str) -> DataFrame:
    """The same for a text column, distributed: key, row, column and value (a double)."""
    rows = df.select(key, F.posexplode(F.split(text, ";")).alias("row", "_r"))
    cells = rows.select(key, "row", F.posexplode(F.filter(F.split("_r", r"[\s,]+"), lambda x: x != "")).alias("column", "_v"))
    return cells.select(key, "row", "column", F.nullif("_v", F.lit("_")).cast("double").alias("v"))


def zeros(spark: SparkSession, *shape: int, kind: str = "float64"):
    return full(spark, shape, 0, kind)


def ones(spark: SparkSession, *shape: int, kind: str = "float64"):
    return full(spark, shape, 1, kind)


def full(spark: SparkSession, shape: tuple[int, ...], value, kind: str | None = None):
    from ..plans.array import NDArray

    return NDArray.generate(spark, tuple(shape), F.lit(value), kind or guess_kind([value]))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, kind: str = "float64"):
    """Ones on the k-th diagonal; a negative k starts at cell m - k - 1 of the flat array and goes on in steps of m + 1."""
    from ..plans.array import NDArray

    m = n if m is None else m
    start = k if k >= 0 else m - k - 1
    addr = F.col("addr")
    return NDArray.generate(spark, (n, m), F.when((addr >= start) & ((addr - start) % (m + 1) == 0), 1).otherwise(0), kind)


def identity(spark: SparkSession, n: int, kind: str = "float64"):
    return eye(spark, n, kind=kind)


def linspace(spark: SparkSession, first: float, last: float, n: int = 100):
    from ..plans.array import NDArray

    return NDArray.generate(spark, (n,), F.lit(float(first)) + F.col("addr") * ((last - first) / (n - 1) if n > 1 else 0.0))


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1, kind: str | None = None):
    """Half-open progression."""
    from ..plans.array import NDArray

    start, stop = (0, start) if stop is None else (start, stop)
    return NDArray.generate(spark, (max(0, ceil((stop - start) / step)),), F.lit(start) + F.col("addr") * step, kind or guess_kind([start, step]))


def span(spark: SparkSession, first: int, last: int, step: int = 1, exclude_end: bool = False, kind: str = "int64"):
    """Inclusive progression; from a larger to a smaller number it counts down."""
    from ..plans.array import NDArray

    n = abs(last - first) // step + 1
    n -= exclude_end and (last - first) % step == 0
    return NDArray.generate(spark, (n,), F.lit(first) + F.col("addr") * (step if last >= first else -step), kind)


def meshgrid(x, y, indexing: str = "xy"):
    """Coordinate grids of two vectors, as a pair of 2-d arrays; with ij the axes are index numbers."""
    n, m = x.elements, y.elements
    a, b = x.df.select(F.col("addr").alias("i"), F.col("v").alias("x")), y.df.select(F.col("addr").alias("j"), F.col("v").alias("y"))
    grid = b.join(F.broadcast(a) if n <= 1 << 16 else a, how="cross")  # the product is the result
    if indexing == "xy":
        at = F.col("j") * n + F.col("i")
        return x.like(grid.select(at.alias("addr"), F.col("x").alias("v")), (m, n)), y.like(grid.select(at.alias("addr"), F.col("y").alias("v")), (m, n))
    at = F.col("i") * m + F.col("j")
    return x.like(grid.select(at.alias("addr"), F.col("i").alias("v")), (n, m), "int64"), y.like(grid.select(at.alias("addr"), F.col("j").alias("v")), (n, m), "int64")


def random(spark: SparkSession, shape: tuple[int, ...], seed: int | None = None):
    from ..plans.array import NDArray

    return NDArray.generate(spark, shape, F.rand(seed))


def randomn(spark: SparkSession, shape: tuple[int, ...], seed: int | None = None):
    from ..plans.array import NDArray

    return NDArray.generate(spark, shape, F.randn(seed))


def pickup(ref: Column, *choices: Column) -> Column:
    """The choice whose number is ref."""
    out = F.when(F.lit(False), choices[0])
    for k, c in enumerate(choices):
        out = out.when(ref == k, c)
    return out


def recurrence(spark: SparkSession, n: int, seeds: list[float], step: str):
    """n values, each from earlier ones: step is SQL on `a`, the array of values so far."""
    first = "array(" + ", ".join(f"cast({s} as double)" for s in seeds) + ")"
    values = F.expr(f"aggregate(sequence(1, {max(0, n - len(seeds))}), {first}, (a, k) -> array_append(a, cast({step} as double)))") if n > len(seeds) else F.expr(first)
    from ..plans.array import NDArray

    df = spark.range(1).select(F.posexplode(values).alias("addr", "v")).where(F.col("addr") < n)
    return NDArray(df.select(F.col("addr").cast("bigint").alias("addr"), "v"), (n,))
