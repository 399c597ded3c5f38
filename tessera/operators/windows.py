"""Cumulative values, shifts, rolls and moving windows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running, stretch_of
from .stats import aggregates


def bounded(index: Column, n: int, mode: str) -> Column:
    """Where an index outside 0..n-1 takes its value from; NULL where a fill stands."""
    if mode == "periodic":
        return F.pmod(index, F.lit(n))
    if mode == "nearest":
        return F.greatest(F.least(index, F.lit(n - 1)), F.lit(0))
    if mode == "reflect":
        k = F.pmod(index, F.lit(2 * n))
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    if mode == "ruby":
        return F.when(index.between(-n, n - 1), F.when(index < 0, index + n).otherwise(index))
    if mode == "strict":
        return F.when(index.between(0, n - 1), index).otherwise(F.raise_error(F.lit("window exceeds the array")).cast("bigint"))
    if mode in ("fill", "mask"):
        return F.when(index.between(0, n - 1), index)
    raise ValueError(f"unknown bounds {mode}")


def _real() -> Column:
    return F.when(~F.isnan(F.col("v").cast("double")), F.col("v"))


#: Statistics that can be framed; the others gather their windows.
FRAMED = {
    "sum": lambda w: F.sum(F.col("v").cast("double")).over(w),
    "mean": lambda w: F.avg(F.col("v").cast("double")).over(w),
    "count_valid": lambda w: F.nullif(F.count("v").over(w), F.lit(0)),
    "variancep": lambda w: F.var_pop(F.col("v").cast("double")).over(w),
    "stddevp": lambda w: F.stddev_pop(F.col("v").cast("double")).over(w),
    "min": lambda w: F.coalesce(F.min(_real()).over(w), F.min("v").over(w)),
    "max": lambda w: F.coalesce(F.max(_real()).over(w), F.max("v").over(w)),
}


class Windows:
    """Methods of NDArray."""

    def _run(self, how: str, value: Column, out, min_count: int, fill, kind: str = "float64", lead: int = 0):
        by = tuple(f"i{k}" for k in range(lead))
        df = self.indexed() if lead else self.df
        done = running(df.select("addr", "v", *by), self.elements, {"x": (how, value), "c": ("count", F.col("v"))}, by)
        v = out(F.col("x"))
        if min_count:
            v = F.when(F.col("c") < min_count, F.lit(fill)).otherwise(v)
        return self.like(done.select("addr", v.alias("v")), kind=kind)

    def cumsum(self, min_count: int = 0, fill=None, lead: int = 0):
        return self._run("sum", F.col("v").cast("double"), lambda x: F.coalesce(x, F.lit(0.0)), min_count, fill, lead=lead)

    def cumcount(self, min_count: int = 0, fill=None, lead: int = 0):
        return self._run("count", F.col("v"), lambda x: x, min_count, fill, "int64", lead)

    def cumprod(self, min_count: int = 0, fill=None):
        return self._run("prod", F.col("v").cast("double"), lambda x: F.coalesce(x, F.lit(1.0)), min_count, fill)

    def _extreme(self, how: str, min_count: int, fill):
        """Cells before the first valid one take its value."""
        first = F.broadcast(self.df.agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("addr"))).alias("f")))
        done = running(self.df.select("addr", "v"), self.elements, {"x": (how, F.col("v")), "c": ("count", F.col("v"))}).join(first, how="cross")
        v = F.coalesce("x", "f")
        if min_count:
            v = F.when(F.col("c") < min_count, F.lit(fill)).otherwise(v)
        return self.like(done.select("addr", v.alias("v")))

    def cummin(self, min_count: int = 0, fill=None):
        return self._extreme("min", min_count, fill)

    def cummax(self, min_count: int = 0, fill=None):
        return self._extreme("max", min_count, fill)

    def cumwsum(self, weights, min_count: int = 0, fill=None):
        both = self.df.select("addr", "v").join(weights.df.select("addr", F.col("v").alias("w")), "addr")
        return self.like(both.select("addr", (F.col("v") * F.col("w")).cast("double").alias("v")), kind="float64").cumsum(min_count, fill)

    def dimcumsum(self, ndim: int, min_count: int = 0, fill=None):
        """Running sum within each index of the leading axes."""
        return self.cumsum(min_count, fill, lead=ndim)

    def dimcumcount(self, ndim: int, min_count: int = 0, fill=None):
        return self.cumcount(min_count, fill, lead=ndim)

    def shifted(self, *by: int, roll: bool | tuple[bool, ...] = False, fill_value=0):
        """Moves along each axis; cells that nothing moves to get the fill (None masks), or with roll what left at the end."""
        rolls = roll if isinstance(roll, tuple) else (roll,) * self.ndim
        df, ok, columns = self.indexed(), F.lit(True), []
        for k, n in enumerate(by):
            to = F.col(f"i{k}") + n
            if rolls[k]:
                to = F.pmod(to, F.lit(self.shape[k]))
            else:
                ok = ok & to.between(0, self.shape[k] - 1)
            columns.append(to)
        columns += [F.col(f"i{k}") for k in range(len(by), self.ndim)]
        moved = df.where(ok).select(self.address_of(columns).alias("addr"), F.col("v").alias("w"), F.lit(True).alias("hit"))
        v = F.when(F.col("hit"), F.col("w")).otherwise(F.lit(fill_value).cast(self.df.schema["v"].dataType))
        return self.like(self.df.select("addr").join(moved, "addr", "left").select("addr", v.alias("v")))

    def shift(self, *by: int, fill_value=0):
        return self.shifted(*by, fill_value=fill_value)

    def roll(self, *by: int):
        return self.shifted(*by, roll=True)

    rolled = rotate = rotated = roll

    def diff(self):
        """Each value less the one before; the first cell less 0."""
        return self.zip_with(self.shifted(1), lambda a, b: a - b, self.kind)

    def window(self, *ranges: tuple[int, int], bounds: str = "fill", fill_value=0):
        """A rectangle (inclusive ranges) that may exceed the array."""
        shape = tuple(b - a + 1 for a, b in ranges)
        n = 1
        for s in shape:
            n *= s
        cells = self.like(self.spark.range(n).select(F.col("id").alias("addr")), shape).indexed()
        at = [bounded(F.col(f"i{k}") + a, self.shape[k], bounds) for k, (a, _) in enumerate(ranges)]
        source = cells.select("addr", self.address_of(at).alias("s"))
        found = source.join(self.df.select(F.col("addr").alias("s"), "v"), "s", "left")
        outside = F.lit(None if bounds == "mask" else fill_value).cast(self.df.schema["v"].dataType)
        return self.like(found.select("addr", F.when(F.col("s").isNull(), outside).otherwise(F.col("v")).alias("v")), shape)

    def moving(self, *ranges: tuple[int, int], bounds: str = "fill", fill_value=0) -> DataFrame:
        """center, place (in the window) and v: the windows around all cells. Each cell is sent to its windows by equi-join."""
        offsets = list(product(*[range(a, b + 1) for a, b in ranges]))
        listed = F.array(*[F.struct(F.lit(p).alias("p"), *[F.lit(o).alias(f"d{k}") for k, o in enumerate(off)]) for p, off in enumerate(offsets)])
        cells = self.indexed().select(F.col("addr").alias("center"), *[f"i{k}" for k in range(self.ndim)], F.explode(listed).alias("o"))
        at = [bounded(F.col(f"i{k}") + F.col(f"o.d{k}"), self.shape[k], bounds) for k in range(self.ndim)]
        source = cells.select("center", F.col("o.p").alias("place"), self.address_of(at).alias("s"))
        found = source.join(self.df.select(F.col("addr").alias("s"), "v"), "s", "left")
        outside = F.lit(None if bounds == "mask" else fill_value).cast(self.df.schema["v"].dataType)
        return found.select("center", "place", F.when(F.col("s").isNull(), outside).otherwise(F.col("v")).alias("v"))

    def windows(self, name: str, *ranges: tuple[int, int], bounds: str = "fill", fill_value=0):
        """A statistic of the window around each cell. Of a vector it is a frame over stretches that overlap by the window."""
        if self.ndim == 1 and name in FRAMED:
            return self._framed(FRAMED[name], *ranges[0], bounds, fill_value)
        moved = self.moving(*ranges, bounds=bounds, fill_value=fill_value).withColumnRenamed("place", "addr")
        out = moved.groupBy("center").agg(aggregates(self.kind)[name].alias("v"))
        return self.like(out.select(F.col("center").alias("addr"), "v"), kind="float64")

    def _framed(self, framed, first: int, last: int, bounds: str, fill_value):
        """A statistic over the cells from first to last around each cell of a vector. Cells beyond the ends are few and made for themselves."""
        n, kind = self.elements, self.df.schema["v"].dataType
        low, high = min(first, 0), max(last, 0)
        stretch = max(stretch_of(n), 8 * (high - low))
        beyond = self.spark.range(high - low).select(F.when(F.col("id") < -low, F.col("id") + low).otherwise(F.col("id") + low + n).alias("addr"))
        beyond = beyond.withColumn("s", bounded(F.col("addr"), n, bounds)).join(self.df.select(F.col("addr").alias("s"), "v"), "s", "left")
        outside = F.when(F.col("s").isNull(), F.lit(None if bounds == "mask" else fill_value).cast(kind)).otherwise(F.col("v"))
        cells = self.df.select("addr", "v").union(beyond.select("addr", outside))
        block = lambda c: F.floor(c / stretch).cast("bigint")
        sent = cells.withColumn("b", F.explode(F.sequence(block(F.col("addr") - high), block(F.col("addr") - low))))
        frame = Window.partitionBy("b").orderBy("addr").rowsBetween(first, last)
        own = sent.select("addr", "b", framed(frame).alias("v")).where((F.col("b") == block(F.col("addr"))) & F.col("addr").between(0, n - 1))
        return self.like(own.select("addr", "v"), kind="float64")

    def convolve(self, weights: list[float], first: int, bounds: str = "fill", fill_value=0):
        """Weighted sums of moving windows of a vector that begin `first` cells from the centre."""
        moved = self.moving((first, first + len(weights) - 1), bounds=bounds, fill_value=fill_value)
        w = F.get(F.array(*map(F.lit, weights)), F.col("place"))
        out = moved.groupBy("center").agg(F.sum(F.col("v") * w).alias("v"))
        return self.like(out.select(F.col("center").alias("addr"), "v"), kind="float64")
