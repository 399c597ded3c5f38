"""Reductions over all cells or along axes, with limits on masked cells.

A reduction along axes groups by the index columns that stay; the whole array is one group. All sums are of doubles.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.types import SPARK, wrap
from .prefix import ranges_of, ranked

V = F.col


def _n() -> Column:
    return F.count("v")


def _double() -> Column:
    return F.col("v").cast("double")


def extreme(name: str, column: str = "v") -> Column:
    """Minimum or maximum that skips NaN unless nothing else is there."""
    v = F.col(column)
    real = F.when(~F.isnan(v.cast("double")), v)
    f = F.min if name == "min" else F.max
    return F.coalesce(f(real), f(v))


def extreme_addr(name: str) -> Column:
    """Address of the first extreme."""
    v = F.when(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")), F.col("v"))
    if name == "min":
        return F.min(F.when(v.isNotNull(), F.struct(v.alias("x"), F.col("addr").alias("n"))))["n"]
    return -F.max(F.when(v.isNotNull(), F.struct(v.alias("x"), (-F.col("addr")).alias("n"))))["n"]


def sample(f, lone: Column):
    """A sample statistic of one value is NaN."""
    return F.when(lone == 1, S.NAN).otherwise(f)


def aggregates(kind: str) -> dict[str, Column]:
    """Aggregates by name, over v and addr."""
    return {
        "sum": F.sum(_double()),
        "prod": F.product(_double()),
        "mean": F.avg(_double()),
        "count_valid": F.nullif(_n(), F.lit(0)),
        "min": extreme("min"),
        "max": extreme("max"),
        "min_addr": extreme_addr("min"),
        "max_addr": extreme_addr("max"),
        "variance": sample(F.var_samp(_double()), _n()),
        "variancep": F.var_pop(_double()),
        "stddev": sample(F.stddev_samp(_double()), _n()),
        "stddevp": F.stddev_pop(_double()),
        "median": F.median(_double()),
        "accumulate": wrap(F.sum(F.col("v").cast("decimal(20,0)")), kind) if kind in ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64") else F.sum("v"),
    }


RESULT = {"count_valid": "int64", "min_addr": "int64", "max_addr": "int64"}


class Stats:
    """Methods of NDArray."""

    def reduced(self, axes: tuple[int, ...], agg: Column, kind: str, mask_limit: int = 0, min_count: int = 0, fill_value=None, df: DataFrame | None = None):
        """The array of an aggregate over the axes (all without any): fill_value where mask_limit cells or more are masked, or under min_count are valid."""
        if mask_limit and min_count:
            raise ValueError("mask_limit and min_count exclude each other")
        df = self.indexed() if df is None else df
        over = self.axes(axes) if axes else list(range(self.ndim))
        kept = [k for k in range(self.ndim) if k not in over]
        if fill_value is None:
            agg = agg.cast(SPARK[kind])
        if mask_limit:
            agg = F.when(F.count_if(F.col("v").isNull()) >= mask_limit, F.lit(fill_value)).otherwise(agg)
        if min_count:
            agg = F.when(F.count("v") < min_count, F.lit(fill_value)).otherwise(agg)
        if fill_value is not None:
            agg = F.coalesce(agg, F.lit(fill_value)).cast(SPARK[kind]) if not (mask_limit or min_count) else agg.cast(SPARK[kind])
        shape = tuple(self._shape[k] for k in kept)
        if not kept:
            return self.like(df.agg(agg.alias("v")).select(F.lit(0).cast("bigint").alias("addr"), "v"), (), kind)
        grouped = df.groupBy(*[f"i{k}" for k in kept]).agg(agg.alias("v"))
        addr = F.lit(0).cast("bigint")
        for n, k in enumerate(kept):
            addr = addr * (shape[n] if n else 1) + F.col(f"i{k}")
        return self.like(grouped.select(addr.alias("addr"), "v"), shape, kind)

    def stat(self, name: str, *axes: int, mask_limit: int = 0, min_count: int = 0, fill_value=None):
        kind = RESULT.get(name) or (self.kind if name in ("min", "max", "accumulate") else "float64")
        df = self.indexed()
        if name in ("min_addr", "max_addr") and axes:  # the address within the reduced axes
            over = self.axes(axes)
            place = F.lit(0).cast("bigint")
            for k in over:
                place = place * (self._shape[k] if k else 1) + F.col(f"i{k}")
            df = df.withColumn("addr", place)
        return self.reduced(axes, aggregates(self.kind)[name], kind, mask_limit, min_count, fill_value, df)

    def sum(self, *axes, **limits):
        return self.stat("sum", *axes, **limits)

    def prod(self, *axes, **limits):
        return self.stat("prod", *axes, **limits)

    def mean(self, *axes, **limits):
        return self.stat("mean", *axes, **limits)

    def accumulate(self, *axes, **limits):
        return self.stat("accumulate", *axes, **limits)

    def count_valid(self, *axes, **limits):
        return self.stat("count_valid", *axes, **limits)

    def min(self, *axes, **limits):
        return self.stat("min", *axes, **limits)

    def max(self, *axes, **limits):
        return self.stat("max", *axes, **limits)

    def min_addr(self, *axes, **limits):
        return self.stat("min_addr", *axes, **limits)

    def max_addr(self, *axes, **limits):
        return self.stat("max_addr", *axes, **limits)

    def variance(self, *axes, **limits):
        return self.stat("variance", *axes, **limits)

    def variancep(self, *axes, **limits):
        return self.stat("variancep", *axes, **limits)

    def stddev(self, *axes, **limits):
        return self.stat("stddev", *axes, **limits)

    def stddevp(self, *axes, **limits):
        return self.stat("stddevp", *axes, **limits)

    def median(self, **limits):
        return self.stat("median", **limits)

    def percentile(self, *percents: float, mask_limit: int = 0, fill_value=None):
        """Exact, with linear interpolation, of the whole array; NaN outside 0..100. One value for each percent. Of a large array it takes the values at the ranks wanted."""
        if ranges_of(self.elements) > 1:
            return self._percentile_by_ranks(percents, mask_limit, fill_value)
        inside = [p for p in percents if 0 <= p <= 100]
        exact = F.percentile(F.col("v").cast("double"), F.array(*[F.lit(p / 100) for p in inside])) if inside else None
        items, k = [], 0
        for p in percents:
            items.append(F.get(F.col("p"), F.lit(k)) if 0 <= p <= 100 else F.lit(S.NAN))
            k += 0 <= p <= 100
        row = self.df.agg((exact if inside else F.array()).alias("p"), F.count_if(F.col("v").isNull()).alias("m"))
        out = row.select("m", F.posexplode(F.array(*items)).alias("addr", "v"))
        v = F.when(F.col("m") >= mask_limit, F.lit(fill_value)).otherwise(F.col("v")) if mask_limit else F.col("v")
        return self.like(out.select(F.col("addr").cast("bigint").alias("addr"), v.alias("v")), (len(percents),), "float64")

    def _percentile_by_ranks(self, percents: tuple[float, ...], mask_limit: int, fill_value):
        """Only the values at two ranks for each percent meet, and no aggregate holds the distinct values."""
        valid = self.df.where(F.col("v").isNotNull()).select("addr", F.col("v").cast("double").alias("v"))
        n = valid.count()
        wanted = []
        for k, p in enumerate(percents):
            place = (n - 1) * p / 100 if n and 0 <= p <= 100 else None
            wanted.append((k, None if place is None else int(place), None if place is None else min(int(place) + 1, n - 1), place))
        asked = F.broadcast(self.spark.createDataFrame(wanted, "addr bigint, lo bigint, hi bigint, place double"))  # a row for each percent
        at = ranked(valid, [("v", False), ("addr", False)], n).where(F.col("rank").isin([x for r in wanted for x in r[1:3] if x is not None])).select("rank", "v")
        both = asked.join(at.toDF("lo", "a"), "lo", "left").join(at.toDF("hi", "b"), "hi", "left")
        value = F.when(F.col("place").isNull(), F.lit(S.NAN) if n else F.lit(None)).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("lo")))
        if mask_limit and self.elements - n >= mask_limit:
            value = F.lit(fill_value).cast("double")
        return self.like(both.select("addr", value.alias("v")), (len(percents),), "float64")

    def quantile(self):
        return self.percentile(0, 25, 50, 75, 100)

    def range(self):
        return self.df.agg(F.struct(extreme("min").alias("min"), extreme("max").alias("max")).alias("v"))

    # counts

    def _counted(self, condition: Column, axes, limits):
        return self.reduced(axes, F.count_if(F.coalesce(condition, F.lit(False))), "int64", **limits)

    def count_masked(self, *axes):
        return self._counted(F.col("v").isNull(), axes, {})

    def count_not_masked(self, *axes):
        return self._counted(F.col("v").isNotNull(), axes, {})

    def count_true(self, *axes, **limits):
        return self._counted(F.col("v"), axes, limits)

    def count_false(self, *axes, **limits):
        return self._counted(~F.col("v"), axes, limits)

    def count_equal(self, value, *axes, **limits):
        return self._counted(F.col("v") == F.lit(value), axes, limits)

    count = count_equal

    def count_equiv(self, value, rtol, *axes, **limits):
        return self._counted(S.is_equiv(F.col("v"), value, rtol), axes, limits)

    def count_close(self, value, atol, *axes, **limits):
        return self._counted(S.is_close(F.col("v"), value, atol), axes, limits)

    # tests of the whole array

    def _every(self, condition: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("v"))

    def _some(self, condition: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("v"))

    def all_equal(self, value):
        return self._every(F.col("v") == F.lit(value))

    def all_equiv(self, value, rtol):
        return self._every(S.is_equiv(F.col("v"), value, rtol))

    def all_close(self, value, atol):
        return self._every(S.is_close(F.col("v"), value, atol))

    def any_equal(self, value):
        return self._some(F.col("v") == F.lit(value))

    def any_equiv(self, value, rtol):
        return self._some(S.is_equiv(F.col("v"), value, rtol))

    def any_close(self, value, atol):
        return self._some(S.is_close(F.col("v"), value, atol))

    def none_equal(self, value):
        return self.any_equal(value).select((~F.col("v")).alias("v"))

    def none_equiv(self, value, rtol):
        return self.any_equiv(value, rtol).select((~F.col("v")).alias("v"))

    def none_close(self, value, atol):
        return self.any_close(value, atol).select((~F.col("v")).alias("v"))

    def equals(self, other) -> DataFrame:
        """Whether masks are equal, and values where neither is masked."""
        both = self.df.select("addr", "v", F.lit(1).alias("a")).join(other.df.select("addr", F.col("v").alias("w"), F.lit(1).alias("b")), "addr", "full")
        same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("v").eqNullSafe(F.col("w"))
        return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("v"))

    def content_hash(self) -> DataFrame:
        """A hash of cells that doesn't depend on how rows are distributed."""
        return self.df.agg(F.sum(F.xxhash64("addr", "v").cast("decimal(38,0)")).alias("v"))

    # two arrays

    def _with(self, *others) -> DataFrame:
        df = self.df.select("addr", F.col("v").cast("double").alias("v"))
        for k, o in enumerate(others):
            df = df.join(o.df.select("addr", F.col("v").cast("double").alias(f"w{k or ''}")), "addr")
        return df

    def _pair(self, other, agg: Column, min_count: int = 0, fill=None) -> DataFrame:
        out = F.when(F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()) < min_count, F.lit(fill)).otherwise(agg) if min_count else agg
        return self._with(other).agg(out.alias("v"))

    def wsum(self, weights, min_count: int = 0, fill=None):
        return self._pair(weights, F.sum(F.col("v") * F.col("w")), min_count, fill)

    mul_add = wsum

    def wmean(self, weights, min_count: int = 0, fill=None):
        return self._pair(weights, F.sum(F.col("v") * F.col("w")) / F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), min_count, fill)

    def covariance(self, other, min_count: int = 0, fill=None):
        return self._pair(other, F.covar_samp("v", "w"), min_count, fill)

    def covariancep(self, other, min_count: int = 0, fill=None):
        return self._pair(other, F.covar_pop("v", "w"), min_count, fill)

    def correlation(self, other, min_count: int = 0, fill=None):
        return self._pair(other, F.corr("v", "w"), min_count, fill)

    def anomaly(self, *axes):
        """Values less the mean of their group: the means are few and joined back."""
        if not axes:
            mean = self.df.agg(F.avg(_double()).alias("m"))
            return self.like(self.df.join(F.broadcast(mean), how="cross").select("addr", (_double() - F.col("m")).alias("v")), kind="float64")
        kept = [f"i{k}" for k in range(self.ndim) if k not in self.axes(axes)]
        df = self.indexed()
        means = df.groupBy(*kept).agg(F.avg(_double()).alias("m"))
        return self.like(df.join(means, kept).select("addr", (_double() - F.col("m")).alias("v")), kind="float64")

    anom = anomaly

    def join(self, *separators: str) -> DataFrame:
        """All elements as one text; of two separators the second stands between rows."""
        if len(separators) == 2:
            rows = self.indexed().groupBy("i0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("addr", F.col("v").cast("string").alias("s")))), lambda x: x["s"]), separators[0]).alias("s"))
            return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i0", "s"))), lambda x: x["s"]), separators[1]).alias("v"))
        listed = F.array_sort(F.collect_list(F.struct("addr", F.col("v").cast("string").alias("s"))))
        return self.df.agg(F.array_join(F.transform(listed, lambda x: x["s"]), separators[0] if separators else "").alias("v"))

    def cells(self) -> int:
        return prod(self.shape)
