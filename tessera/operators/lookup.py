"""Lookups: equal, nearest and interpolated places in another array; alignment of shapes."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .prefix import in_ranges, ranges_of

def asof(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...] = (), direction: str = "backward", payload: str = "addr", n: int | None = None, ties: str = "first", strict: bool = False) -> DataFrame:
    """left with `found`: the payload of right's nearest row at or before (after) the key, by union and a running last value.

    Rows are dealt by ranges of the key, and what a range ends with is carried on to the next, so neither an unpartitioned
    key nor a frequent one of `by` meets in one task. n: rows of both; without it they are counted. ties: the payload of
    equal keys that counts, the first (least) or the last. strict: only rows truly before (after) the key.
    """
    forward = direction == "forward"
    n = left.count() + right.count() if n is None else n
    parts = ranges_of(n)
    mine = 0 if forward != strict else 1
    kind = right.schema[payload].dataType
    what = F.col(payload) if isinstance(kind, StructType) else F.col(payload).cast("bigint")
    one = left.withColumn("_side", F.lit(mine)).withColumn("found", F.lit(None).cast(kind if isinstance(kind, StructType) else "bigint"))
    two = right.select(*by, key, what.alias("found"), F.lit(1 - mine).alias("_side"))
    both = one.unionByName(two, allowMissingColumns=True).where(F.col(key).isNotNull())
    tie = F.desc_nulls_last("found") if (ties == "first") else F.asc_nulls_first("found")
    order = [F.desc(key), F.desc("_side"), tie] if forward else [F.asc(key), F.asc("_side"), tie]
    mine_ = F.col("_side") == mine
    if parts < 2:
        within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("found", F.last("found", ignorenulls=True).over(within)).where(mine_).select(*left.columns, "found")
    dealt = in_ranges(both, [*map(F.col, by), *order], parts)
    within = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_own", F.last("found", ignorenulls=True).over(within))
    edge = F.min_by if forward else F.max_by
    tied = F.col("found") if forward == (ties == "first") else -F.col("found")
    ends = dealt.groupBy(*by, "_b").agg(edge("found", F.when(F.col("found").isNotNull(), F.struct(F.col(key), tied))).alias("_e"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_j_{c}") for c in (*by, "_b")], F.last("_e", ignorenulls=True).over(upto).alias("_c"))
    same = [*[F.col(f"_j_{c}").eqNullSafe(F.col(c)) for c in by], F.col("_j__b") == F.col("_b")]
    joined = filled.where(mine_).join(carried if by else F.broadcast(carried), same, "left")  # without `by` a row for each range
    return joined.withColumn("found", F.coalesce("_own", "_c")).select(*left.columns, "found")


def steps_of(scale, lead: int = 0) -> DataFrame:
    """i0.. (of the leading axes), k, low, high: the steps of scales along the last axis."""
    n, by = scale.shape[-1], [f"i{a}" for a in range(lead)]
    own = scale.df.select(*[scale.index_column(a).alias(f"i{a}") for a in range(lead)], (F.col("addr") % n if lead else F.col("addr")).alias("k"), F.col("v").cast("double").alias("low"))
    nexts = own.select(*by, (F.col("k") - 1).alias("k"), F.col("low").alias("high"))
    return own.join(nexts, [*by, "k"])


def located(steps: DataFrame, wanted: DataFrame, n: int, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """wanted (by, x, ...) with place: the fractional place of x among the ascending steps (by, k, low, high) of scales of n values, extrapolated outside."""
    low = F.when(F.col("k") == 0, float("-inf")).otherwise(F.col("low"))
    right = steps.select(*by, low.alias("x"), F.struct("k", "low", "high").alias("step"))
    found = asof(wanted.where(F.col("x").isNotNull()), right, "x", by, payload="step", n=rows, ties="last")
    place = F.col("found.k") + (F.col("x") - F.col("found.low")) / (F.col("found.high") - F.col("found.low"))
    place = F.when(F.abs(place - F.rint(place)) < 100 * 2.0**-52, F.rint(place)).otherwise(place)
    return found.select(*wanted.columns, place.alias("place"))


#: Parts of a scale's range for scales that don't ascend.
BUCKETS = 1024


class Lookup:
    """Methods of NDArray."""

    def matchup(self, ref):
        """The first place in ref of each value; masked if there is none. ref is reduced to one row for each value first."""
        places = ref.df.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("addr").alias("k"))
        return self.like(self.df.select("addr", "v").join(places, "v", "left").select("addr", F.col("k").alias("v")), kind="int64")

    bsearch = matchup

    def matchup_nearest(self, ref, direction: str = "round"):
        """The place in an ascending ref before (floor), after (ceil) or nearest to (round) each value, kept within 0..size."""
        x = ref.section(self)
        f = {"round": F.round, "floor": F.floor, "ceil": F.ceil}[direction]
        place = F.greatest(F.least(f(F.col("v")).cast("bigint"), F.lit(self.elements)), F.lit(0).cast("bigint"))
        return x.with_value(F.when(F.col("v").isNotNull(), place), "int64")

    def search(self, value, eps: float | None = None) -> DataFrame:
        """The first address equal to the value, or within eps."""
        hit = F.col("v") == F.lit(value) if eps is None and not isinstance(value, float) else F.abs(F.col("v") - value) <= (abs(value) * 2.0**-52 if eps is None else eps)
        return self.df.where(hit).agg(F.min("addr").alias("v"))

    def search_nearest(self, value: float) -> DataFrame:
        """The first address of the least distance."""
        return self.df.where(F.col("v").isNotNull()).agg(F.min(F.struct(F.abs(F.col("v") - value).alias("d"), "addr"))["addr"].alias("v"))

    def section(self, x):
        """Fractional place of each x in this ascending scale, extrapolated outside: an as-of join with the scale's steps. An integer scale cuts the fraction off."""
        wanted = x.df.select("addr", F.col("v").cast("double").alias("x"))
        found = located(steps_of(self), wanted, self.elements, (), x.elements + self.elements)
        out = x.df.select("addr").join(found.select("addr", self._whole(F.col("place")).alias("v")), "addr", "left")
        return x.like(out, kind="float64")

    def _whole(self, place: Column) -> Column:
        return place if self.kind.startswith("float") else F.when(place >= 0, F.floor(place)).otherwise(F.ceil(place)).cast("double")

    def _series(self) -> tuple[int, tuple[str, ...], int]:
        """Leading axes, their index columns, and the number of series."""
        if self.ndim < 2:
            raise ValueError("an axis of series and one of values")
        return self.ndim - 1, tuple(f"i{a}" for a in range(self.ndim - 1)), prod(self.shape[:-1])

    def _series_place(self, by: tuple[str, ...]) -> Column:
        return self.address_of([F.col(c) for c in by], self.shape[:-1])

    def _for_each_series(self, x, locate) -> object:
        """Places of one list x in every scale along the last axis: the axes of the series and then those of x."""
        lead, by, series = self._series()
        each = self.like(self.spark.range(series).select(F.col("id").alias("addr")), self.shape[:-1]).indexed().select(*by)
        wanted = each.join(x.df.select("addr", F.col("v").cast("double").alias("x")), how="cross")  # the result has a cell for each pair
        found = locate(steps_of(self, lead), wanted, by).select(*by, "addr", "place")
        whole = wanted.select(*by, "addr").join(found, [*by, "addr"], "left")
        at = self._series_place(by) * x.elements + F.col("addr")
        return self.like(whole.select(at.alias("addr"), self._whole(F.col("place")).alias("v")), (*self.shape[:-1], *x.shape), "float64")

    def vectorized_section(self, x):
        """section of one list x in each of the scales along the last axis."""
        rows = self.elements + prod(self.shape[:-1]) * x.elements
        return self._for_each_series(x, lambda steps, wanted, by: located(steps, wanted, self.shape[-1], by, rows))

    def vectorized_section_linear(self, x):
        """section_linear of one list x in each of the scales along the last axis; -1 where no step holds it."""

        def locate(steps: DataFrame, wanted: DataFrame, by: tuple[str, ...]) -> DataFrame:
            place = F.col("k") + F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
            hits = wanted.join(steps, list(by)).where(F.col("x").between(F.least("low", "high"), F.greatest("low", "high")))
            first = hits.groupBy(*by, "addr").agg(F.min(F.struct("k", place.alias("p")))["p"].alias("place"))
            return wanted.where(F.col("x").isNotNull()).join(first, [*by, "addr"], "left").withColumn("place", F.coalesce("place", F.lit(-1.0)))

        return self._for_each_series(x, locate)

    def vectorized_find_linear_addr(self, x):
        """section of each series' own list, along the last axis of x."""
        lead, by, series = self._series()
        if x.shape[:lead] != self.shape[:-1]:
            raise ValueError("x has other series")
        wanted = x.indexed().select(*by, "addr", F.col("v").cast("double").alias("x"))
        found = located(steps_of(self, lead), wanted, self.shape[-1], by, self.elements + x.elements)
        return x.like(x.df.select("addr").join(found.select("addr", self._whole(F.col("place")).alias("v")), "addr", "left"), kind="float64")

    def vectorized_fetch_linear_addr(self, at):
        """Values at fractional places of each series, along the last axis of `at`; outside masked."""
        lead, by, series = self._series()
        if at.shape[:lead] != self.shape[:-1]:
            raise ValueError("the places have other series")
        n = self.shape[-1]
        wanted = at.indexed().select("addr", F.col("v").cast("double").alias("x"), self._series_place(by).alias("s")).where(F.col("x").between(0, n - 1))
        wanted = wanted.select("addr", "x", (F.col("s") * n + F.floor("x")).alias("k0"), (F.col("s") * n + F.ceil("x")).alias("k1"))
        own = self.df.select("addr", F.col("v").cast("double").alias("v"))
        found = wanted.join(own.toDF("k0", "y0"), "k0").join(own.toDF("k1", "y1"), "k1")
        t = F.col("x") - F.floor("x")
        values = found.select("addr", (F.col("y0") * (1 - t) + F.col("y1") * t).alias("v"))
        return at.like(at.df.select("addr").join(values, "addr", "left"), kind="float64")

    def section_linear(self, x):
        """For scales that don't ascend: the place in the first step that holds x; -1 if none does."""
        steps = steps_of(self).select("k", "low", "high", F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b"))
        low, high = self.df.agg(F.min("v"), F.max("v")).first()
        width = (float(high) - float(low)) / BUCKETS or 1.0
        part = lambda c: F.least(F.greatest(F.floor((c - float(low)) / width), F.lit(0)), F.lit(BUCKETS - 1))
        sent = steps.select("*", F.explode(F.sequence(part(F.col("a")), part(F.col("b")))).alias("p"))
        wanted = x.df.where(F.col("v").isNotNull()).select("addr", F.col("v").cast("double").alias("x")).withColumn("p", part(F.col("x")))
        place = F.col("k") + F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
        found = wanted.join(sent, "p").where(F.col("x").between(F.col("a"), F.col("b"))).groupBy("addr").agg(F.min(F.struct("k", place.alias("v")))["v"].alias("w"))
        out = x.df.select("addr", "v").join(found, "addr", "left")
        return x.like(out.select("addr", F.when(F.col("v").isNotNull(), F.coalesce("w", F.lit(-1.0))).alias("v")), kind="float64")

    def broadcast_to(self, *shape: int):
        """Axes of length 1 stretch; axes in front are new. Each cell is repeated along them."""
        own = (1,) * (len(shape) - self.ndim) + self.shape
        if len(own) != len(shape) or any(a not in (1, b) for a, b in zip(own, shape, strict=True)):
            raise ValueError(f"{self.shape} doesn't stretch to {shape}")
        df = self.like(self.df, own).indexed()
        for k, (a, b) in enumerate(zip(own, shape, strict=True)):
            if a == 1 and b > 1:
                df = df.drop(f"i{k}").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(b - 1).cast("bigint"))).alias(f"i{k}"))
        return self.like(df.select(self.address_of([F.col(f"i{k}") for k in range(len(shape))], shape).alias("addr"), "v"), shape)


def broadcast(*arrays):
    """Arrays stretched to their common shape."""
    rank = max(a.ndim for a in arrays)
    shapes = [(1,) * (rank - a.ndim) + a.shape for a in arrays]
    common = tuple(max(s[k] for s in shapes) for k in range(rank))
    return [a.broadcast_to(*common) for a in arrays]
