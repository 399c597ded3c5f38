"""Groups: by value, by axis, by tile, by bin; histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ranked
from .stats import aggregates


#: Edges up to which a scale is searched by comparisons in generated code.
BRANCHES = 256


def step_of(value: Column, edges: list[float]) -> Column:
    """Number of edges of a short ascending scale that are at or below the value: binary search as nested comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(float(edges[middle])), search(low, middle)).otherwise(search(middle + 1, high))

    if len(edges) <= BRANCHES:
        return search(0, len(edges))
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def section_of(value: Column, edges: list[float]) -> Column:
    """Fractional place of a value in a short ascending scale, extrapolated outside; snapped to whole numbers within 100 eps."""
    n = len(edges)
    even = edges[1] - edges[0]
    if n > 2 and all(e == edges[0] + k * even for k, e in enumerate(edges)) and even > 0:
        x = (value - float(edges[0])) / float(even)  # one step stands for all
    else:
        k = F.least(F.greatest(step_of(value, edges) - 1, F.lit(0)), F.lit(n - 2))
        scale = F.array(*[F.lit(float(e)) for e in edges])
        low, high = F.get(scale, k), F.get(scale, k + 1)
        x = k + (value - low) / (high - low)
    return F.when(value.isNotNull(), F.when(F.abs(x - F.rint(x)) < 100 * 2.0**-52, F.rint(x)).otherwise(x))


def bin_of(value: Column, edges: list[float], include_upper: bool = False, include_lowest: bool = False, offset: int = 0) -> Column:
    """Number of the bin. offset 0: the last number takes what is above, what is below is masked; 1: 0 is below, n above."""
    n, x = len(edges), section_of(value, edges)
    if include_upper:
        if include_lowest:
            x = F.when(x == 0, 0.5).otherwise(x)
        k = F.ceil(x) - 1
    else:
        k = F.floor(x)
    if offset == 0:
        return F.when(k > n - 1, n - 1).when(k < 0, F.lit(None)).otherwise(k).cast("int")
    if offset == 1:
        return F.when(k + 1 > n, n).when(k + 1 < 1, 0).otherwise(k + 1).cast("int")
    raise ValueError("offset is 0 or 1")


def histogram(df: DataFrame, values: list[tuple[Column, list[float]]], weight: Column | None = None, include_upper: bool = False, include_lowest: bool = False) -> DataFrame:
    """Counts (or sums of weights) for every cell of the grid of bins: b0, b1, ..., n. Counts are made before the grid is joined."""
    bins = [bin_of(c.cast("double"), e, include_upper, include_lowest).alias(f"b{k}") for k, (c, e) in enumerate(values)]
    names = [f"b{k}" for k in range(len(values))]
    own = df.select(*bins, (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    for b in names:
        own = own.where(F.col(b).isNotNull())
    counts = own.groupBy(*names).agg(F.sum("w").alias("n"))
    grid = None
    for k, (_, edges) in enumerate(values):  # the grid's size is the product of the scales
        axis = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias(f"b{k}"))
        grid = axis if grid is None else grid.join(axis, how="cross")
    return grid.join(counts, names, "left").select(*names, F.coalesce("n", F.lit(0.0)).alias("n"))


def mid_points(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]


class Histogram:
    """Counts over a grid of bins that grow with each table added. scales: the edges of each axis; offset 1 adds a bin below the first edge."""

    def __init__(self, scales: list[list[float]], include_upper: bool = False, include_lowest: bool = True, offsets: list[int] | None = None, counts: DataFrame | None = None) -> None:
        self.scales, self.include_upper, self.include_lowest = scales, include_upper, include_lowest
        self.offsets = offsets or [0] * len(scales)
        if len(self.offsets) != len(scales) or any(o not in (0, 1) for o in self.offsets):
            raise ValueError("an offset of 0 or 1 for each scale")
        self.counts = counts

    @property
    def names(self) -> list[str]:
        return [f"b{k}" for k in range(len(self.scales))]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(s) + o for s, o in zip(self.scales, self.offsets, strict=True))

    @property
    def mid_points(self) -> list[list[float]]:
        return [mid_points(s) for s in self.scales]

    def _added(self, df: DataFrame, values: list[Column], weight: Column) -> Histogram:
        bins = [bin_of(c.cast("double"), e, self.include_upper, self.include_lowest, o).alias(b) for c, e, o, b in zip(values, self.scales, self.offsets, self.names, strict=True)]
        own = df.select(*bins, weight.cast("double").alias("n")).dropna(subset=self.names).groupBy(*self.names).agg(F.sum("n").alias("n"))
        both = own if self.counts is None else self.counts.unionByName(own).groupBy(*self.names).agg(F.sum("n").alias("n"))  # a row for each bin
        return Histogram(self.scales, self.include_upper, self.include_lowest, self.offsets, both)

    def increment(self, df: DataFrame, *values: Column) -> Histogram:
        """Counts the rows of df."""
        return self._added(df, list(values), F.lit(1.0))

    def add(self, df: DataFrame, *values: Column, weight: Column) -> Histogram:
        """Adds a weight for each row of df."""
        return self._added(df, list(values), weight)

    def merge(self, other: Histogram) -> Histogram:
        """The counts of both, which must have the same bins."""
        if self.scales != other.scales or self.offsets != other.offsets or None in (self.counts, other.counts):
            raise ValueError("the histograms differ in their bins, or one is empty")
        both = self.counts.unionByName(other.counts).groupBy(*self.names).agg(F.sum("n").alias("n"))
        return Histogram(self.scales, self.include_upper, self.include_lowest, self.offsets, both)

    def cells(self, spark) -> DataFrame:
        """b0, b1, ..., n of every bin of the grid."""
        grid = None
        for b, n in zip(self.names, self.shape, strict=True):  # the grid's size is the product of the scales
            axis = spark.range(n).select(F.col("id").cast("int").alias(b))
            grid = axis if grid is None else grid.join(axis, how="cross")
        if self.counts is None:
            return grid.withColumn("n", F.lit(0.0))
        return grid.join(self.counts, self.names, "left").select(*self.names, F.coalesce("n", F.lit(0.0)).alias("n"))

    def inner(self, spark) -> DataFrame:
        """The bins between the edges, numbered from 0."""
        out = self.cells(spark)
        for b, o, s in zip(self.names, self.offsets, self.scales, strict=True):
            out = out.withColumn(b, F.col(b) - o).where(F.col(b).between(0, len(s) - 2))
        return out


class Groups:
    """Methods of NDArray."""

    def classes(self, *names: str, key: Column | None = None) -> DataFrame:
        """Statistics of each class of equal values (or keys): class, n, and the named ones."""
        every = aggregates(self.kind)
        return self.df.where(F.col("v").isNotNull()).groupBy((F.col("v") if key is None else key).alias("class")).agg(F.count("*").alias("n"), *[every[k].alias(k) for k in names])

    def ndiming(self) -> DataFrame:
        """Classes by descending size."""
        return self.classes().orderBy(F.desc("n"), "class")

    def blocks(self, *sizes: int):
        """Tiles: addr, i0.., tile0.., p (place in the tile) and v; tiles that aren't whole are dropped."""
        df, place = self.indexed(), F.lit(0).cast("bigint")
        for k, b in enumerate(sizes):
            i = F.col(f"i{k}")
            df = df.where(i < self.shape[k] // b * b).withColumn(f"tile{k}", F.call_function("div", i, F.lit(b).cast("bigint")))
            place = place * b + i % b
        return df.withColumn("p", place)

    def block_stat(self, name: str, *sizes: int):
        """A statistic of each tile."""
        shape = tuple(n // b for n, b in zip(self.shape, sizes, strict=True))
        names = [f"tile{k}" for k in range(len(sizes))]
        out = self.blocks(*sizes).groupBy(*names).agg(aggregates(self.kind)[name].alias("v"))
        return self.like(out.select(self.address_of([F.col(c) for c in names], shape).alias("addr"), "v"), shape, "float64")

    def block_pick(self, place: int, *sizes: int):
        """The cell at one place of every tile."""
        shape = tuple(n // b for n, b in zip(self.shape, sizes, strict=True))
        out = self.blocks(*sizes).where(F.col("p") == place)
        return self.like(out.select(self.address_of([F.col(f"tile{k}") for k in range(len(sizes))], shape).alias("addr"), "v"), shape)

    def grouped_stats(self, axes: tuple[int, ...], *names: str) -> DataFrame:
        """Statistics for each index of the given axes."""
        every = aggregates(self.kind)
        return self.indexed().groupBy(*[f"i{k}" for k in axes]).agg(*[every[n].alias(n) for n in names])

    def histogram(self, edges: list[float], **options) -> DataFrame:
        return histogram(self.df, [(F.col("v"), edges)], **options)

    def classify(self, edges: list[float], outlier=None):
        """Bin of each value: under the first edge -1 (or outlier), from the last on n - 1 (or outlier)."""
        k = step_of(F.col("v"), edges) - 1
        if outlier is not None:
            k = F.when((k < 0) | (k >= len(edges) - 1), F.lit(outlier)).otherwise(k)
        return self.with_value(F.when(F.col("v").isNotNull(), k).cast("int"), "int32")

    def quantize(self, n: int, low: float | None = None, high: float | None = None):
        """Grades 0 .. n-1 between the bounds, which are the array's own by default; NaN is masked."""
        df = self.df.select("addr", F.col("v").cast("double").alias("v"))
        v = F.when(~F.isnan("v"), F.col("v"))
        if low is None or high is None:
            bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
            df = df.join(F.broadcast(bounds), how="cross")  # one row
        lo = F.col("lo") if low is None else F.lit(float(low))
        hi = F.col("hi") if high is None else F.lit(float(high))
        grade = F.floor((v - lo) / ((hi - lo) * n / (n - 1)) * n)
        return self.like(df.select("addr", F.when(lo == hi, F.when(v.isNotNull(), 0)).otherwise(grade).cast("bigint").alias("v")), kind="int64")

    grade = gradate = quantize

    def grouping_sets(self, sets: list[tuple[int, ...]], *names: str) -> DataFrame:
        """Statistics for each of several sets of axes at once; an axis that a set leaves out is NULL, and gid tells the sets apart."""
        every = sorted({k for s in sets for k in s})
        axes = [F.col(f"i{k}") for k in every]
        own = self.indexed().groupingSets([[F.col(f"i{k}") for k in s] for s in sets], *axes)
        stats = aggregates(self.kind)
        return own.agg(F.grouping_id(*axes).alias("gid"), *[stats[n].alias(n) for n in names])

    def rollup(self, axes: tuple[int, ...], *names: str) -> DataFrame:
        """Grouping sets of the axes, of all but the last, ..., of none."""
        return self.grouping_sets([axes[:k] for k in range(len(axes), -1, -1)], *names)

    def cube(self, axes: tuple[int, ...], *names: str) -> DataFrame:
        """Grouping sets of all subsets of the axes."""
        return self.grouping_sets([tuple(a for k, a in enumerate(axes) if m >> k & 1) for m in range(1 << len(axes))], *names)

    def block_put(self, place: int, values, *sizes: int):
        """Stores an array with a cell for each tile at one place of every tile."""
        shape = tuple(n // b for n, b in zip(self.shape, sizes, strict=True))
        at = self.blocks(*sizes).where(F.col("p") == place).select("addr", self.address_of([F.col(f"tile{k}") for k in range(len(sizes))], shape).alias("t"))
        new = at.join(values.df.select(F.col("addr").alias("t"), F.col("v").alias("w")), "t").select("addr", "w", F.lit(True).alias("hit"))
        kind = self.df.schema["v"].dataType
        return self.like(self.df.select("addr", "v").join(new, "addr", "left").select("addr", F.when(F.col("hit"), F.col("w").cast(kind)).otherwise(F.col("v")).alias("v")))

    def kernel(self, axes: tuple[int, ...], *index: int):
        """The cells at one index of the given axes, as an array of the axes that are left."""
        items = [None] * self.ndim
        for a, i in zip(axes, index, strict=True):
            items[a] = i
        return self.slice(*items)

    def each_group(self, axes: tuple[int, ...]):
        """An iterator over (index, ordered values) of each index of the given axes; only one group is on the driver at a time."""
        keys = [f"i{k}" for k in axes]
        listed = F.transform(F.array_sort(F.collect_list(F.struct("addr", "v"))), lambda x: x["v"])
        for r in self.indexed().groupBy(*keys).agg(listed.alias("v")).orderBy(*keys).toLocalIterator():
            yield tuple(r[k] for k in keys), r.v

    def groups_by(self, axis: int, key: Column):
        """The indices of one axis put in the order of a key (an aggregate of v) of their cells."""
        name, n = f"i{axis}", self.shape[axis]
        keyed = self.indexed().groupBy(name).agg(key.alias("k")).withColumnRenamed(name, "addr")
        places = ranked(keyed, [("k", False), ("addr", False)], n).select(F.col("addr").alias(name), F.col("rank").cast("bigint").alias("to"))
        columns = [F.col("to") if k == axis else F.col(f"i{k}") for k in range(self.ndim)]
        return self.like(self.indexed().join(places, name).select(self.address_of(columns).alias("addr"), "v"))

    def incr_addr(self, index):
        """Adds 1 to the cells whose addresses another array lists, as often as it does: counted before the join."""
        counts = index.df.where(F.col("v").isNotNull()).groupBy(F.col("v").cast("bigint").alias("addr")).agg(F.count("*").alias("n"))
        return self.like(self.df.join(counts, "addr", "left").select("addr", (F.col("v") + F.coalesce("n", F.lit(0))).cast(self.df.schema["v"].dataType).alias("v")))

    def outer(self, other):
        """Products of all pairs of cells; the product of the shapes is the result."""
        n = other.elements
        b = other.df.select(F.col("addr").alias("j"), F.col("v").alias("w"))
        out = self.df.join(b, how="cross").select((F.col("addr") * n + F.col("j")).alias("addr"), (F.col("v") * F.col("w")).alias("v"))
        return self.like(out, (*self.shape, *other.shape), "float64")
