"""Selecting, gathering and storing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(item, n: int) -> tuple[int, int, int]:
    """start, count and step of a slice or of a list [start, count, step]."""
    if isinstance(item, slice):
        start, stop, step = item.indices(n)
        return start, len(range(start, stop, step)), step
    start, count, step = (*item, 1)[:3] if len(item) < 3 else item
    return start + n if start < 0 else start, count, step


class Index:
    """Methods of NDArray."""

    def at(self, *index: int):
        """One cell by address or by index; negative counts from the end once."""
        if len(index) == 1 and self.ndim != 1:
            n, k = self.elements, index[0]
        else:
            if len(index) != self.ndim:
                raise IndexError("as many indices as axes")
            for i, d in zip(index, self.shape, strict=True):
                if not -d <= i < d:
                    raise IndexError("index out of range")
            k, n = 0, self.elements
            for i, d in zip(index, self.shape, strict=True):
                k = k * d + i % d
        if not -n <= k < n:
            raise IndexError("address out of range")
        return self.like(self.df.where(F.col("addr") == k % n).select(F.lit(0).cast("bigint").alias("addr"), "v"), ())

    def slice(self, *items):
        """A rectangle: each item an integer, a slice, None for all, or [start, count, step]. Integers drop their axis."""
        df, columns, shape = self.indexed(), [], []
        for k, item in enumerate(items):
            c = F.col(f"i{k}")
            if item is None:
                columns.append(c)
                shape.append(self._shape[k])
            elif isinstance(item, int):
                df = df.where(c == item % self.shape[k])
            else:
                start, count, step = block(item, self.shape[k])
                low, high = (start, start + (count - 1) * step) if step > 0 else (start + (count - 1) * step, start)
                df = df.where(c.between(low, high) & ((c - start) % step == 0))
                columns.append(F.call_function("div", c - start, F.lit(step).cast("bigint")))
                shape.append(count)
        return self.like(df.select(self.address_of(columns, tuple(shape)).alias("addr"), "v"), tuple(shape))

    def select(self, where) -> DataFrame:
        """addr and v of the cells where a column condition, or a boolean array, is true. Masked is not true."""
        if isinstance(where, Column):
            return self.df.where(where).select("addr", "v")
        chosen = where.df.where("v").select("addr")
        return self.df.select("addr", "v").join(chosen, "addr", "left_semi")

    def compact_select(self, where):
        """The selected cells as a vector, addressed from 0 in their order."""
        from .prefix import running

        chosen = self.select(where)
        n = running(chosen.withColumn("one", F.lit(1)), self.elements, {"k": ("sum", F.col("one"))})
        return self.like(n.select((F.col("k") - 1).cast("bigint").alias("addr"), "v"), (None,))

    def gather(self, index):
        """Values at an integer array's addresses, in its shape: negatives count from the end, a masked or outer index fails."""
        n = self.elements
        k = F.col("k")
        bad = F.when(k.isNull(), F.raise_error(F.lit("masked index")).cast("bigint")).when((k < -n) | (k >= n), F.raise_error(F.lit("index out of range")).cast("bigint"))
        wanted = index.df.select("addr", F.col("v").cast("bigint").alias("k")).select("addr", bad.otherwise(F.when(k < 0, k + n).otherwise(k)).alias("k"))
        return index.like(wanted.join(self.df.select(F.col("addr").alias("k"), "v"), "k", "left").select("addr", "v"), kind=self.kind)

    def project(self, index, lower=None, upper=None):
        """As gather, but what lies outside, or is masked, is masked or filled."""
        n, k = self.elements, F.col("k")
        wanted = index.df.select("addr", F.col("v").cast("bigint").alias("k"))
        found = wanted.join(self.df.select(F.col("addr").alias("k"), "v"), "k", "left")
        upper = lower if upper is None else upper
        return index.like(found.select("addr", F.when(k < 0, F.lit(lower)).when(k >= n, F.lit(upper)).otherwise(F.col("v")).alias("v")), kind=self.kind)

    def grid(self, *items):
        """Orthogonal gather: for each axis None or a list of places; masked places (None) are dropped."""
        df, columns, shape = self.indexed(), [], []
        for k, item in enumerate(items):
            if item is None:
                columns.append(F.col(f"i{k}"))
                shape.append(self._shape[k])
                continue
            places = [p for p in item if p is not None]
            n = self.shape[k]
            if any(not -n <= p < n for p in places):
                raise IndexError("index out of range")
            chosen = self.spark.createDataFrame([(p % n, j) for j, p in enumerate(places)], f"i{k} bigint, j{k} bigint")
            df = df.join(F.broadcast(chosen), f"i{k}")  # an axis index comes from the caller's list
            columns.append(F.col(f"j{k}"))
            shape.append(len(places))
        return self.like(df.select(self.address_of(columns, tuple(shape)).alias("addr"), "v"), tuple(shape))

    def store(self, where: Column, value):
        """value (None masks) where the condition on addr, v and index columns holds."""
        new = F.lit(value) if not isinstance(value, Column) else value
        return self.like(self.indexed().select("addr", F.when(where, new.cast(self.df.schema["v"].dataType)).otherwise(F.col("v")).alias("v")))

    def set_(self, where: Column):
        return self.store(where, True)

    def unset(self, where: Column):
        return self.store(where, False)

    def where(self) -> DataFrame:
        """Addresses of cells that are true (not 0)."""
        v = F.col("v")
        return self.df.where(v if self.kind == "boolean" else v != 0).select("addr")

    def where_range(self) -> DataFrame:
        """first and last of each run of true cells: an address starts a run if the one before isn't true."""
        from .prefix import running

        true = self.where()
        before = true.select((F.col("addr") + 1).alias("addr"), F.lit(True).alias("b"))
        marked = true.join(before, "addr", "left").select("addr", F.when(F.col("b").isNull(), 1).otherwise(0).alias("new"))
        runs = running(marked, self.elements, {"run": ("sum", F.col("new"))})
        return runs.groupBy("run").agg(F.min("addr").alias("first"), F.max("addr").alias("last")).select("first", "last")

    def first(self) -> DataFrame:
        return self.df.agg(F.min_by("v", "addr").alias("v"))

    def last(self) -> DataFrame:
        return self.df.agg(F.max_by("v", "addr").alias("v"))

    def swap(self, a: int, b: int):
        addr = F.col("addr")
        return self.like(self.df.select(F.when(addr == a, F.lit(b)).when(addr == b, F.lit(a)).otherwise(addr).cast("bigint").alias("addr"), "v"))

    def copy_cell(self, source: int, target: int):
        """Reads one cell (on the driver's plan, not data) and stores it in another."""
        one = self.df.where(F.col("addr") == source).select(F.lit(target).cast("bigint").alias("addr"), F.col("v").alias("w"), F.lit(True).alias("hit"))
        joined = self.df.join(F.broadcast(one), "addr", "left")
        return self.like(joined.select("addr", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).alias("v")))

    def incr(self, addr: int, by: int = 1):
        return self.store(F.col("addr") == addr, F.col("v") + by)

    def addr2index(self, addr: Column) -> Column:
        return F.array(*[self.index_column(k, addr) for k in range(self.ndim)])

    def index2addr(self, *index: Column) -> Column:
        return self.address_of(list(index))

    def valid_addr(self, addr: Column) -> Column:
        return addr.between(-self.elements, self.elements - 1)

    def valid_index(self, *index: Column) -> Column:
        ok = F.lit(True)
        for c, n in zip(index, self.shape, strict=True):
            ok = ok & c.between(-n, n - 1)
        return ok

    def fetch_linear_addr(self, at):
        """Values at fractional addresses by linear interpolation; outside 0..n-1 masked. at: an array of doubles."""
        wanted = at.df.select("addr", F.col("v").alias("x")).where(F.col("x").isNotNull())
        wanted = wanted.select("addr", "x", F.floor("x").cast("bigint").alias("k0"), F.ceil("x").cast("bigint").alias("k1"))
        own = self.df.select("addr", F.col("v").cast("double").alias("v"))
        found = wanted.join(own.toDF("k0", "y0"), "k0").join(own.toDF("k1", "y1"), "k1")
        t = F.col("x") - F.col("k0")
        values = found.select("addr", (F.col("y0") * (1 - t) + F.col("y1") * t).alias("y"))
        return at.like(at.df.select("addr").join(values, "addr", "left").select("addr", F.col("y").alias("v")), kind="float64")
