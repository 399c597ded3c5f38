"""Sorting, ranks, extremes by key, top-k. Ties go to the lower address; masked and NaN come last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ranked, running


class Order:
    """Methods of NDArray."""

    def sort(self):
        """Ascending; masked cells keep their places, so the k-th valid value goes to the k-th valid cell."""
        valid = self.df.where(F.col("v").isNotNull()).select("addr", "v")
        n = self.elements
        values = ranked(valid, [("v", False), ("addr", False)], n).select("rank", "v")
        slots = ranked(valid.select("addr"), [("addr", False)], n).select("rank", "addr")
        placed = slots.join(values, "rank").select("addr", "v")
        return self.like(self.df.select("addr").join(placed, "addr", "left"))

    def sort_addr(self, *others) -> DataFrame:
        """addr and source: the address of the value that comes to each place, by this array and then the others."""
        df, keys = self.df.select("addr", F.col("v").alias("k0")), [("k0", False)]
        for i, o in enumerate(others, 1):
            df = df.join(o.df.select("addr", F.col("v").alias(f"k{i}")), "addr")
            keys.append((f"k{i}", False))
        out = ranked(df, [*keys, ("addr", False)], self.elements)
        return out.select(F.col("rank").cast("bigint").alias("addr"), F.col("addr").alias("source"))

    def order(self, direction: int = 1):
        """The rank of each value; downwards, ties rank by descending address."""
        down = direction < 0
        valid = ranked(self.df.where(F.col("v").isNotNull()).select("addr", "v"), [("v", down), ("addr", down)], self.elements)
        return self.like(self.df.select("addr").join(valid.select("addr", F.col("rank").cast("bigint").alias("v")), "addr", "left"), kind="int64")

    def sort_by(self, key: Column):
        """Values in the order of a key of v and addr."""
        df = self.df.select("addr", "v", key.alias("k"))
        return self.like(ranked(df, [("k", False), ("addr", False)], self.elements).select(F.col("rank").cast("bigint").alias("addr"), "v"))

    def sort_with(self, *others):
        """This array sorted, and others in the same order: a DataFrame of addr, v, w0, w1, ..."""
        df = self.df.select("addr", "v")
        for i, o in enumerate(others):
            df = df.join(o.df.select("addr", F.col("v").alias(f"w{i}")), "addr")
        out = ranked(df, [("v", False), ("addr", False)], self.elements)
        return out.select(F.col("rank").cast("bigint").alias("addr"), "v", *[f"w{i}" for i in range(len(others))])

    def reverse(self):
        return self.like(self.df.select((F.lit(self.elements - 1) - F.col("addr")).alias("addr"), "v"))

    def reversed(self):
        """Reversed along each axis."""
        columns = [F.lit(n - 1) - F.col(f"i{k}") for k, n in enumerate(self.shape)]
        return self.like(self.indexed().select(self.address_of(columns).alias("addr"), "v"))

    def nlargest(self, n: int) -> DataFrame:
        """The n largest with their addresses."""
        return self.df.where(F.col("v").isNotNull()).orderBy(F.desc("v"), "addr").limit(n).select("addr", "v")

    def nsmallest(self, n: int) -> DataFrame:
        return self.df.where(F.col("v").isNotNull()).orderBy("v", "addr").limit(n).select("addr", "v")

    nlargest_addr, nsmallest_addr = nlargest, nsmallest

    def max_by(self, key: Column) -> DataFrame:
        return self.df.where(key.isNotNull()).agg(F.max(F.struct(key.alias("k"), (-F.col("addr")).alias("a"), "v"))["v"].alias("v"))

    def min_by(self, key: Column) -> DataFrame:
        return self.df.where(key.isNotNull()).agg(F.min(F.struct(key.alias("k"), "addr", "v"))["v"].alias("v"))

    def _beside(self, others) -> tuple[DataFrame, list[str]]:
        df = self.df.where(F.col("v").isNotNull()).select("addr", "v")
        for i, o in enumerate(others):
            df = df.join(o.df.select("addr", F.col("v").alias(f"w{i}")), "addr")
        return df, ["v", *[f"w{i}" for i in range(len(others))]]

    def max_with(self, *others) -> DataFrame:
        df, names = self._beside(others)
        best = F.max(F.struct("v", (-F.col("addr")).alias("_a"), *names[1:]))
        return df.agg(best.alias("s")).select(*[F.col(f"s.{c}").alias(c) for c in names])

    def min_with(self, *others) -> DataFrame:
        df, names = self._beside(others)
        return df.agg(F.min(F.struct("v", "addr", *names[1:])).alias("s")).select(*[F.col(f"s.{c}").alias(c) for c in names])

    def uniq(self) -> DataFrame:
        """Distinct valid values with the address where each is first seen."""
        return self.df.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("addr").alias("addr"))

    def duplicated_values(self) -> DataFrame:
        """value, addr and n of each occurrence of a value after its first, n counting from 1. A frequent value is counted over stretches."""
        valid = self.df.where(F.col("v").isNotNull()).select("addr", F.col("v").alias("value"))
        counted = running(valid, self.elements, {"n": ("count", F.col("addr"))}, ("value",))
        return counted.select("value", "addr", (F.col("n") - 1).alias("n")).where("n > 0")
