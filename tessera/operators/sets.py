"""Set operations on the values of arrays, and element tests against a set. Masked cells take no part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sets:
    """Methods of NDArray. Results are one column v of distinct values, unordered; sort them with NDArray.from_values."""

    def value_set(self) -> DataFrame:
        return self.df.where(F.col("v").isNotNull()).select("v").distinct()

    def union(self, other) -> DataFrame:
        """Values of either array. Each is reduced before the two meet."""
        return self.value_set().union(other.value_set()).distinct()

    def intersect(self, other) -> DataFrame:
        """Values of both arrays."""
        return self.value_set().join(other.value_set(), "v", "left_semi")

    def except_(self, other) -> DataFrame:
        """Values of this array that the other doesn't have."""
        return self.value_set().join(other.value_set(), "v", "left_anti")

    def except_all(self, other) -> DataFrame:
        """As except_ with multiplicity: an occurrence in the other takes away one here. v and n, how many are left."""
        mine = self.df.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("a"))
        theirs = other.df.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("b"))
        left = mine.join(theirs, "v", "left").select("v", (F.col("a") - F.coalesce("b", F.lit(0))).alias("n"))
        return left.where("n > 0")

    def is_in(self, other):
        """Whether each value occurs in another array; masked stays masked."""
        there = other.value_set().withColumn("hit", F.lit(True))
        joined = self.df.select("addr", "v").join(there, "v", "left")
        return self.like(joined.select("addr", F.when(F.col("v").isNotNull(), F.coalesce("hit", F.lit(False))).alias("v")), kind="boolean")
