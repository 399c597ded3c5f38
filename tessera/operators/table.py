"""Named columns over the last axis of a matrix, joins of arrays by value, and SQL over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of a value on either side of join_values that meet in one tile.
TILE = 2048


class Table:
    """A matrix whose columns have names."""

    def __init__(self, a, names: list[str]) -> None:
        if a.ndim != 2 or len(names) != a.shape[1]:
            raise ValueError("a name for each column of a matrix")
        self.array, self.column_names = a, list(names)

    def column(self, name: int | str):
        """The column as a vector; None for an unknown name."""
        if isinstance(name, str):
            if name not in self.column_names:
                return None
            name = self.column_names.index(name)
        return self.array.slice(None, name)

    def row(self, i: int) -> dict:
        """One row by column name."""
        n = len(self.column_names)
        got = {r.addr: r.v for r in self.array.slice([i % self.array.shape[0], 1], None).df.collect()}  # a cell for each column
        return {c: got.get(k) for k, c in zip(range(n), self.column_names, strict=True)}

    def frame(self) -> DataFrame:
        """i0 and a column for each name: one aggregation, no join."""
        cells = [F.max(F.when(F.col("i1") == k, F.col("v"))).alias(c) for k, c in enumerate(self.column_names)]
        return self.array.indexed().groupBy("i0").agg(*cells)


class Tables:
    """Methods of NDArray."""

    def as_table(self, names: list[str]) -> Table:
        return Table(self, names)

    extend_as_table = as_table

    def join_values(self, other, how: str = "inner") -> DataFrame:
        """addr, v and other: the cells of both arrays with equal values, by any of Spark's joins; masked values meet nothing.

        The cells of a value are dealt in tiles on both sides, and those of the other array stand in one list for each
        tile, so neither a task nor what it holds at once grows with the pairs of a frequent value.
        """
        left, right = self.df.select("addr", "v"), other.df.select(F.col("addr").alias("other"), F.col("v").alias("w"))
        how = how.lower().replace("_", "")
        how = {"leftouter": "left", "rightouter": "right", "fullouter": "full", "outer": "full", "semi": "leftsemi", "anti": "leftanti"}.get(how, how)
        if how not in ("inner", "left", "right", "full"):
            return left.join(right, F.col("v") == F.col("w"), how)
        tiles = lambda c: F.ceil(F.count(c) / TILE).cast("int")
        tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        ours = left.groupBy("v").agg(tiles("v").alias("p"))
        theirs = right.groupBy("w").agg(tiles("w").alias("q"))
        met = ours.join(theirs, F.col("v") == F.col("w")).select(F.col("v").alias("mv"), F.col("w").alias("mw"), "p", "q")
        lists = right.join(met, F.col("w") == F.col("mw")).groupBy("mv", "mw", "p", tile("other", "q").alias("tq")).agg(F.collect_list("other").alias("others"))
        lists = lists.select("mv", "mw", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("tp"), "tq", "others")
        dealt = left.join(met.select(F.col("mv").alias("of"), F.col("mw").alias("w"), "p", "q"), F.col("v") == F.col("of"), "left" if how in ("left", "full") else "inner")
        # a cell that meets nothing has a place of its own: masked ones don't wait for each other in one task
        dealt = dealt.select("addr", "v", "of", "w", F.coalesce(tile("addr", "p"), F.hash("addr")).alias("lp"), F.explode_outer(F.sequence(F.lit(0), F.col("q") - 1)).alias("lq"))
        # a number of its own, so adaptive execution doesn't bring tiles together by their size, which tells nothing of their pairs
        dealt = dealt.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "of", "w", "lp", "lq")
        same = (F.col("of") == F.col("mv")) & (F.col("w") == F.col("mw")) & (F.col("lp") == F.col("tp")) & (F.col("lq") == F.col("tq"))
        joined = dealt.join(lists, same, "left" if how in ("left", "full") else "inner")
        joined = joined.select("addr", F.coalesce("v", "w").alias("v"), F.explode_outer("others").alias("other"))
        if how in ("inner", "left"):
            return joined
        none = [F.lit(None).cast(kind).alias(name) for name, kind in left.dtypes]
        alone = right.join(met, F.col("w") == F.col("mw"), "left_anti").select(*none, "w", "other")
        return joined.union(alone.select("addr", F.coalesce("v", "w").alias("v"), "other"))

    def join_interval(self, low, high) -> DataFrame:
        """addr and other: the cells whose values lie within [low, high] of the cells of two arrays of interval bounds.

        Intervals are sent to the parts of the value range that they touch, values to their part.
        """
        spans = low.df.select("addr", F.col("v").cast("double").alias("low")).join(high.df.select("addr", F.col("v").cast("double").alias("high")), "addr").where("low <= high")
        told = spans.agg(F.min("low").alias("a"), F.max("high").alias("b"), F.expr("percentile_approx(high - low, 0.9)").alias("w")).first()
        width = max((told.w or 0.0), ((told.b or 0.0) - (told.a or 0.0)) / (1 << 20)) or 1.0
        part = lambda c: F.floor((c - float(told.a or 0.0)) / width)
        sent = spans.select(F.col("addr").alias("other"), "low", "high", F.explode(F.sequence(part(F.col("low")), part(F.col("high")))).alias("p"))
        own = self.df.where(F.col("v").isNotNull()).select("addr", F.col("v").cast("double").alias("x")).withColumn("p", part(F.col("x")))
        return own.join(sent, "p").where(F.col("x").between(F.col("low"), F.col("high"))).select("addr", "other")

    def as_view(self, name: str) -> None:
        """Registers addr, the index columns and v as a temporary view for SQL."""
        self.indexed().createOrReplaceTempView(name)

    def ranking(self, how: str, n: int | None = None, by: tuple[int, ...] = (), down: bool = False):
        """rank, dense_rank, percent_rank, cume_dist, ntile or row_number of the values, within each index of the axes `by`."""
        order = [F.desc("v") if down else F.asc("v"), *([F.asc("addr")] if how in ("ntile", "row_number") else [])]
        if not by and how in ("rank", "row_number"):
            return self._ranked_by_order(how, down)
        w = Window.partitionBy(*[f"i{k}" for k in by]).orderBy(*order)
        value = {"ntile": lambda: F.ntile(n), "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist, "row_number": F.row_number}[how]()
        valid = self.indexed().where(F.col("v").isNotNull()).select("addr", value.over(w).alias("v"))
        return self.like(self.df.select("addr").join(valid, "addr", "left"), kind="float64" if how in ("percent_rank", "cume_dist") else "int32")

    def _ranked_by_order(self, how: str, down: bool):
        """Ranks of the whole array without one big window: places in the order, and for ties the least of them."""
        from .prefix import ranked

        valid = ranked(self.df.where(F.col("v").isNotNull()).select("addr", "v"), [("v", down), ("addr", False)], self.elements)
        if how == "rank":
            least = valid.groupBy("v").agg(F.min("rank").alias("rank"))
            valid = valid.select("addr", "v").join(least, "v")
        return self.like(self.df.select("addr").join(valid.select("addr", (F.col("rank") + 1).cast("int").alias("v")), "addr", "left"), kind="int32")

    def to_json(self, *columns: Column) -> DataFrame:
        """addr and json: each cell (or a struct of columns) as JSON."""
        return self.indexed().select("addr", F.to_json(F.struct(*(columns or [F.col("v")]))).alias("json"))
