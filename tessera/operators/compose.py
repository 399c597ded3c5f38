"""Concatenation, stacking, resizing, and shapes."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed(a, offsets: list[int], shape: tuple[int, ...]) -> DataFrame:
    """The cells of an array at an offset within a larger shape."""
    return a.indexed().select(a.address_of([F.col(f"i{k}") + o for k, o in enumerate(offsets)], shape).alias("addr"), "v")


def bind(arrays: list, at: int = 0):
    """Concatenates along an existing axis."""
    first = arrays[0]
    at %= first.ndim
    total = sum(a.shape[at] for a in arrays)
    shape = tuple(total if k == at else n for k, n in enumerate(first.shape))
    parts, offset = [], 0
    for a in arrays:
        if any(x != y for k, (x, y) in enumerate(zip(a.shape, first.shape, strict=True)) if k != at):
            raise ValueError("other axes differ")
        parts.append(placed(a, [offset if k == at else 0 for k in range(a.ndim)], shape))
        offset += a.shape[at]
    return first.like(reduce(DataFrame.unionByName, parts), shape)


def merge(arrays: list, at: int = -1):
    """Stacks along a new axis."""
    first = arrays[0]
    at %= first.ndim + 1
    return bind([a.reshape(*a.shape[:at], 1, *a.shape[at:]) for a in arrays], at)


def combine(grid: list[list]):
    """Tiles a grid of 2-d arrays."""
    return bind([bind(row, 1) for row in grid], 0)


def composite(grid_shape: tuple[int, ...], arrays: list, at: int = 0):
    """Stacks arrays in a grid of new axes that begin at `at`."""
    merged = merge(arrays, at % (arrays[0].ndim + 1))
    k = at % (arrays[0].ndim + 1)
    return merged.reshape(*merged.shape[:k], *grid_shape, *merged.shape[k + 1 :])


def join(*rows: list):
    """Rows of arrays side by side; vectors become columns."""
    return combine([[a.to_column() if a.ndim == 1 else a for a in row] for row in rows])


class Compose:
    """Methods of NDArray."""

    def resize(self, *shape: int, fill_value=0):
        """Grows with a fill or shrinks; a negative length keeps the trailing part."""
        target = tuple(abs(n) for n in shape)
        shift = [abs(n) - self.shape[k] if n < 0 else 0 for k, n in enumerate(shape)]
        return self._laid(target, shift, fill_value)

    def _laid(self, target: tuple[int, ...], shift: list[int], fill_value):
        df, columns, ok = self.indexed(), [], F.lit(True)
        for k, (n, s) in enumerate(zip(target, shift, strict=True)):
            c = F.col(f"i{k}") + s
            columns.append(c)
            ok = ok & c.between(0, n - 1)
        moved = df.where(ok).select(self.address_of(columns, target).alias("addr"), F.col("v").alias("w"), F.lit(True).alias("hit"))
        cells = self.spark.range(prod(target)).select(F.col("id").alias("addr"))
        v = F.when(F.col("hit"), F.col("w")).otherwise(F.lit(fill_value).cast(self.df.schema["v"].dataType))
        return self.like(cells.join(moved, "addr", "left").select("addr", v.alias("v")), target)

    def insert_block(self, offset: tuple[int, ...], size: tuple[int, ...], fill_value=0):
        """Makes room of `size` before `offset` on each axis."""
        target = tuple(n + s for n, s in zip(self.shape, size, strict=True))
        columns = [F.when(F.col(f"i{k}") >= o, F.col(f"i{k}") + s).otherwise(F.col(f"i{k}")) for k, (o, s) in enumerate(zip(offset, size, strict=True))]
        moved = self.indexed().select(self.address_of(columns, target).alias("addr"), F.col("v").alias("w"), F.lit(True).alias("hit"))
        cells = self.spark.range(prod(target)).select(F.col("id").alias("addr"))
        v = F.when(F.col("hit"), F.col("w")).otherwise(F.lit(fill_value).cast(self.df.schema["v"].dataType))
        return self.like(cells.join(moved, "addr", "left").select("addr", v.alias("v")), target)

    def delete_block(self, offset: tuple[int, ...], size: tuple[int, ...]):
        target = tuple(n - s for n, s in zip(self.shape, size, strict=True))
        df, columns = self.indexed(), []
        for k, (o, s) in enumerate(zip(offset, size, strict=True)):
            i = F.col(f"i{k}")
            if s:
                df = df.where(~i.between(o, o + s - 1))
            columns.append(F.when(i >= o, i - s).otherwise(i))
        return self.like(df.select(self.address_of(columns, target).alias("addr"), "v"), target)

    def paste(self, offset: tuple[int, ...], other):
        """Lays another array over this one; what exceeds it is cut off."""
        columns, ok = [], F.lit(True)
        for k, o in enumerate(offset):
            c = F.col(f"i{k}") + o
            columns.append(c)
            ok = ok & c.between(0, self.shape[k] - 1)
        moved = other.indexed().where(ok).select(self.address_of(columns).alias("addr"), F.col("v").alias("w"), F.lit(True).alias("hit"))
        return self.like(self.df.join(moved, "addr", "left").select("addr", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).alias("v")))

    def clip(self, offset: tuple[int, ...], shape: tuple[int, ...], fill_value=None):
        """Copies out the rectangle at an offset."""
        return self._laid(shape, [-o for o in offset], fill_value)

    def split(self, axis: int = 0) -> DataFrame:
        """A row for each index of the axis with its cells as an ordered array."""
        listed = F.array_sort(F.collect_list(F.struct("addr", "v")))
        return self.indexed().groupBy(f"i{axis}").agg(F.transform(listed, lambda x: x["v"]).alias("v"))

    # shapes

    def reshape(self, *shape: int | None):
        """Only metadata. One length may be -1."""
        if -1 in shape:
            rest = -prod(n for n in shape)
            shape = tuple(self.elements // rest if n == -1 else n for n in shape)
        if prod(shape) != self.elements:
            raise ValueError(f"{self.shape} has not as many cells as {shape}")
        return self.like(self.df, tuple(shape))

    def flatten(self):
        return self.like(self.df, (None,))

    def transpose(self, *order: int):
        order = order or tuple(reversed(range(self.ndim)))
        shape = tuple(self.shape[k] for k in order)
        return self.like(self.indexed().select(self.address_of([F.col(f"i{k}") for k in order], shape).alias("addr"), "v"), shape)

    @property
    def t(self):
        return self.transpose()

    def compact(self):
        return self.like(self.df, tuple(n for n in self.shape if n != 1))

    def to_row(self):
        return self.like(self.df, (1, self.elements))

    def to_column(self):
        return self.like(self.df, (self.elements, 1))

    def pull(self, *spec: int | None):
        """New axes of these lengths; None stands for the next own axis."""
        own, shape = iter(range(self.ndim)), []
        df, columns = self.indexed(), []
        for k, n in enumerate(spec):
            if n is None:
                a = next(own)
                shape.append(self._shape[a])
                columns.append(F.col(f"i{a}"))
            else:
                df = df.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(f"r{k}"))
                shape.append(n)
                columns.append(F.col(f"r{k}"))
        return self.like(df.select(self.address_of(columns, tuple(shape)).alias("addr"), "v"), tuple(shape))

    repeat = pull

    def pack(self, *others, names: list[str] | None = None) -> DataFrame:
        """addr and a record of this array's and others' values."""
        df, names = self.df.select("addr", F.col("v").alias("f0")), names or [f"f{k}" for k in range(len(others) + 1)]
        for k, o in enumerate(others, 1):
            df = df.join(o.df.select("addr", F.col("v").alias(f"f{k}")), "addr")
        return df.select("addr", F.struct(*[F.col(f"f{k}").alias(n) for k, n in enumerate(names)]).alias("v"))

    def link(self, f) -> DataFrame:
        """A derived array that is computed whenever it is used."""
        value: Column = f(F.col("v"))
        return self.with_value(value)
