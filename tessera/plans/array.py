"""Arrays as DataFrames: a row for each cell, keyed by its row-major address; a masked cell has a NULL value.

`df` has the columns addr (bigint) and v, and may have raw, the value under the mask. The shape is metadata, so reshaping
is free; index columns i0, i1, ... are arithmetic on addr. Operations return new arrays and only build plans, except
where a method says that it counts or looks for bounds.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import SPARK, canonical
from ..operators.access import Access
from ..operators.compose import Compose
from ..operators.elements import Elements
from ..operators.groups import Groups
from ..operators.index import Index
from ..operators.lookup import Lookup
from ..operators.order import Order
from ..operators.sets import Sets
from ..operators.stats import Stats
from ..operators.table import Tables
from ..operators.windows import Windows


class NDArray(Access, Index, Elements, Stats, Groups, Windows, Order, Sets, Lookup, Compose, Tables):
    """df: addr, v (, raw). shape: lengths of the axes; only the first may be None, and is then counted when needed."""

    def __init__(self, df: DataFrame, shape: tuple[int | None, ...], kind: str = "float64", attributes: dict | None = None) -> None:
        self.df, self._shape, self.kind, self.attributes = df, tuple(shape), canonical(kind), dict(attributes or {})

    # construction

    @classmethod
    def from_table(cls, df: DataFrame, addr: Column | str, value: Column | str, inner: tuple[int, ...] = (), kind: str = "float64") -> NDArray:
        """One cell for each row; addr must count from 0. inner: lengths of all axes but the first."""
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return cls(df.select(c(addr).cast("bigint").alias("addr"), c(value).cast(SPARK[canonical(kind)]).alias("v")), (None, *inner), kind)

    @classmethod
    def generate(cls, spark: SparkSession, shape: tuple[int, ...], value: Column, kind: str = "float64") -> NDArray:
        """A cell for each address; value may use addr."""
        df = spark.range(prod(shape)).select(F.col("id").alias("addr")).select("addr", value.cast(SPARK[canonical(kind)]).alias("v"))
        return cls(df, shape, kind)

    @classmethod
    def from_list(cls, spark: SparkSession, nested, kind: str | None = None) -> NDArray:
        """From nested lists; None is masked."""
        from ..operators.create import flat, guess_kind, guess_shape

        shape = guess_shape(nested)
        values = flat(nested, len(shape))
        kind = canonical(kind or guess_kind(values))
        rows = [(i, v) for i, v in enumerate(values)]
        return cls(spark.createDataFrame(rows, f"addr bigint, v {SPARK[kind]}"), shape, kind)

    @classmethod
    def from_values(cls, values: DataFrame, n: int, kind: str = "float64") -> NDArray:
        """A vector of the values of a column v, in ascending order. n: how many, about."""
        from ..operators.prefix import ranked

        numbered = ranked(values.select("v", F.xxhash64("v").alias("addr")), [("v", False), ("addr", False)], n)
        return cls(numbered.select(F.col("rank").cast("bigint").alias("addr"), "v"), (None,), kind)

    def like(self, df: DataFrame, shape: tuple[int | None, ...] | None = None, kind: str | None = None) -> NDArray:
        return NDArray(df, self._shape if shape is None else shape, kind or self.kind, self.attributes)

    # shape and type

    @property
    def shape(self) -> tuple[int, ...]:
        """Counts the cells once if the first length isn't known."""
        if self._shape and self._shape[0] is None:
            self._shape = (self.df.count() // prod(self._shape[1:]), *self._shape[1:])
        return self._shape

    dim = shape

    @property
    def ndim(self) -> int:
        return len(self._shape)

    rank = ndim

    @property
    def elements(self) -> int:
        return prod(self.shape)

    size = length = elements

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def bytes(self) -> int:
        from ..sources.container import WIDTH

        return WIDTH[self.kind]

    def strides(self) -> list[int]:
        return [prod(self._shape[k + 1 :]) for k in range(self.ndim)]

    def axes(self, negative: tuple[int, ...]) -> list[int]:
        out = sorted({a % self.ndim if -self.ndim <= a < self.ndim else a for a in negative})
        if any(a >= self.ndim or a < 0 for a in out):
            raise IndexError("axis out of range")
        return out

    def index_column(self, axis: int, addr: Column | None = None) -> Column:
        addr = F.col("addr") if addr is None else addr
        out = F.call_function("div", addr, F.lit(self.strides()[axis]).cast("bigint")) if self.strides()[axis] > 1 else addr
        return out if axis == 0 else out % self._shape[axis]

    def indexed(self) -> DataFrame:
        """df with the index columns i0, i1, ..."""
        return self.df.select("*", *[self.index_column(k).alias(f"i{k}") for k in range(self.ndim)])

    def address_of(self, columns: list[Column], shape: tuple[int | None, ...] | None = None) -> Column:
        """Row-major address from index columns."""
        shape = self._shape if shape is None else shape
        out = F.lit(0).cast("bigint")
        for k, c in enumerate(columns):
            out = out * (shape[k] if k else 1) + c
        return out

    def is_same_shape(self, other: NDArray) -> bool:
        return self.shape == other.shape

    def is_empty(self) -> bool:
        return self.elements == 0

    def is_scalar(self) -> bool:
        return self.ndim == 0

    def desc(self) -> str:
        return f"<{self.kind}({self.ndim}): shape={list(self._shape)}>"

    __repr__ = desc

    # results

    def values(self) -> list:
        """All values in the order of addresses, on the driver: for small arrays."""
        return [r.v for r in self.df.select("addr", "v").orderBy("addr").collect()]

    def to_list(self):
        """Nested lists, on the driver."""
        out = self.values()
        for n in reversed(self.shape[1:]):
            out = [out[i : i + n] for i in range(0, len(out), n)]
        return out

    def scalar(self):
        """The only value of a one-cell array."""
        return self.df.select("v").first()[0]

    def to_pandas(self):
        return self.df.orderBy("addr").toPandas()

    def to_arrow(self):
        return self.df.orderBy("addr").toArrow()

    def cache(self) -> NDArray:
        return self.like(self.df.cache())
