"""Iteration, index classification, reinterpretation of bytes, deprecated forms, and what an array tells about itself."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import SPARK, canonical

#: Numpy types of the element types; fixed values.
NUMPY = {"boolean": "i1", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float32": "f4", "float64": "f8"}


def normalize_index(shape: tuple[int, ...], index: list) -> list:
    """Each index without negatives: integers, and [start, count, step] for slices, None and blocks."""
    from .index import block

    if len(index) != len(shape):
        raise IndexError("as many indices as axes")
    out = []
    for i, n in zip(index, shape, strict=True):
        if isinstance(i, int):
            if not -n <= i < n:
                raise IndexError("index out of range")
            out.append(i % n)
        else:
            out.append([0, n, 1] if i is None else list(block(i, n)))
    return out


def scan_index(shape: tuple[int, ...], index: list) -> str:
    """What an index asks for: all, address, point, block, select, gather or grid."""
    from ..plans.array import NDArray

    if not index:
        return "all"
    if len(index) == 1 and isinstance(index[0], Column):
        return "select"
    if len(index) == 1 and isinstance(index[0], NDArray):
        return "select" if index[0].kind == "boolean" else "gather"
    if len(index) == 1 and isinstance(index[0], int) and len(shape) != 1:
        return "address"
    if any(isinstance(i, list) and not (2 <= len(i) <= 3) or isinstance(i, tuple) for i in index):
        return "grid"
    return "point" if all(isinstance(i, int) for i in index) else "block"


def endian() -> str:
    return sys.byteorder


class Access:
    """Methods of NDArray."""

    def __getitem__(self, index):
        """The form of index decides: condition or boolean array, integer array, address, indices, rectangle, or lists of places (tuples) for axes."""
        index = list(index) if isinstance(index, tuple) and any(not isinstance(i, tuple) for i in index) else [index]
        kind = scan_index(self.shape, index)
        if kind == "select":
            return self.compact_select(index[0])
        if kind == "gather":
            return self.gather(index[0])
        if kind in ("address", "point"):
            return self.at(*index)
        if kind == "grid":
            return self.grid(*[list(i) if isinstance(i, tuple) else None if i is None else [i] if isinstance(i, int) else list(range(*i.indices(n))) for i, n in zip(index, self.shape, strict=True)])
        return self.slice(*index)

    def scan_index(self, *index) -> str:
        return scan_index(self.shape, list(index))

    def normalize_index(self, *index) -> list:
        return normalize_index(self.shape, list(index))

    # iteration: a partition is on the driver at a time

    def each(self):
        for r in self.df.select("addr", "v").orderBy("addr").toLocalIterator():
            yield r.v

    def each_with_addr(self):
        for r in self.df.select("addr", "v").orderBy("addr").toLocalIterator():
            yield r.v, r.addr

    def each_addr(self):
        return iter(range(self.elements))

    def each_index(self):
        from itertools import product

        return product(*map(range, self.shape))

    def each_with_index(self):
        for v, addr in self.each_with_addr():
            index = []
            for n in reversed(self.shape):
                index.append(addr % n)
                addr //= n
            yield v, tuple(reversed(index))

    # other types over the same cells

    def fake(self, kind: str):
        """The cells as another type: a lazy cast."""
        return self.as_type(kind)

    def refer(self, kind: str):
        """The bytes of the cells read as another type (little-endian): the last axis grows or shrinks by the widths. Any masked cell masks what it is part of."""
        import numpy as np
        import pyarrow as pa

        kind = canonical(kind)
        source, target = NUMPY[self.kind], NUMPY[kind]
        a, b = int(source[1]), int(target[1])
        last = self.shape[-1] * a
        if last % b:
            raise ValueError("the last axis has no whole number of cells of that type")
        shape = (*self.shape[:-1], last // b)
        if a >= b:
            width, groups = a // b, self.df.select("addr", F.array("v").alias("vs"))
        else:
            width = 1
            at = F.call_function("div", F.col("addr"), F.lit(b // a).cast("bigint"))
            listed = F.transform(F.array_sort(F.collect_list(F.struct("addr", F.col("v").isNull().alias("m"), "v"))), lambda x: x["v"])
            groups = self.df.groupBy(at.alias("addr")).agg(listed.alias("vs"))
        out = {"decimal(20,0)": pa.decimal128(20, 0), "boolean": pa.bool_()}.get(SPARK[kind]) or {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[SPARK[kind]]

        def run(batches):
            for batch in batches:
                addr, cells = [], []
                for k, vs in zip(batch.column("addr").to_pylist(), batch.column("vs").to_pylist(), strict=True):
                    masked = any(v is None for v in vs)
                    got = [None] * (len(vs) * a // b) if masked else np.asarray([int(v) if source[0] in "iu" else v for v in vs]).astype("<" + source).view("<" + target).tolist()
                    addr += [k * width + j for j in range(len(got))]
                    cells += got
                if SPARK[kind] == "boolean":
                    cells = [None if c is None else c != 0 for c in cells]
                if SPARK[kind].startswith("decimal"):
                    from decimal import Decimal

                    cells = [None if c is None else Decimal(c) for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(addr, pa.int64()), pa.array(cells, out)], ["addr", "v"])

        return self.like(groups.mapInArrow(run, f"addr bigint, v {SPARK[kind]}"), shape, kind)

    def to_ca(self):
        """The cells made now, once: written to the shared folder and read again."""
        from ..session import written

        return self.like(written(self.df, "cells"))

    attach = to_ca

    def marshal_dump(self) -> bytes:
        """The container of a small array, as bytes."""
        from ..sources.container import dump_array

        return dump_array(self)

    # deprecated forms

    def replace_value(self, old, new):
        return self.with_value(F.when(F.col("v") == F.lit(old), F.lit(new).cast(SPARK[self.kind])).otherwise(F.col("v")))

    def by(self, other):
        return self.outer(other)

    def asign(self, where: Column, value):
        return self.store(where, value)

    def false(self):
        return self.with_value(F.lit(False), "boolean")

    def true(self):
        return self.with_value(F.lit(True), "boolean")

    def test(self, predicate):
        """predicate: from a column to a boolean column; masked stays masked."""
        return self.convert(predicate, "boolean")

    # reflected operators: a number on the left

    def _left(self, value, name: str):
        return self.with_value(F.when(F.col("v").isNotNull(), F.lit(value).cast(SPARK[self.kind]))).__getattribute__(name)(self)

    def __radd__(self, value):
        return self._left(value, "add")

    def __rsub__(self, value):
        return self._left(value, "sub")

    def __rmul__(self, value):
        return self._left(value, "mul")

    def __rtruediv__(self, value):
        return self._left(value, "div")

    def __rmod__(self, value):
        return self._left(value, "mod")

    def __rpow__(self, value):
        return self._left(value, "pow")

    def __and__(self, other):
        return self.logic("and_", other) if self.kind == "boolean" else self.bitwise("bit_and", other)

    def __or__(self, other):
        return self.logic("or_", other) if self.kind == "boolean" else self.bitwise("bit_or", other)

    def __xor__(self, other):
        return self.logic("xor", other) if self.kind == "boolean" else self.bitwise("bit_xor", other)

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    # what it is

    def address(self):
        """The address of each cell."""
        return self.with_value(F.col("addr"), "int64")

    def index(self, axis: int):
        """The index along one axis of each cell."""
        return self.with_value(self.index_column(axis), "int64")

    @property
    def data_class(self):
        """The record that describes the bytes of a fixlen array, or None."""
        return self.attributes.get("data_class")

    @data_class.setter
    def data_class(self, record) -> None:
        if self.kind != "fixlen":
            raise TypeError("only a fixlen array has a record")
        self.attributes["data_class"] = record

    def has_data_class(self) -> bool:
        return self.data_class is not None

    def is_kind_of(self, type_name: str):
        """Whether each cell's value is of a Spark type, by name; masked stays masked."""
        return self.with_value(F.when(F.col("v").isNotNull(), F.typeof("v") == type_name), "boolean")

    def lineage(self) -> str:
        """The plan that makes the cells."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()


def summation(spark, shape: tuple[int, ...], value):
    """The sum of value(i0, i1, ...) over all indices."""
    from ..plans.array import NDArray

    grid = NDArray.generate(spark, shape, F.lit(0.0)).indexed()
    return grid.agg(F.sum(value(*[F.col(f"i{k}") for k in range(len(shape))]).cast("double")).alias("v"))
