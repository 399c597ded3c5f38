"""Records: C-like layouts as struct types, and their bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import SPARK, canonical

#: struct codes of element types; fixed values.
CODES = {"boolean": "b", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float32": "f", "float64": "d"}


class Record:
    """Members in order, each (name, type), (name, type, count) or (name, Record); chars are ("name", "fixlen", bytes)."""

    def __init__(self, *members, pack: int | None = None, size: int | None = None, union: bool = False) -> None:
        self.members, self.union, offset, self.offsets, widest = members, union, 0, {}, 1
        for name, kind, *n in members:
            width, align = self._width(kind, n)
            align = min(align, pack) if pack else align
            offset = -(-offset // align) * align if not union else 0
            self.offsets[name] = offset
            widest = max(widest, align)
            offset += width
        whole = max((self.offsets[m[0]] + self._width(m[1], m[2:])[0] for m in members), default=0)
        self.align = widest
        self.size = size or -(-whole // widest) * widest
        if self.size < whole:
            raise ValueError("members exceed the size")

    @staticmethod
    def _width(kind, n) -> tuple[int, int]:
        if isinstance(kind, Record):
            return kind.size, kind.align
        if kind == "fixlen":
            return n[0], 1
        one = struct.calcsize("<" + CODES[canonical(kind)])
        return one * (n[0] if n else 1), one

    def fields(self) -> list[str]:
        return [m[0] for m in self.members]

    def ddl(self) -> str:
        out = []
        for name, kind, *n in self.members:
            t = kind.ddl() if isinstance(kind, Record) else "binary" if kind == "fixlen" else SPARK[canonical(kind)]
            out.append(f"{name}:{f'array<{t}>' if n and kind != 'fixlen' and not isinstance(kind, Record) else t}")
        return f"struct<{','.join(out)}>"

    def decode(self, raw: bytes, base: int = 0, order: str = "<") -> dict:
        out = {}
        for name, kind, *n in self.members:
            at = base + self.offsets[name]
            if isinstance(kind, Record):
                out[name] = kind.decode(raw, at, order)
            elif kind == "fixlen":
                out[name] = bytes(raw[at : at + n[0]])
            else:
                got = struct.unpack_from(f"{order}{n[0] if n else 1}{CODES[canonical(kind)]}", raw, at)
                out[name] = list(got) if n else got[0]
        return out

    def encode(self, values: dict, order: str = "<") -> bytes:
        out = bytearray(self.size)
        for name, kind, *n in self.members:
            if name not in values:
                continue
            at, v = self.offsets[name], values[name]
            if isinstance(kind, Record):
                out[at : at + kind.size] = kind.encode(v, order)
            elif kind == "fixlen":
                out[at : at + n[0]] = v[: n[0]].ljust(n[0], b"\0")
            else:
                struct.pack_into(f"{order}{n[0] if n else 1}{CODES[canonical(kind)]}", out, at, *(v if n else [v]))
        return bytes(out)

    def decode_column(self, df: DataFrame, raw: str, order: str = "<") -> DataFrame:
        """df with the binary column decoded into a struct, in Arrow batches."""
        record = self

        @F.pandas_udf(self.ddl())
        def run(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([record.decode(x, 0, order) if x is not None else {} for x in column], columns=record.fields())

        return df.withColumn(raw, F.when(F.col(raw).isNotNull(), run(F.col(raw))))


def field(column: Column, name: str) -> Column:
    return column[name]


def members(df: DataFrame, column: str = "v") -> DataFrame:
    """The members of a struct column as columns."""
    return df.select("addr", f"{column}.*")
