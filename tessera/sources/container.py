"""The binary array container: a 256-byte header, raw values, and an int8 mask.

Reading takes files through Spark's binaryFile source and cuts them into cells in Arrow batches. A container is one file with
the values and then the mask, so writing it streams the array through the driver in the order of addresses, one stretch
at a time, into any store that Spark reaches; save_parts writes a container for each stretch in tasks instead. Object
arrays and attributes are language-native pickles in the format and are not read.
"""

from __future__ import annotations

import struct
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import SPARK

#: Bytes of an element, type numbers and numpy types; fixed values of the format.
WIDTH = {"fixlen": 0, "boolean": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "int64": 8, "uint64": 8, "float32": 4, "float64": 8, "cmplx64": 8, "cmplx128": 16, "object": 8}
NUMBER = {"fixlen": 0, "boolean": 1, "int8": 2, "uint8": 3, "int16": 4, "uint16": 5, "int32": 6, "uint32": 7, "int64": 8, "uint64": 9, "float32": 10, "float64": 11, "cmplx64": 13, "cmplx128": 14, "object": 16}
NUMPY = {"boolean": "i1", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float32": "f4", "float64": "f8"}
#: magic, type name, byte order, type number, bytes of an element, axes, cells, mask, lengths of 16 axes, attributes, data class
HEADER, HEADER_BYTES = "8s8s4siqiqi16qii", 256
DEFAULT_MAGIC = b"_TESSER_"


def dump(values: np.ndarray, kind: str, mask: np.ndarray | None = None, magic: bytes = DEFAULT_MAGIC, order: str = "<") -> bytes:
    """A container of the values. magic: eight bytes that begin and end with an underscore."""
    out = header(kind, values.shape, mask is not None, magic, order) + values.astype(order + NUMPY[kind]).tobytes()
    return out + (mask.astype(np.int8).tobytes() if mask is not None else b"")


def load(raw: bytes) -> tuple[np.ndarray, str, np.ndarray | None]:
    """Values, type name and mask."""
    if len(raw) < HEADER_BYTES or raw[:1] != b"_" or raw[7:8] != b"_":
        raise ValueError("not a binary array container")
    order = {b"_LE_": "<", b"_BE_": ">"}.get(raw[16:20])
    if order is None:
        raise ValueError("unknown byte order")
    _, name, _, _, _, ndim, n, masked, *rest = struct.unpack_from(order + HEADER, raw)
    kind, shape = name.decode().strip("\0 "), rest[:ndim]
    if kind not in NUMPY:
        raise ValueError(f"values of type {kind} can't be read")
    at = HEADER_BYTES + n * WIDTH[kind]
    values = np.frombuffer(raw[HEADER_BYTES:at], order + NUMPY[kind]).reshape(shape)
    mask = np.frombuffer(raw[at : at + n], np.int8).reshape(shape).astype(bool) if masked else None
    return values, kind, mask


def read(spark: SparkSession, path: str, kind: str = "float64") -> DataFrame:
    """path, addr, v of all containers that match the path."""
    import pandas as pd

    def cells(batches):
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                values, _, mask = load(bytes(raw))
                v = pd.Series(values.ravel(), dtype="object")
                if mask is not None:
                    v[mask.ravel()] = None
                yield pd.DataFrame({"path": p, "addr": np.arange(values.size), "v": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, f"path string, addr bigint, v {SPARK[kind]}")


def stretches(a, cells: int = 1 << 20):
    """Values (masked ones are 0) and masks of an array in the order of addresses, a stretch at a time."""
    listed = a.df.select("addr", "v").repartitionByRange(max(1, -(-a.elements // cells)), "addr").sortWithinPartitions("addr")
    held: list[tuple] = []
    for r in listed.toLocalIterator():  # a partition is on the driver at a time
        held.append(r.v)
        if len(held) == cells:
            yield _arrays(held, a.kind)
            held = []
    if held:
        yield _arrays(held, a.kind)


def _arrays(cells: list, kind: str) -> tuple[np.ndarray, np.ndarray]:
    mask = np.asarray([c is None for c in cells])
    return np.asarray([0 if c is None else int(c) if NUMPY[kind][0] in "iu" else c for c in cells]).astype(NUMPY[kind]), mask


def header(kind: str, shape: tuple[int, ...], masked: bool, magic: bytes = DEFAULT_MAGIC, order: str = "<") -> bytes:
    dims = [*shape, *[0] * (16 - len(shape))]
    return struct.pack(order + HEADER, magic, kind.ljust(8).encode(), b"_LE_" if order == "<" else b"_BE_", NUMBER[kind], WIDTH[kind], len(shape), prod(shape), int(masked), *dims, 0, 0).ljust(HEADER_BYTES, b"\0")


def dump_array(a, magic: bytes = DEFAULT_MAGIC, order: str = "<") -> bytes:
    """The container of a small array."""
    values, mask = (np.concatenate(x) for x in zip(*stretches(a), strict=True))
    return dump(values.reshape(a.shape), a.kind, mask.reshape(a.shape) if mask.any() else None, magic, order)


def save(a, path: str, magic: bytes = DEFAULT_MAGIC, order: str = "<") -> None:
    """Writes an array as one container, through Spark's file systems. Masks are kept as bits on the way."""
    spark = a.spark
    masked = bool(a.df.where("v is null").limit(1).count())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(header(a.kind, a.shape, masked, magic, order)))
        masks = []
        for values, mask in stretches(a):
            out.write(bytearray(values.astype(order + NUMPY[a.kind]).tobytes()))
            masks.append((np.packbits(mask), len(mask)))
        for bits, n in masks if masked else []:
            out.write(bytearray(np.unpackbits(bits, count=n).astype(np.int8).tobytes()))
    finally:
        out.close()


def save_parts(a, path: str, cells: int = 1 << 22, magic: bytes = DEFAULT_MAGIC, order: str = "<") -> DataFrame:
    """part, first, n, raw: a container (a vector) for each stretch of addresses, made in tasks and written as Parquet at the path."""
    kind = a.kind

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("addr")
        values, mask = _arrays([None if v is None or v != v and kind not in ("float32", "float64") else v for v in pdf["v"].tolist()], kind)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "first": [pdf["addr"].iloc[0]], "n": [len(pdf)], "raw": [dump(values, kind, mask if mask.any() else None, magic, order)]})

    cast = F.col("v").cast("string") if kind == "uint64" else F.col("v")
    own = a.df.select("addr", cast.alias("v"), F.floor(F.col("addr") / cells).cast("bigint").alias("part"))
    own.groupBy("part").applyInPandas(run, "part bigint, first bigint, n bigint, raw binary").write.parquet(path)
    return a.spark.read.parquet(path)


def load_parts(spark: SparkSession, path: str, shape: tuple[int, ...], kind: str = "float64"):
    """The array that save_parts wrote."""
    from ..plans.array import NDArray

    def cells(batches):
        import pandas as pd

        for pdf in batches:
            for first, raw in zip(pdf["first"], pdf["raw"], strict=True):
                values, _, mask = load(bytes(raw))
                v = pd.Series(values.ravel(), dtype="object")
                if mask is not None:
                    v[mask.ravel()] = None
                yield pd.DataFrame({"addr": np.arange(first, first + values.size), "v": v})

    return NDArray(spark.read.parquet(path).select("first", "raw").mapInPandas(cells, f"addr bigint, v {SPARK[kind]}"), shape, kind)


def to_binary(a, order: str = "<") -> bytes:
    """Raw element bytes of a small array in the order of addresses; masked cells are 0."""
    return b"".join(values.astype(order + NUMPY[a.kind]).tobytes() for values, _ in stretches(a))


def from_binary(spark: SparkSession, raw: bytes, shape: tuple[int, ...], kind: str, order: str = "<"):
    from ..plans.array import NDArray

    values = np.frombuffer(raw, order + NUMPY[kind])[: prod(shape)]
    return NDArray(spark.createDataFrame(list(enumerate(values.tolist())), f"addr bigint, v {SPARK[kind]}"), shape, kind)
