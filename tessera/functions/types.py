"""Element types: Spark types, promotion by rank, C-like casts and wrapping integers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In order of rank. An operation on two types has the higher one.
RANK = ["boolean", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "cmplx64", "cmplx128", "object"]
SPARK = {
    "boolean": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint",
    "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double",
    "cmplx64": "struct<re:double,im:double>", "cmplx128": "struct<re:double,im:double>", "object": "string", "fixlen": "binary",
}
ALIASES = {"byte": "uint8", "short": "int16", "int": "int32", "float": "float32", "double": "float64", "complex": "cmplx64", "dcomplex": "cmplx128"}
BITS = {"int8": 8, "uint8": 8, "int16": 16, "uint16": 16, "int32": 32, "uint32": 32, "int64": 64, "uint64": 64}


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in SPARK:
        raise ValueError(f"unknown element type {name}")
    return name


def is_integer(name: str) -> bool:
    return canonical(name) in BITS


def is_unsigned(name: str) -> bool:
    return canonical(name).startswith("uint")


def is_float(name: str) -> bool:
    return canonical(name).startswith("float")


def is_complex(name: str) -> bool:
    return canonical(name).startswith("cmplx")


def is_numeric(name: str) -> bool:
    return is_integer(name) or is_float(name) or is_complex(name)


def promote(a: str, b: str, scalar: bool = False) -> str:
    """Type of an operation on arrays of types a and b; with scalar, b is a scalar, which takes the array's type unless its kind is higher."""
    a, b = canonical(a), canonical(b)
    if "fixlen" in (a, b):
        if a == b:
            return a
        if "object" in (a, b):
            return "object"
        raise TypeError(f"{a} and {b} don't mix")
    kind = lambda t: 0 if t == "boolean" else 1 if is_integer(t) else 2 if is_float(t) else 3 if is_complex(t) else 4
    if scalar and kind(b) <= kind(a):
        return a
    return max(a, b, key=RANK.index)


def wrap(value: Column, name: str) -> Column:
    """An exact integer (bigint or decimal) folded into the range of the type, modulo 2 to its bits."""
    name = canonical(name)
    n = BITS[name]
    wide = value.cast("decimal(38,0)")
    size = F.lit(Decimal(2**n)).cast("decimal(38,0)")
    if is_unsigned(name):
        return F.pmod(wide, size).cast(SPARK[name])
    half = F.lit(Decimal(2 ** (n - 1))).cast("decimal(38,0)")
    return (F.pmod(wide + half, size) - half).cast(SPARK[name])


def cast(value: Column, to: str, source: str) -> Column:
    """C-like cast: floats are cut towards zero, integers wrap, any number but 0 is true, complex keeps its real part."""
    to, source = canonical(to), canonical(source)
    if to == source:
        return value
    if is_complex(to):
        if is_complex(source):
            return value
        return F.when(value.isNotNull(), F.struct(value.cast("double").alias("re"), F.lit(0.0).alias("im")))
    if is_complex(source):
        return cast(value["re"], to, "float64")
    if to == "boolean" and is_numeric(source):
        return value != 0
    if source == "boolean" and is_numeric(to):
        return value.cast("int").cast(SPARK[to])
    if to in BITS and (is_integer(source) or is_float(source)):
        if is_float(source):
            whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
            value = F.when(F.isnan(value) | (F.abs(value) >= 1e18), F.lit(None)).otherwise(whole)
        return wrap(value, to)
    if to == "fixlen":
        return F.encode(value.cast("string"), "UTF-8")
    return value.cast(SPARK[to])
