"""User functions over cells and groups, vectorised through Arrow; masked cells are skipped and stay masked."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import SPARK, canonical


def map_values(a, f: Callable, kind: str | None = None):
    """f: numpy values to numpy values, for batches of valid cells."""
    kind = canonical(kind or a.kind)

    @F.pandas_udf(SPARK[kind])
    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="object")
        ok = v.notna().to_numpy()
        out[ok] = f(v[ok].to_numpy())
        return out

    return a.like(a.df.select("addr", run("v").alias("v")), kind=kind)


def map_with_addr(a, f: Callable, kind: str | None = None):
    """f: values and addresses to values."""
    kind = canonical(kind or a.kind)

    @F.pandas_udf(SPARK[kind])
    def run(v: pd.Series, addr: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="object")
        ok = v.notna().to_numpy()
        out[ok] = f(v[ok].to_numpy(), addr[ok].to_numpy())
        return out

    return a.like(a.df.select("addr", run("v", "addr").alias("v")), kind=kind)


def outputs(a, f: Callable, names: list[str], *others) -> DataFrame:
    """f: the values of several arrays to several outputs (a dict of numpy values); masked in any is masked in all."""
    df = a.df.select("addr", F.col("v").cast("double").alias("x0"))
    for k, o in enumerate(others, 1):
        df = df.join(o.df.select("addr", F.col("v").cast("double").alias(f"x{k}")), "addr")
    inputs = [f"x{k}" for k in range(len(others) + 1)]

    @F.pandas_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def run(*columns: pd.Series) -> pd.DataFrame:
        whole = pd.concat(columns, axis=1)
        ok = whole.notna().all(axis=1).to_numpy()
        out = pd.DataFrame({n: pd.Series([None] * len(whole), dtype="object") for n in names})
        got = f(*[c[ok].to_numpy() for c in columns])
        for n in names:
            out.loc[ok, n] = got[n]
        return out

    return df.select("addr", run(*inputs).alias("r")).select("addr", "r.*")


def calculate(a, axes: tuple[int, ...], f: Callable) -> DataFrame:
    """f: the ordered values of a group to one number; a group is an index of the given axes and must fit in a task."""
    keys = [f"i{k}" for k in axes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].head(1).assign(v=float(f(pdf.sort_values("addr")["v"].to_numpy())))

    return a.indexed().select("addr", "v", *keys).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", v double")


def filter_groups(a, axes: tuple[int, ...], f: Callable):
    """f: the ordered values of a group to as many values."""
    keys = [f"i{k}" for k in axes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("addr")
        return pd.DataFrame({"addr": pdf["addr"], "v": f(pdf["v"].to_numpy())})

    return a.like(a.indexed().select("addr", "v", *keys).groupBy(*keys).applyInPandas(run, "addr bigint, v double"), kind="float64")


def inject(a, init: float, step: str) -> DataFrame:
    """A fold over all cells in their order: step is SQL on acc and x. The cells come together in one array: for small arrays."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("addr", F.col("v").cast("double").alias("v")))), lambda s: s["v"])
    return a.df.agg(listed.alias("l")).select(F.expr(f"aggregate(l, cast({init} as double), (acc, x) -> cast({step} as double))").alias("v"))
