"""Small literal arrays with known results, and the rules where a plain Spark expression would differ."""

import datetime
import math
import os
import subprocess
import sys

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import strings as T
from tessera.functions.types import cast, promote, wrap
from tessera.operators import compose, create, groups, lookup, prefix
from tessera.operators.records import Record
from tessera.plans.array import NDArray
from tessera.sources import container, files

N = None


@pytest.fixture
def arr(spark):
    return lambda nested, kind=None: NDArray.from_list(spark, nested, kind)


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()[0]


def test_reductions(arr):
    a = arr(list(range(1, 11)))
    want = {"sum": 55.0, "mean": 5.5, "variancep": 8.25, "variance": 82.5 / 9, "min": 1, "max": 10, "count_valid": 10, "prod": float(math.factorial(10)), "median": 5.5}
    for name, v in want.items():
        assert a.stat(name).scalar() == pytest.approx(v)
    m = arr([N, *range(2, 10), N])
    assert (m.sum().scalar(), m.min().scalar(), m.max().scalar(), m.mean().scalar()) == (44.0, 2, 9, 5.5)
    assert [m.sum(mask_limit=k, fill_value=-9999.0).scalar() for k in (0, 1, 2, 3)] == [44.0, -9999.0, -9999.0, 44.0]
    assert [m.sum(min_count=k).scalar() for k in (8, 9)] == [44.0, None]
    assert arr([N, N], "int32").count_valid().scalar() is None and arr([N, N], "boolean").count_true().scalar() == 0
    assert math.isnan(arr([3.0]).variance().scalar())
    with pytest.raises(ValueError):
        m.sum(mask_limit=1, min_count=1)


def test_weights(arr):
    a, w = arr(list(range(1, 11))), arr(list(range(10, 0, -1)))
    assert a.wmean(w).first()[0] == pytest.approx(4.0)
    assert arr([N, *range(2, 11)]).wmean(arr([*range(10, 1, -1), N])).first()[0] == pytest.approx(200 / 44)


def test_accumulate_wraps(spark):
    for kind, n, v in (("uint8", 255, 255), ("uint8", 256, 0), ("int8", 127, 127), ("int8", 128, -128), ("int8", 255, -1), ("int8", 256, 0)):
        assert create.ones(spark, n, kind=kind).accumulate().scalar() == v


def test_addresses_of_extremes(arr):
    assert arr([8, 7, 6, 5, 4, 5, 6, 7, 8]).min_addr().scalar() == 4
    assert arr([1, 1, 1, 2, 2, 2, 3, 3, 3]).min_addr().scalar() == 0
    assert arr([1, 3, 3, 2]).max_addr().scalar() == 1
    assert arr([N, 2, 3]).min_addr().scalar() == 1 and arr([N, 2, 3]).min_addr(mask_limit=1).scalar() is None
    nan = float("nan")
    assert arr([1.0, nan, 3.0]).max().scalar() == 3.0 and math.isnan(arr([nan, nan]).max().scalar())


def test_counts(arr):
    a = arr([0, 1, 1, 1, 2, 2, 2, 2, 3, 3])
    assert [a.count_equal(k).scalar() for k in (0, 1, 2, 3, 4)] == [1, 3, 4, 2, 0]
    b = arr([k + 0.00005 for k in (0, 1, 1, 1)])
    assert b.count_close(1, 0.0001).scalar() == 3 and b.count_equiv(1, 0.001).scalar() == 3


def test_cumulative(arr):
    assert arr(list(range(1, 6))).cumprod().values() == [1, 2, 6, 24, 120]
    assert arr([N, N, 3, N, 1]).cumsum().values() == [0, 0, 3, 3, 4]
    assert arr([N, 3, N, 1]).cumprod().values() == [1, 3, 3, 3]
    assert arr([N, 3.0, 5.0, 1.0]).cummin().values() == [3, 3, 3, 1] and arr([N, 3, 5, 1]).cummax().values() == [3, 3, 5, 5]
    assert arr([N, 3, 5, 1]).cumcount().values() == [0, 1, 2, 3]
    assert arr([[1, 2], [3, N]]).dimcumsum(1).values() == [1, 3, 3, 3]


def test_running_values_over_many_stretches(spark):
    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.3 else int(x) for x in rng.integers(-9, 9, 200)]
    df = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)], "addr bigint, v bigint, g int").repartition(5)
    got = prefix.running(df, 200, {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "m": ("min", F.col("v")), "l": ("last", F.col("v"))}, stretch=17).orderBy("addr").collect()
    for i, r in enumerate(got):
        some = [x for x in v[: i + 1] if x is not None]
        assert (r.s, r.c, r.m, r.l) == ((sum(some), len(some), min(some), some[-1]) if some else (None, 0, None, None))
    got = prefix.running(df, 200, {"s": ("sum", F.col("v"))}, ("g",), stretch=17).collect()
    for r in got:
        some = [x for j, x in enumerate(v[: r.addr + 1]) if x is not None and j % 3 == r.g]
        assert r.s == (sum(some) if some else None)


def test_running_values_over_two_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix, "MOST_TOTALS", 3)
    monkeypatch.setattr(prefix, "MOST_STRETCH", 4)
    monkeypatch.setattr(prefix, "LEAST_STRETCH", 4)
    rng = np.random.default_rng(5)
    v = [None if rng.random() < 0.3 else int(x) for x in rng.integers(-9, 9, 150)]
    df = spark.createDataFrame([(i, x, i // 30 % 2) for i, x in enumerate(v)], "addr bigint, v bigint, g int")
    for by in ((), ("g",)):
        got = prefix.running(df, 150, {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, by).collect()
        assert len(got) == 150
        for r in got:
            some = [x for j, x in enumerate(v[: r.addr + 1]) if x is not None and (not by or j // 30 % 2 == r.g)]
            assert (r.s, r.c, r.m, r.l) == ((sum(some), len(some), max(some), some[-1]) if some else (None, 0, None, None))


@pytest.mark.parametrize("down", [False, True])
def test_ranks_over_many_stretches(spark, down, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_RANGE", 40)
    rng = np.random.default_rng(2)
    v = [None if x == 0 else (5 if x < 30 else int(x)) for x in rng.integers(0, 90, 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "addr bigint, v bigint").repartition(5)
    got = {r.addr: r["rank"] for r in prefix.ranked(df, [("v", down), ("addr", down)], 500).collect()}
    sign = -1 if down else 1
    want = sorted(range(500), key=lambda i: (v[i] is None, sign * (v[i] or 0), sign * i))
    assert [got[i] for i in want] == list(range(500))


def test_order(arr):
    a = arr([[5, 4, 3], [0, 1, 2], [8, 7, 6]])
    assert a.sort().values() == list(range(9))
    assert [r.source for r in a.sort_addr().orderBy("addr").collect()] == [3, 4, 5, 2, 1, 0, 8, 7, 6]
    assert arr([3, N, 1, N, 2]).sort().values() == [1, N, 2, N, 3]
    assert arr([2, 1, 2, N]).order().values() == [1, 0, 2, N] and arr([2, 1, 2, N]).order(-1).values() == [1, 2, 0, N]
    x, y, z = arr([3, 2, 4, 1]), arr([13, 12, 14, 11]), arr([23, 22, 24, 21])
    assert [tuple(r)[1:] for r in x.sort_with(y, z).orderBy("addr").collect()] == [(1, 11, 21), (2, 12, 22), (3, 13, 23), (4, 14, 24)]
    assert tuple(x.max_with(y, z).first()) == (4, 14, 24)
    assert [r.v for r in arr([3, 1, 3, 2]).nlargest(3).collect()] == [3, 3, 2]
    assert arr([1, 2, 3]).reverse().values() == [3, 2, 1]


def test_search_and_lookup(arr):
    a = arr([[9 * i + j for j in range(9)] for i in range(9)])
    assert a.search(50).first()[0] == 50 and a.search(81).first()[0] is None and a.search_nearest(50.5).first()[0] == 50
    assert arr([5, 7, N, 9]).matchup(arr([9, 5, 5])).values() == [1, N, N, 0]
    s = arr([0.0, 1.0, 3.0, 7.0])
    assert s.section(arr([-1.0, 0.5, 2.0, 7.0, 11.0])).values() == pytest.approx([-1, 0.5, 1.5, 3, 4])
    assert arr([0, 2, 4]).section(arr([1.0, 3.0, 4.0])).values() == [0, 1, 2]
    assert arr([0.0, 4.0, 2.0]).section_linear(arr([1.0, 3.0, 9.0, N])).values() == [0.25, 0.75, -1, N]
    data = arr([[11, 22, 33], [44, N, 66], [77, 88, 99]])
    assert data.project(arr([0, 4, -1, 9, N], "int64"), -999, 999).values() == [11, N, -999, 999, N]
    assert data.project(arr([0, -1, 9], "int64")).values() == [11, N, N]
    assert data.gather(arr([0, -1], "int64")).values() == [11, 99]
    for bad in ([9], [N]):
        with pytest.raises(Exception, match="index"):
            data.gather(arr(bad, "int64")).values()
    assert arr([1.0, 3.0, 5.0]).fetch_linear_addr(arr([0.5, 2.0, 2.5])).values() == [2.0, 5.0, N]


def test_asof_both_ways(spark, monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_RANGE", 2000)
    rng = np.random.default_rng(3)
    left = [(i, int(t)) for i, t in enumerate(rng.integers(0, 500, 80))]
    right = [(100 + i, int(t)) for i, t in enumerate(rng.permutation(500)[:60])]
    a, b = spark.createDataFrame(left, "addr bigint, t bigint"), spark.createDataFrame(right, "addr bigint, t bigint")
    for n in (10, 200_000):  # one stretch, and many
        back = {r.addr: r.found for r in lookup.asof(a, b, "t", n=n).collect()}
        ahead = {r.addr: r.found for r in lookup.asof(a, b, "t", direction="forward", n=n).collect()}
        for i, t in left:
            before, after = [x for x in right if x[1] <= t], [x for x in right if x[1] >= t]
            assert back[i] == (max(before, key=lambda x: x[1])[0] if before else None)
            assert ahead[i] == (min(after, key=lambda x: x[1])[0] if after else None)


def test_shapes_and_blocks(arr):
    a = arr([[4 * i + j for j in range(4)] for i in range(4)])
    assert a.block_stat("sum", 2, 2).values() == [10, 18, 42, 50] and a.block_pick(0, 2, 2).values() == [0, 2, 8, 10]
    assert a.slice(slice(0, 2), slice(0, 2)).values() == [0, 1, 4, 5] and a.slice(1, None).values() == [4, 5, 6, 7]
    assert a.transpose().to_list()[0] == [0, 4, 8, 12] and a.reshape(2, -1).shape == (2, 8) and a.at(-1, -1).scalar() == 15
    assert arr([[1, 2]]).broadcast_to(2, 2).to_list() == [[1, 2], [1, 2]]
    with pytest.raises(ValueError):
        arr([[1, 2, 3]]).broadcast_to(3, 2)
    assert compose.bind([a, a]).shape == (8, 4) and compose.merge([a, a]).shape == (4, 4, 2)
    assert compose.composite((2, 2), [arr([[k, k], [k, k]]) for k in (1, 2, 3, 4)]).shape == (2, 2, 2, 2)
    g = arr([[0, 1, 2], [3, 4, 5], [6, 7, 8]])
    assert g.grid([1, 2, 0], None).to_list() == [[3, 4, 5], [6, 7, 8], [0, 1, 2]] and g.grid([-1, -2], [0, N]).values() == [6, 3]
    assert arr([0, 1, 2]).pull(None, 2).to_list() == [[0, 0], [1, 1], [2, 2]] and arr([0, 1, 2]).pull(2, None).to_list() == [[0, 1, 2]] * 2
    assert arr([1, 2, 3]).resize(-5).values() == [0, 0, 1, 2, 3] and arr([1, 2, 3]).resize(2).values() == [1, 2]


def test_windows(arr):
    g = arr([[0, 1, 2], [3, 4, 5], [6, 7, 8]])
    assert g.window((-1, 1), (-1, 1)).to_list() == [[0, 0, 0], [0, 0, 1], [0, 3, 4]]
    assert g.window((-1, 1), (-1, 1), bounds="mask").values()[:3] == [N, N, N]
    v = arr([1, 2, 3, 4])
    assert v.windows("sum", (-1, 1)).values() == [3, 6, 9, 7] and v.windows("sum", (-1, 1), bounds="periodic").values() == [7, 6, 9, 8]
    assert v.windows("sum", (-1, 1), bounds="nearest").values() == [4, 6, 9, 11] and v.windows("sum", (-1, 1), bounds="reflect").values() == [4, 6, 9, 11]
    assert v.shifted(1).values() == [0, 1, 2, 3] and v.shifted(-1, fill_value=N).values() == [2, 3, 4, N] and v.roll(1).values() == [4, 1, 2, 3]
    assert v.convolve([1.0, 0.0, -1.0], -1).values() == [-2, -2, -2, 3]


def test_masks(arr):
    a = arr([0, 1, 2]).with_mask(F.col("addr") == 1)
    assert a.values() == [0, N, 2] and a.unmask().values() == [0, 1, 2] and a.unmask(-1).values() == [0, -1, 2]
    assert a.invert_mask().values() == [N, 1, N] and a.maskout(value=2).values() == [0, N, N]
    assert (a + arr([N, 1, 1], "int64")).values() == [N, N, 3]
    assert a.equals(arr([0, N, 2])).first()[0] and not a.equals(arr([0, 1, 2])).first()[0]
    assert a.inherit_mask(arr([1, 1, N])).values() == [0, N, N]


def test_element_rules(spark):
    null = F.lit(None).cast("boolean")
    nan, inf = float("nan"), float("inf")
    assert one(spark, S.logical_and(F.lit(False), null)) is None and one(spark, S.logical_or(F.lit(True), null)) is None
    assert one(spark, S.eq(F.lit(nan), F.lit(nan))) is False and one(spark, S.pmax(F.lit(nan), F.lit(1.0))) == 1.0
    assert one(spark, S.pmax(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert one(spark, S.div(1.0, 0.0)) == inf and one(spark, S.div(-1.0, 0.0)) == -inf and math.isnan(one(spark, S.div(0.0, 0.0)))
    with pytest.raises(Exception, match="divided by 0"):
        spark.range(1).select(S.int_div(F.lit(1), F.lit(0))).collect()
    assert one(spark, S.log(F.lit(0.0))) == -inf and math.isnan(one(spark, S.log(F.lit(-1.0)))) and math.isnan(one(spark, S.UNARY["sqrt"](F.lit(-1.0))))
    assert one(spark, S.rounded(F.lit(-2.5))) == -3.0 and one(spark, S.mod(F.lit(-7), F.lit(2))) == -1 and one(spark, S.remainder(F.lit(5.0), F.lit(3.0))) == -1.0
    assert one(spark, S.deg_360(F.lit(-360.0))) == 360.0 and one(spark, S.deg_180(F.lit(-180.0))) == 180.0
    assert one(spark, S.trim(F.lit(10), 0, 10)) == 10 and one(spark, S.trim(F.lit(10), 0, 10, -1)) == -1
    assert one(spark, wrap(F.lit(128), "int8")) == -128 and one(spark, cast(F.lit(-1.5), "uint8", "float64")) == 255
    assert one(spark, S.swap_bytes(F.lit(0x0102), 2)) == 0x0201
    assert promote("int32", "uint32") == "uint32" and promote("int64", "float32") == "float32" and promote("int8", "int64", scalar=True) == "int8" and promote("int8", "float64", scalar=True) == "float64"


def test_array_arithmetic(arr):
    a = arr([100, 27, -128], "int8")
    assert (a + arr([100, 100, -1], "int8")).values() == [-56, 127, 127] and (a * 2).values() == [-56, 54, 0]
    assert (arr([7, -7]) / 2).values() == [3, -3] and (arr([7.0, 0.0]) / 0.0).values()[0] == float("inf")
    assert (arr([2, 3]) ** 3).values() == [8, 27] and arr([-5, 5]).apply("abs").values() == [5, 5]
    with pytest.raises(ValueError):
        arr([1, 2]) + arr([1, 2, 3])


def test_generators(spark):
    assert create.linspace(spark, 0, 1, 5).values() == [0, 0.25, 0.5, 0.75, 1] and create.arange(spark, 3).values() == [0, 1, 2]
    assert create.span(spark, 1, 5, exclude_end=True).values() == [1, 2, 3, 4] and create.eye(spark, 2).to_list() == [[1, 0], [0, 1]]
    assert create.zeros(spark, 10, kind="int32").span(1, 5).values() == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert create.zeros(spark, 11).span(0, 5).values() == [k / 2 for k in range(11)]
    assert create.zeros(spark, 4, kind="int32").seq(0, 0.5).values() == [0, 0, 1, 1]
    assert create.parse("1 2, 3; _ 5 6", "int32") == [[1, 2, 3], [None, 5, 6]] and create.guess_shape([[1, 2], [3]]) == (2,)
    assert create.recurrence(spark, 6, [0, 1], "element_at(a, -1) + element_at(a, -2)").values() == [0, 1, 1, 2, 3, 5]


def test_bins(spark, arr):
    v = arr([-1.0, 0.0, 9.9, 10.0, 20.0, 25.0])
    bins = lambda **o: [r.b for r in v.df.select("addr", groups.bin_of(F.col("v"), [0, 10, 20], **o).alias("b")).orderBy("addr").collect()]
    assert bins() == [None, 0, 0, 1, 2, 2] and bins(offset=1) == [0, 1, 1, 2, 3, 3]
    assert bins(include_upper=True) == [None, None, 0, 0, 1, 2] and bins(include_upper=True, include_lowest=True)[1] == 0
    assert {r["class"]: r.n for r in arr([3, 1, 3, N]).classes().collect()} == {3: 2, 1: 1}
    assert arr([0, 0, 0]).incr_addr(arr([1, 1, 2, N])).values() == [0, 2, 1]


def test_strings(spark):
    for value, want in ((T.sub(F.lit("xaya"), "a", "Z"), "xZya"), (T.capitalize(F.lit("fOO bar")), "Foo bar"), (T.swapcase(F.lit("aB")), "Ab"), (T.rindex(F.lit("hello"), "l"), 3), (T.center(F.lit("ab"), 5, "*"), "*ab**"), (T.ljust(F.lit("abcdef"), 3), "abcdef"), (T.to_i(F.lit(" -12x")), -12), (T.to_f(F.lit("x")), 0.0), (T.chop(F.lit("a\r\n")), "a"), (T.chomp(F.lit("a\n\n")), "a\n"), (T.extract(F.lit("k=v"), r"(\w)=(\w)", r"\2:\1"), "v:k"), (T.index(F.lit("abc"), "z"), None)):
        assert one(spark, value) == want


def test_records_and_containers(spark, arr, tmp_path):
    inner = Record(("mem_i", "uint16"), ("mem_f", "fixlen", 3), pack=1)
    outer = Record(("mem_i", "uint16"), ("mem_f", "fixlen", 3), ("mem_s", inner), pack=1)
    raw = outer.encode({"mem_i": 258, "mem_f": b"ab", "mem_s": {"mem_i": 1, "mem_f": b"xyz"}})
    assert inner.size == 5 and outer.size == 10 and raw[:5] == b"\x02\x01ab\0"
    assert outer.decode(raw)["mem_s"] == {"mem_i": 1, "mem_f": b"xyz"}
    assert Record(("a", "int8"), ("b", "int32")).offsets == {"a": 0, "b": 4} and Record(("a", "int8"), ("b", "int32"), union=True).size == 4
    values = np.arange(6, dtype="f4").reshape(2, 3)
    for order in "<>":
        back, kind, mask = container.load(container.dump(values, "float32", values > 3, order=order))
        assert kind == "float32" and (back == values).all() and (mask == (values > 3)).all()
    with pytest.raises(ValueError):
        container.load(bytes(300))
    a = arr([[1.5, N], [2.5, 3.5]])
    container.save(a, str(tmp_path / "a.bin"))
    assert [r.v for r in container.read(spark, str(tmp_path / "a.bin")).orderBy("addr").collect()] == [1.5, N, 2.5, 3.5]
    a.attributes["unit"] = "m"
    files.save(a, str(tmp_path / "a.parquet"))
    again = files.load(spark, str(tmp_path / "a.parquet"))
    assert again.shape == (2, 2) and again.attributes == {"unit": "m"} and again.values() == [1.5, N, 2.5, 3.5]
    assert container.from_binary(spark, container.to_binary(arr([1, 2, 3])), (3,), "int64").values() == [1, 2, 3]


def test_random_arrays_as_numpy(arr):
    rng = np.random.default_rng(5)
    for _ in range(2):
        v = rng.normal(0, 10, (6, 7)).round(3)
        m = rng.random((6, 7)) < 0.25
        ours = arr([[None if m[i, j] else float(v[i, j]) for j in range(7)] for i in range(6)])
        theirs = np.ma.array(v, mask=m)
        for name, f in (("sum", np.ma.sum), ("mean", np.ma.mean), ("min", np.ma.min), ("max", np.ma.max), ("stddevp", np.ma.std)):
            for axis in (0, 1):
                assert ours.stat(name, axis).values() == pytest.approx(f(theirs, axis=axis).tolist())
        assert ours.median().scalar() == pytest.approx(float(np.ma.median(theirs)))
        assert ours.cumsum().values() == pytest.approx(theirs.filled(0).cumsum().tolist())


def test_asof_by_key_and_strict(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 120), rng.integers(0, 60, 120), strict=True))]
    df = spark.createDataFrame(rows, "addr bigint, k bigint, t bigint")
    for least in (10, 100_000):
        monkeypatch.setattr(prefix, "LEAST_RANGE", least)
        for direction, sign in (("backward", 1), ("forward", -1)):
            for strict in (False, True):
                got = {r.addr: r.found for r in lookup.asof(df, df, "t", ("k",), direction, strict=strict).collect()}
                for i, k, t in rows:
                    near = [x for x in rows if x[1] == k and (sign * (t - x[2]) > 0 or not strict and t == x[2])]
                    best = min(near, key=lambda x: (sign * -x[2], x[0]), default=(None,))[0]
                    assert got[i] == best, (least, direction, strict, i)


def test_lookups_by_series(arr):
    scales = arr([[0.0, 1.0, 4.0], [0.0, 2.0, 8.0]])
    assert scales.vectorized_section(arr([0.5, 3.0, 9.0])).values() == pytest.approx([0.5, 5 / 3, 11 / 3, 0.25, 1 + 1 / 6, 1 + 7 / 6])
    assert scales.vectorized_section(arr([0.5, 3.0])).shape == (2, 2)
    assert scales.vectorized_section_linear(arr([0.5, 6.0])).values() == pytest.approx([0.5, -1, 0.25, 1 + 2 / 3])
    own = arr([[0.5, 5.0], [N, 5.0]])
    assert scales.vectorized_find_linear_addr(own).values() == pytest.approx([0.5, 7 / 3, N, 1.5])
    assert scales.vectorized_fetch_linear_addr(arr([[0.5, 2.0], [1.5, 2.5]])).values() == pytest.approx([0.5, 4.0, 5.0, N])
    with pytest.raises(ValueError):
        arr([0.0, 1.0]).vectorized_section(own)


def test_sets_and_tables(arr):
    a, b = arr([1, 2, 2, N, 5]), arr([2, 7, N])
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(a.union(b)) == [1, 2, 5, 7] and values(a.intersect(b)) == [2] and values(a.except_(b)) == [1, 5]
    assert sorted((r.v, r.n) for r in a.except_all(b).collect()) == [(1, 1), (2, 1), (5, 1)]
    assert a.is_in(b).values() == [False, True, True, N, False]
    t = arr([[1, 2], [3, N]]).as_table(["x", "y"])
    assert t.column("y").values() == [2, N] and t.column("z") is None and t.row(-1) == {"x": 3, "y": N}
    assert sorted(tuple(r) for r in t.frame().collect()) == [(0, 1, 2), (1, 3, N)]


def test_joins_of_a_frequent_value_meet_in_tiles(spark, arr, monkeypatch):
    from tessera.operators import table

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    monkeypatch.setattr(table, "TILE", 16, raising=False)
    try:
        for k, v in zip(held, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        left, right = [7] * 200 + [N, 1, 2, 2], [7] * 150 + [N, 2, 3]
        a, b = arr(left, "int32"), arr(right, "int32")
        pairs = [(i, v, j) for i, v in enumerate(left) for j, w in enumerate(right) if v is not N and v == w]
        alone = [(i, v, N) for i, v in enumerate(left) if v in (N, 1)]
        others = [(N, w, j) for j, w in enumerate(right) if w in (N, 3)]
        for how, want in (("inner", pairs), ("left", pairs + alone), ("right", pairs + others), ("full", pairs + alone + others), ("left_outer", pairs + alone)):
            rows = a.join_values(b, how).select("*", F.spark_partition_id()).collect()
            assert sorted(((*r,)[:3] for r in rows), key=str) == sorted(want, key=str), how
            most = max(sum(r[3] == p for r in rows) for p in range(24))
            assert most < len(pairs) / 2, (how, most)  # all pairs of a value in one task before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_access(arr):
    a = arr([[1, 2, 3], [4, 5, N]])
    assert a[1, -2].values() == [5] and a[:, 1].values() == [2, 5] and a[(1, 0), None].values() == [4, 5, N, 1, 2, 3] and a[F.col("v") > 2].values() == [3, 4, 5]
    assert a.normalize_index(-1, slice(0, 2)) == [1, [0, 2, 1]] and a.scan_index(None, 1) == "block" and a.scan_index() == "all" and a.scan_index(4) == "address"
    assert list(a.each()) == [1, 2, 3, 4, 5, N] and list(a.each_with_addr())[1] == (2, 1) and list(a.each_with_index())[4] == (5, (1, 1)) and len(list(a.each_index())) == 6
    assert (10 - arr([1, 2, N])).values() == [9, 8, N] and (2 ** arr([1.0, 3.0])).values() == [2, 8] and (1 | arr([2, 4])).values() == [3, 5]
    assert arr([258, -1], "int32").refer("uint8").values() == [2, 1, 0, 0, 255, 255, 255, 255]
    assert arr([2, 1, N, 0], "uint8").refer("uint16").values() == [258, N]
    with pytest.raises(ValueError):
        arr([1, 2, 3], "uint8").refer("uint16")
    assert dict(a.each_group((0,))) == {(0,): [1, 2, 3], (1,): [4, 5, N]}
    assert a.kernel((0,), 1).values() == [4, 5, N] and a.replace_value(5, 9).values() == [1, 2, 3, 4, 9, N]
    f = a.like(a.df, kind="fixlen")
    f.data_class = "record"
    assert f.has_data_class() and not a.has_data_class()
    assert a.to_ca().values() == a.values()


def test_histogram_grows(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (25.0,), (-1.0,), (N,)], "x double")
    h = groups.Histogram([[0, 10, 20]], offsets=[1]).increment(df, F.col("x")).add(df, F.col("x"), weight=F.lit(0.5))
    assert sorted((r.b0, r.n) for r in h.cells(spark).collect()) == [(0, 1.5), (1, 3.0), (2, 1.5), (3, 1.5)]
    assert sorted((r.b0, r.n) for r in h.merge(h).inner(spark).collect()) == [(0, 6.0), (1, 3.0)]
    assert h.mid_points == [[5.0, 15.0]]
    with pytest.raises(ValueError):
        h.merge(groups.Histogram([[0, 1]]))


def test_containers_through_the_shared_store(spark, arr, tmp_path):
    a = arr([[1, 2, N], [4, 5, 6]], "int32")
    container.save(a, f"file://{tmp_path}/one")
    assert [r.v for r in container.read(spark, f"file://{tmp_path}/one", "int32").orderBy("addr").collect()] == [1, 2, N, 4, 5, 6]
    container.save_parts(a, f"file://{tmp_path}/parts", cells=4)
    assert container.load_parts(spark, f"file://{tmp_path}/parts", (2, 3), "int32").values() == [1, 2, N, 4, 5, 6]
    values, kind, mask = container.load(a.marshal_dump())
    assert kind == "int32" and values.tolist() == [[1, 2, 0], [4, 5, 6]] and mask.tolist() == [[False, False, True], [False] * 3]
    assert container.to_binary(a) == bytes([1, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 5, 0, 0, 0, 6, 0, 0, 0])


def test_jdbc_in_tasks_of_other_processes(tmp_path):
    code = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
run = __spark_entry__.queries()["source_jdbc"]
for _ in range(2):
    print("rows", sorted(r.n_nationkey for r in run(s, "/root/testdata/sf0.001").collect()) == list(range(25)))
s.stop()
"""
    home = os.path.dirname(pyspark.__file__)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"SPARK_HOME": home}
    out = subprocess.run([sys.executable, "-c", code, f"file://{tmp_path}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.split() == ["rows", "True"] * 2, out.stderr[-2000:]


def test_embedded_database(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else f"n{i}", i * 2.5, datetime.date(2020, 1, 1 + i % 28), 2**40 + i) for i in range(2500)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d date, e long")
    got = files.read_jdbc(spark, files.embed_jdbc(df, "t"), "t", "a", (0, 2500), 3, driver=files.DERBY)
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == rows
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    files.write_jdbc(df.repartition(3), url, "u", driver=files.DERBY)
    assert sorted(map(tuple, files.read_jdbc(spark, url, "u", driver=files.DERBY).collect())) == rows


def test_windows_of_a_vector_as_those_of_a_grid(arr):
    rng = np.random.default_rng(6)
    v = [None if rng.random() < 0.2 else float(x) for x in rng.integers(0, 9, 40)]
    for bounds in ("mask", "fill", "periodic", "nearest", "reflect"):
        for name in ("sum", "mean", "min", "count_valid"):
            one = arr(v).windows(name, (-2, 3), bounds=bounds).values()
            two = arr([v]).windows(name, (0, 0), (-2, 3), bounds=bounds).values()
            assert one == pytest.approx(two), (bounds, name)


def test_stream_windows_drop_late_rows(spark, tmp_path):
    from tessera.streaming import events as streams

    schema = "ts timestamp, value double"
    for k, rows in enumerate([[("2024-01-01 00:05:00", 1.0), ("2024-01-01 03:00:00", 2.0)], [("2024-01-01 03:05:00", 2.0)], [("2024-01-01 00:06:00", 9.0), ("2024-01-01 03:10:00", 3.0)]]):
        spark.createDataFrame(rows, "ts string, value double").selectExpr("cast(ts as timestamp) ts", "value").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*/")
    run = streams.windowed(stream, "ts", "1 hour").writeStream.format("memory").queryName("late_rows").outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.start.hour, r.n) for r in spark.table("late_rows").collect()}
    assert (0, 1) in got and (3, 3) in got and (0, 2) not in got
