"""One query for each operator of the array engine over the tables of a folder, and DuckDB SQL with the same result.

The arrays: `part` as a grid of rows of 50 cells, addressed by p_partkey; `orders` and `events` as vectors. Masked cells are
made in the queries, as the tables have none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import strings as T
from .functions import times as D
from .functions.types import cast, promote, wrap
from .operators import compose, create, groups, lookup, udf
from .operators.elements import COMPARE
from .operators.records import Record, members
from .operators.windows import bounded
from .plans.array import NDArray
from .sources import container
from .streaming import events as streams

QUERIES = {}
ORACLES = {}

PART = """with a as (select p_partkey as addr, p_partkey // 50 as i0, p_partkey % 50 as i1,
  case when p_size % 7 <> 0 then (p_retailprice - 1000) / 50.0 end as v, p_retailprice / 100.0 - 12 as w,
  p_size as k, case when p_size % 7 <> 0 then p_size end as km, p_name as s, p_type as t,
  case when p_size % 5 <> 0 then p_size % 3 = 0 end as b, p_size % 2 = 0 as c from part) """
ORDERS = """with o as (select o_orderkey as addr, case when o_orderkey % 11 <> 3 then o_totalprice end as v, o_custkey as k, o_orderdate as t from orders) """
EVENTS = """with e as (select event_id as addr, case when event_id >= 3 and event_id % 13 <> 5 then value end as v, user_id as k, ts as t from events) """


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "part")
    size = F.col("p_size")
    masked = lambda c, n=7: F.when(size % n != 0, c)
    return d.select(
        F.col("p_partkey").alias("addr"), masked((F.col("p_retailprice") - 1000) / 50.0).alias("v"), (F.col("p_retailprice") / 100.0 - 12).alias("w"),
        size.alias("k"), masked(size).alias("km"), F.col("p_name").alias("s"), F.col("p_type").alias("t"), masked(size % 3 == 0, 5).alias("b"), (size % 2 == 0).alias("c"),
    )


def grid(spark, sf_dir, column="v", kind="float64") -> NDArray:
    return NDArray.from_table(part(spark, sf_dir), "addr", column, (50,), kind)


def vector(spark, sf_dir, name="orders") -> NDArray:
    d = table(spark, sf_dir, name)
    if name == "orders":
        return NDArray.from_table(d, "o_orderkey", F.when(F.col("o_orderkey") % 11 != 3, F.col("o_totalprice")))
    return NDArray.from_table(d, "event_id", F.when((F.col("event_id") >= 3) & (F.col("event_id") % 13 != 5), F.col("value")))


# ---- element-wise functions: addr and r



def _columns() -> None:
    """Columns that the expressions below name; they can only be made once a session is there."""
    globals().update(x=F.col("v") / 2, V=F.col("v"), W=F.col("w"), K=F.col("k"), KM=F.col("km"), NAME=F.col("s"), B=F.col("b"), C=F.col("c"))
    globals().update(_Z=S.cpx(F.col("v") / 2, F.col("w")), _U=S.cpx(F.lit(1.5), F.lit(-0.5)))


def cells(name: str, value, sql: str, digits: int | None = None) -> None:
    def run(spark, sf_dir):
        _columns()
        made = value()
        return part(spark, sf_dir).select("addr", (F.round(made, digits) if digits is not None else made).alias("r"))

    query(name, f"{PART} select addr, {f'round({sql}, {digits})' if digits is not None else sql} as r from a")(run)


for _name, _f in COMPARE.items():
    _sql = {"eq": "v = w", "ne": "v <> w", "gt": "v > w", "lt": "v < w", "ge": "v >= w", "le": "v <= w", "feq": "abs(v - w) <= greatest(abs(v), abs(w)) * 2.220446049250313e-16"}[_name]
    cells(f"compare_{_name}", lambda f=_f: f(V, W), _sql)
    cells(f"compare_{_name}_scalar", lambda f=_f: f(KM.cast("double"), F.lit(10.0)), _sql.replace("v", "cast(km as double)").replace("w", "10.0"))
cells("compare_cmp", lambda: S.cmp(KM, F.lit(25)), "cast(case when km < 25 then -1 when km > 25 then 1 when km = 25 then 0 end as tinyint)")
cells("compare_is_equiv", lambda: S.is_equiv(V, W, 0.5), "v = w or (greatest(abs(v), abs(w)) <> 0 and abs(v - w) / greatest(abs(v), abs(w)) <= 0.5)")
cells("compare_is_close", lambda: S.is_close(V, W, 3.0), "abs(v - w) <= 3.0")
cells("compare_between", lambda: S.between(KM.cast("double"), 5.0, 20.0), "km between 5 and 20")
cells("compare_contains", lambda: S.contains(KM, 3, 11, 40), "km in (3, 11, 40)")
cells("compare_is_divisible", lambda: S.is_divisible(KM, 4), "km % 4 = 0")
cells("compare_is_not_divisible", lambda: S.is_not_divisible(KM, 4), "km % 4 <> 0")
cells("compare_is_nan", lambda: S.is_nan(S.div(KM - 8, KM - 8)), "case when km is not null then km = 8 end")
cells("compare_is_inf", lambda: S.is_inf(S.div(KM, KM - 8)), "case when km is not null then km = 8 end")
cells("compare_is_finite", lambda: S.is_finite(S.div(KM, KM - 8)), "case when km is not null then km <> 8 end")
cells("compare_match", lambda: S.match(NAME, "^s.*g$"), "regexp_matches(s, '^s.*g$')")
cells("logic_not", lambda: S.logical_not(B), "not b")
cells("logic_and", lambda: S.logical_and(B, F.nullif(C, F.lit(False))), "case when b is null or not c then null else b end")
cells("logic_or", lambda: S.logical_or(B, F.nullif(C, F.lit(True))), "case when b is null or c then null else b end")
cells("logic_xor", lambda: S.logical_xor(B, C), "b <> c")

_ARITHMETIC = {
    "add": (lambda: V + W, "v + w"), "sub": (lambda: V - W, "v - w"), "mul": (lambda: V * W, "v * w"), "div": (lambda: S.div(V, W + 50), "v / (w + 50)"),
    "mod": (lambda: S.mod(KM, F.lit(7)), "km % 7"), "remainder": (lambda: S.remainder(V, F.lit(3.0)), "v - 3.0 * round_even(v / 3.0, 0)"),
    "rcp": (lambda: S.rcp(W + 50), "1.0 / (w + 50)"), "rcp_mul": (lambda: S.rcp_mul(W + 50, V), "v / (w + 50)"), "pow": (lambda: S.power(x, 3), "pow(v / 2, 3)"),
    "neg": (lambda: S.neg(V), "-v"), "abs": (lambda: F.abs(V), "abs(v)"), "sign": (lambda: S.sign(V), "cast(sign(v) as double)"), "frac": (lambda: S.frac(V), "v - trunc(v)"),
    "ceil": (lambda: S.ceil(V), "ceil(v)"), "floor": (lambda: S.floor(V), "floor(v)"), "round": (lambda: S.rounded(V), "round(v)"), "pmax": (lambda: S.pmax(V, W), "case when v is not null then greatest(v, w) end"),
    "pmin": (lambda: S.pmin(V, W), "case when v is not null then least(v, w) end"), "trim": (lambda: S.trim(V, -1.0, 5.0), "case when v is not null then least(greatest(v, -1.0), 5.0) end"),
    "trim_fill": (lambda: S.trim(V, -1.0, 5.0, -99.0), "case when v < -1.0 or v >= 5.0 then -99.0 else v end"), "trim_mask": (lambda: S.trim(V, -1.0, 5.0, mask=True), "case when not (v < -1.0 or v >= 5.0) then v end"),
    "deg_360": (lambda: S.deg_360(V * 100), "case when v >= 0 then (v * 100 / 360.0 - floor(v * 100 / 360.0)) * 360.0 else (v * 100 / 360.0 - ceil(v * 100 / 360.0) + 1) * 360.0 end"),
    "deg_180": (lambda: S.deg_180(V * 100), "v * 100 - ceil((v * 100 - 180.0) / 360.0) * 360.0"),
    "rad_2pi": (lambda: S.rad_2pi(V), f"case when v >= 0 then (v / {2 * math.pi} - floor(v / {2 * math.pi})) * {2 * math.pi} else (v / {2 * math.pi} - ceil(v / {2 * math.pi}) + 1) * {2 * math.pi} end"),
    "rad_pi": (lambda: S.rad_pi(V), f"v - ceil((v - {math.pi}) / {2 * math.pi}) * {2 * math.pi}"),
    "distance": (lambda: F.abs(V - W), "abs(v - w)"), "atan2": (lambda: S.atan2(V, W), "atan2(v, w)"), "hypot": (lambda: S.hypot(V, W), "sqrt(v * v + w * w)"), "lgamma": (lambda: S.lgamma(KM), "lgamma(km)"),
}
for _name, (_value, _sql) in _ARITHMETIC.items():
    cells(f"math_{_name}", _value, _sql, None if _name == "mod" else 6)

cells("math_int_div", lambda: S.int_div(KM - 20, F.lit(3)), "cast(trunc((km - 20) / 3.0) as bigint)")
cells("math_quo", lambda: S.quo(KM, F.lit(8), 4).cast("double"), "cast(km / 8.0 as double)")
cells("math_wrap_add_int8", lambda: wrap(KM.cast("bigint") * 5, "int8"), "cast((km * 5 + 128) % 256 - 128 as tinyint)")
cells("math_wrap_mul_uint8", lambda: wrap(KM.cast("bigint") * 37, "uint8"), "cast(km * 37 % 256 as smallint)")
cells("math_int_power", lambda: wrap(S.int_power(KM, 3), "int64"), "cast(km as bigint) * km * km")

_FUNCTIONS = {
    "sqrt": "sqrt(abs(v))", "exp": "exp(v / 4)", "exp2": "pow(2, v / 4)", "exp10": "pow(10, v / 8)", "expm1": "exp(v / 4) - 1", "log": "ln(abs(v) + 1)",
    "log10": "log10(abs(v) + 1)", "log2": "log2(abs(v) + 1)", "logb": "floor(log2(abs(v) + 1.5))", "rad": "radians(v)", "deg": "degrees(v)",
    "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v / 20)", "asin": "asin(v / 100)", "acos": "acos(v / 100)", "atan": "atan(v)",
    "sinh": "sinh(v / 8)", "cosh": "cosh(v / 8)", "tanh": "tanh(v / 8)", "asinh": "asinh(v)", "acosh": "acosh(abs(v) + 1)", "atanh": "atanh(v / 100)",
}
_ARGUMENT = lambda: {
    "sqrt": F.abs(V), "exp": V / 4, "exp2": V / 4, "exp10": V / 8, "expm1": V / 4, "log": F.abs(V) + 1, "log10": F.abs(V) + 1, "log2": F.abs(V) + 1, "logb": F.abs(V) + 1.5,
    "tan": V / 20, "asin": V / 100, "acos": V / 100, "sinh": V / 8, "cosh": V / 8, "tanh": V / 8, "acosh": F.abs(V) + 1, "atanh": V / 100,
}
for _name, _sql in _FUNCTIONS.items():
    cells(f"math_{_name}", lambda name=_name: S.UNARY[name](_ARGUMENT().get(name, V)), _sql, 6)

# bits
cells("bit_neg", lambda: S.bit_neg(KM), "~km")
cells("bit_and", lambda: S.bit_and(KM, F.lit(12)), "km & 12")
cells("bit_or", lambda: S.bit_or(KM, F.lit(12)), "km | 12")
cells("bit_xor", lambda: S.bit_xor(KM, F.lit(12)), "xor(km, 12)")
cells("bit_lshift", lambda: S.bit_lshift(KM.cast("bigint"), 3), "cast(km as bigint) << 3")
cells("bit_rshift", lambda: S.bit_rshift(KM, 2), "km >> 2")
cells("bit_bitarray", lambda: F.when(KM.isNotNull(), F.array_join(F.transform(S.bits(KM, 6), lambda b: b.cast("int").cast("string")), "")), "case when km is not null then reverse(right(lpad(bin(km), 6, '0'), 6)) end")
cells("bit_bitfield", lambda: S.bitfield(KM, 1, 3), "(km >> 1) & 7")
cells("bit_swap_bytes", lambda: S.swap_bytes(KM, 2), "cast(km % 256 * 256 + km // 256 as bigint)")
cells("bit_to_bit_string", lambda: S.to_bit_string(KM, 8), "lpad(bin(km), 8, '0')")
cells("bit_from_bit_string", lambda: S.from_bit_string(S.to_bit_string(KM, 8)), "cast(km as bigint)")

# casts
cells("cast_int32", lambda: cast(V * 3.7, "int32", "float64"), "cast(trunc(v * 3.7) as int)")
cells("cast_uint8", lambda: cast(V * 30, "uint8", "float64"), "cast(((cast(trunc(v * 30) as bigint) % 256) + 256) % 256 as smallint)")
cells("cast_int8", lambda: cast(KM * 9, "int8", "int32"), "cast((km * 9 + 128) % 256 - 128 as tinyint)")
cells("cast_boolean", lambda: cast(KM - 8, "boolean", "int32"), "km <> 8")
cells("cast_float32", lambda: cast(KM, "float32", "int32").cast("double"), "cast(km as double)")
cells("cast_object", lambda: cast(KM, "object", "int32"), "cast(km as varchar)")
cells("cast_scan_int", lambda: T.to_i(F.concat(F.lit(" "), K.cast("string"), F.lit("abc"))), "cast(k as bigint)")
cells("cast_promotion", lambda: F.lit(promote("int32", "uint32")), "'uint32'")

# complex numbers, as their parts
_COMPLEX = {
    "add_re": (lambda: S.c_add(_Z, _U)["re"], "v / 2 + 1.5"), "mul_im": (lambda: S.c_mul(_Z, _U)["im"], "v / 2 * -0.5 + w * 1.5"), "div_re": (lambda: S.c_div(_Z, _U)["re"], "(v / 2 * 1.5 + w * -0.5) / 2.5"),
    "conj_im": (lambda: S.conj(_Z)["im"], "-w"), "abs": (lambda: S.c_abs(_Z), "sqrt(v / 2 * v / 2 + w * w)"), "arg": (lambda: S.arg(_Z), "atan2(w, v / 2)"), "exp_re": (lambda: S.c_exp(S.cpx(x / 4, W))["re"], "exp(v / 8) * cos(w)"),
    "sqrt_re": (lambda: S.c_sqrt(_Z)["re"], "sqrt(sqrt(v / 2 * v / 2 + w * w)) * cos(atan2(w, v / 2) / 2)"), "sin_re": (lambda: S.c_sin(S.cpx(x, W / 8))["re"], "sin(v / 2) * cosh(w / 8)"),
}
for _name, (_value, _sql) in _COMPLEX.items():
    cells(f"complex_{_name}", lambda value=_value: F.when(V.isNotNull(), value()), f"case when v is not null then {_sql} end", 6)
cells("coordinates_xyz", lambda: F.when(V.isNotNull(), S.spherical_to_xyz(W, x, V)["x"]), "w * sin(v / 2) * cos(v)", 6)
cells("coordinates_spherical", lambda: F.when(V.isNotNull(), S.xyz_to_spherical(V, W, x)["r"]), "sqrt(v * v + w * w + v / 2 * v / 2)", 6)

# masks
cells("mask_is_masked", lambda: V.isNull(), "v is null")
cells("mask_unmask", lambda: F.coalesce(V, F.lit(-9.0)), "coalesce(v, -9.0)", 6)
cells("generate_pickup", lambda: create.pickup(K % 3, F.lit("a"), F.lit("b"), F.lit("c")), "case k % 3 when 0 then 'a' when 1 then 'b' else 'c' end")
cells("index_addr2index", lambda: F.concat_ws(",", *[c.cast("string") for c in (F.call_function("div", F.col("addr"), F.lit(50).cast("bigint")), F.col("addr") % 50)]), "concat(i0, ',', i1)")
for _mode, _sql in {"periodic": "((i1 - 60 + 150) % 50)", "nearest": "greatest(least(i1 * 3 - 40, 49), 0)", "reflect": "case when (i1 * 3 - 40 + 100) % 100 < 50 then (i1 * 3 - 40 + 100) % 100 else 99 - (i1 * 3 - 40 + 100) % 100 end"}.items():
    cells(f"bounds_{_mode}", lambda mode=_mode: bounded(F.col("addr") % 50 - 60 if mode == "periodic" else F.col("addr") % 50 * 3 - 40, 50, mode).cast("bigint"), f"cast({_sql} as bigint)")

# strings
_STRINGS = {
    "len": (lambda: T.length(NAME), "length(s)"), "bytesize": (lambda: T.bytesize(NAME), "strlen(s)"), "gsub": (lambda: T.gsub(NAME, "[aeiou]", "#"), "regexp_replace(s, '[aeiou]', '#', 'g')"), "sub": (lambda: T.sub(NAME, "[aeiou]", "#"), "regexp_replace(s, '[aeiou]', '#')"),
    "is_end_with": (lambda: T.is_end_with(NAME, "ring", "bolt"), "ends_with(s, 'ring') or ends_with(s, 'bolt')"), "is_start_with": (lambda: T.is_start_with(NAME, "red", "small"), "starts_with(s, 'red') or starts_with(s, 'small')"),
    "includes": (lambda: T.includes(NAME, "id"), "contains(s, 'id')"), "index": (lambda: T.index(NAME, "i"), "nullif(instr(s, 'i') - 1, -1)"), "rindex": (lambda: T.rindex(NAME, "e"), "case when instr(reverse(s), 'e') > 0 then length(s) - instr(reverse(s), 'e') end"),
    "downcase": (lambda: T.downcase(F.col("t")), "lower(t)"), "upcase": (lambda: T.upcase(NAME), "upper(s)"), "capitalize": (lambda: T.capitalize(F.col("t")), "upper(left(t, 1)) || lower(substr(t, 2))"), "swapcase": (lambda: T.swapcase(T.capitalize(NAME)), "lower(left(s, 1)) || upper(substr(s, 2))"),
    "chomp": (lambda: T.chomp(F.concat(NAME, F.lit("\n"))), "s"), "chop": (lambda: T.chop(NAME), "left(s, length(s) - 1)"), "chr": (lambda: T.first_char(NAME), "left(s, 1)"), "clear": (lambda: T.clear(NAME), "''"), "count": (lambda: T.count(NAME, "a-e"), "length(s) - length(regexp_replace(s, '[a-e]', '', 'g'))"),
    "delete": (lambda: T.delete(NAME, "a-e"), "regexp_replace(s, '[a-e]', '', 'g')"), "delete_prefix": (lambda: T.delete_prefix(NAME, "small "), "case when starts_with(s, 'small ') then substr(s, 7) else s end"), "delete_suffix": (lambda: T.delete_suffix(NAME, " ring"), "case when ends_with(s, ' ring') then left(s, length(s) - 5) else s end"),
    "dump": (lambda: T.dump(NAME), "'\"' || s || '\"'"), "ljust": (lambda: T.ljust(NAME, 12, "*"), "case when length(s) < 12 then rpad(s, 12, '*') else s end"), "rjust": (lambda: T.rjust(NAME, 12, "*"), "case when length(s) < 12 then lpad(s, 12, '*') else s end"),
    "center": (lambda: T.center(NAME, 14, "*"), "case when length(s) < 14 then repeat('*', (14 - length(s)) // 2) || s || repeat('*', 14 - length(s) - (14 - length(s)) // 2) else s end"),
    "to_i": (lambda: T.to_i(F.concat(K.cast("string"), NAME)), "cast(k as bigint)"), "to_f": (lambda: T.to_f(F.concat(K.cast("string"), F.lit(".5x"))), "k + 0.5::double"), "to_r": (lambda: T.to_r(F.concat(K.cast("string"), F.lit("/7")))["den"], "cast(7 as bigint)"),
    "strip": (lambda: T.strip(F.concat(F.lit(" \t"), NAME, F.lit("\n "))), "s"), "rstrip": (lambda: T.rstrip(F.concat(F.lit(" "), NAME, F.lit("\n "))), "' ' || s"), "lstrip": (lambda: T.lstrip(F.concat(F.lit(" \t"), NAME, F.lit(" "))), "s || ' '"), "is_empty": (lambda: T.is_empty(NAME), "s = ''"),
    "matches": (lambda: T.matches(NAME, "r.n"), "regexp_matches(s, 'r.n')"), "extract": (lambda: T.extract(NAME, "(\\w+) (\\w+)", r"\2-\1"), "regexp_extract(s, '(\\w+) (\\w+)', 2) || '-' || regexp_extract(s, '(\\w+) (\\w+)', 1)"),
    "format": (lambda: T.formatted(K, F.col("addr"), "%d", "<%d>"), "case when addr % 2 = 0 then cast(k as varchar) else '<' || k || '>' end"), "format_columns": (lambda: T.format_columns("%s/%d", NAME, KM), "case when km is not null then s || '/' || km end"),
    "encode": (lambda: F.hex(T.encode(NAME, "UTF-16BE")), "upper(regexp_replace(hex(encode(s)), '(..)', '00\\1', 'g'))"), "encoding": (lambda: T.encoding(NAME), "'UTF-8'"), "scrub": (lambda: T.scrub(NAME), "s"), "intern": (lambda: T.intern(NAME), "s"),
}
for _name, (_value, _sql) in _STRINGS.items():
    cells(f"str_{_name}", (lambda value=_value: value().cast("bigint")) if _name in ("len", "bytesize", "index", "rindex", "count") else _value, f"cast({_sql} as bigint)" if _name in ("len", "bytesize", "index", "rindex", "count") else _sql)

# times
_TIMES = {
    "year": (D.year, "year(t)"), "month": (D.month, "month(t)"), "day": (D.day, "day(t)"), "hour": (D.hour, "hour(t)"), "minute": (D.minute, "minute(t)"),
    "second": (lambda t: F.round(D.second(t), 6), "round(second(t) + (microsecond(t) % 1000000) / 1e6, 6)"), "jd": (D.jd, "datediff('day', date '1970-01-01', cast(t as date)) + 2440588"),
    "ajd": (lambda t: F.round(D.ajd(t), 3), "round(epoch_us(t) / 86400e6 + 2440587.5, 3)"), "is_leap": (D.is_leap, "year(t) % 4 = 0 and (year(t) % 100 <> 0 or year(t) % 400 = 0)"),
    "strftime": (lambda t: D.strftime(t, "%Y/%m/%d %H:%M:%S"), "strftime(t, '%Y/%m/%d %H:%M:%S')"), "strptime": (lambda t: D.year(D.strptime(D.strftime(t, "%d.%m.%Y"), "%d.%m.%Y")), "year(t)"),
    "to_datetime": (lambda t: D.day(D.to_datetime(D.strftime(t, "%F"), "%F")), "day(t)"),
}
for _name, (_f, _sql) in _TIMES.items():

    def _run(spark, sf_dir, f=_f, name=_name):
        out = f(F.col("ts"))
        return table(spark, sf_dir, "events").select(F.col("event_id").alias("addr"), (out.cast("bigint") if name in ("year", "month", "day", "hour", "minute", "jd", "strptime", "to_datetime") else out).alias("r"))

    query(f"time_{_name}", f"{EVENTS} select addr, {f'cast({_sql} as bigint)' if _name in ('year', 'month', 'day', 'hour', 'minute', 'jd', 'strptime', 'to_datetime') else _sql} as r from e")(_run)


# ---- reductions


def rounded_cells(a: NDArray, digits: int = 6) -> DataFrame:
    return a.df.select("addr", F.round(F.col("v").cast("double"), digits).alias("v"))


_STATS = {
    "sum": "sum(v)", "prod": "product(1 + v / 100)", "mean": "avg(v)", "count_valid": "nullif(count(v), 0)", "min": "min(v)", "max": "max(v)",
    "variance": "var_samp(v)", "variancep": "var_pop(v)", "stddev": "stddev_samp(v)", "stddevp": "stddev_pop(v)", "median": "median(v)",
    "min_addr": "arg_min(addr, {v: v, a: addr})", "max_addr": "arg_max(addr, {v: v, a: -addr})",
}
for _name, _sql in _STATS.items():
    _base = lambda spark, sf_dir, name=_name: grid(spark, sf_dir, 1 + F.col("v") / 100 if name == "prod" else "v")
    query(f"stat_{_name}", f"{PART} select 0::bigint as addr, round(cast({_sql} as double), 6) as v from a where v is not null")(lambda spark, sf_dir, name=_name, base=_base: rounded_cells(base(spark, sf_dir).stat(name)))
    if _name not in ("min_addr", "max_addr", "median"):
        query(f"stat_{_name}_axis0", f"{PART} select i1 as addr, round(cast({_sql} as double), 6) as v from a group by i1")(lambda spark, sf_dir, name=_name, base=_base: rounded_cells(base(spark, sf_dir).stat(name, 0)))
        query(f"stat_{_name}_axis1", f"{PART} select i0 as addr, round(cast({_sql} as double), 6) as v from a group by i0")(lambda spark, sf_dir, name=_name, base=_base: rounded_cells(base(spark, sf_dir).stat(name, -1)))
query("stat_min_addr_axis1", f"{PART} select i0 as addr, cast(arg_min(i1, {{v: v, a: i1}}) as double) as v from a where v is not null group by i0")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).min_addr(1)))
query("stat_max_addr_axis0", f"{PART} select i1 as addr, cast(arg_max(i0, {{v: v, a: -i0}}) as double) as v from a where v is not null group by i1")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).max_addr(0)))
query("stat_accumulate_uint8", f"{PART} select i0 as addr, cast(sum(km) % 256 as double) as v from a group by i0")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, "km", "uint8").accumulate(1)))
query("stat_mask_limit", f"{PART} select i0 as addr, round(case when count(*) - count(v) >= 8 then -9999 else sum(v) end, 6) as v from a group by i0")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).sum(1, mask_limit=8, fill_value=-9999.0)))
query("stat_min_count", f"{PART} select i0 as addr, round(case when count(v) < 43 then null else avg(v) end, 6) as v from a group by i0")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).mean(1, min_count=43)))
query("stat_percentile", f"{PART} select unnest([0::bigint, 1, 2]) as addr, round(unnest(quantile_cont(v, [0.1, 0.335, 0.9])), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).percentile(10, 33.5, 90)))
query("stat_quantile", f"{PART} select unnest([0::bigint, 1, 2, 3, 4]) as addr, round(unnest(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1])), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).quantile()))
query("stat_range", f"{PART} select round(min(v), 6) as low, round(max(v), 6) as high from a")(lambda spark, sf_dir: grid(spark, sf_dir).range().select(F.round("v.min", 6).alias("low"), F.round("v.max", 6).alias("high")))
for _name, _sql in {"wsum": "sum(v * w)", "wmean": "sum(v * w) / sum(case when v is not null then w end)", "covariance": "covar_samp(v, w)", "covariancep": "covar_pop(v, w)", "correlation": "corr(v, w)", "mul_add": "sum(v * w)"}.items():
    query(f"stat_{_name}", f"{PART} select round({_sql}, 6) as v from a")(lambda spark, sf_dir, name=_name: getattr(grid(spark, sf_dir), name)(grid(spark, sf_dir, "w")).select(F.round("v", 6).alias("v")))
query("stat_anomaly", f"{PART} select addr, round(v - avg(v) over (), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).anomaly()))
query("stat_anomaly_axis", f"{PART} select addr, round(v - avg(v) over (partition by i0), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).anomaly(1)))
for _name, (_call, _sql) in {
    "count_true": (lambda g, b: b.count_true(), "count(*) filter (b)"), "count_false": (lambda g, b: b.count_false(), "count(*) filter (not b)"), "count_equal": (lambda g, b: g.count_equal(8), "count(*) filter (km = 8)"),
    "count_equiv": (lambda g, b: g.count_equiv(20, 0.1), "count(*) filter (km = 20 or abs(km - 20) / greatest(km, 20) <= 0.1)"), "count_close": (lambda g, b: g.count_close(20, 2), "count(*) filter (abs(km - 20) <= 2)"),
    "count_masked": (lambda g, b: g.count_masked(), "count(*) - count(km)"), "count_not_masked": (lambda g, b: g.count_not_masked(), "count(km)"),
}.items():
    query(f"stat_{_name}", f"{PART} select 0::bigint as addr, {_sql} as v from a")(lambda spark, sf_dir, call=_call: call(grid(spark, sf_dir, "km", "int32"), grid(spark, sf_dir, "b", "boolean")).df)
for _name, (_call, _sql) in {
    "all_equal": (lambda g: g.all_equal(8), "coalesce(bool_and(km = 8), true)"), "all_equiv": (lambda g: g.all_equiv(25, 1.0), "coalesce(bool_and(km = 25 or abs(km - 25) / greatest(km, 25) <= 1.0), true)"), "all_close": (lambda g: g.all_close(25, 25), "coalesce(bool_and(abs(km - 25) <= 25), true)"),
    "any_equal": (lambda g: g.any_equal(8), "coalesce(bool_or(km = 8), false)"), "any_equiv": (lambda g: g.any_equiv(200, 0.1), "coalesce(bool_or(abs(km - 200) / greatest(km, 200) <= 0.1), false)"), "any_close": (lambda g: g.any_close(60, 10), "coalesce(bool_or(abs(km - 60) <= 10), false)"),
    "none_equal": (lambda g: g.none_equal(7), "not coalesce(bool_or(km = 7), false)"), "none_equiv": (lambda g: g.none_equiv(200, 0.1), "not coalesce(bool_or(abs(km - 200) / greatest(km, 200) <= 0.1), false)"), "none_close": (lambda g: g.none_close(60, 10), "not coalesce(bool_or(abs(km - 60) <= 10), false)"),
    "any_masked": (lambda g: g.any_masked(), "bool_or(km is null)"), "all_masked": (lambda g: g.all_masked(), "bool_and(km is null)"),
}.items():
    query(f"test_{_name}", f"{PART} select {_sql} as v from a")(lambda spark, sf_dir, call=_call: call(grid(spark, sf_dir, "km", "int32")))
query("test_equal_arrays", f"{PART} select bool_and(km is not distinct from case when addr <> 7 then km else km + 1 end) as v from a union all select bool_and(km is not distinct from k + km - k) from a")(lambda spark, sf_dir: (lambda g: g.equals(g.store(F.col("addr") == 7, F.col("v") + 1)).union(g.equals(grid(spark, sf_dir, F.col("k") + F.col("km") - F.col("k"), "int32"))))(grid(spark, sf_dir, "km", "int32")))
query("text_join", f"{PART} select string_agg(cast(km as varchar), ',' order by addr) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").join(","))

# ---- masks of whole arrays
query("mask_maskout_value", f"{PART} select addr, nullif(km, 8) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").maskout(value=8).df.select("addr", "v"))
query("mask_maskout_keep", f"{PART} select addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").with_mask(F.col("v") > 30).unmask().df)
query("mask_invert", f"{PART} select addr, case when k > 30 then k end as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").with_mask(F.col("v") > 30).invert_mask().df.select("addr", "v"))
query("mask_inherit", f"{PART} select addr, case when b is not null then km end as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").inherit_mask(grid(spark, sf_dir, "b", "boolean")).df)
query("mask_guard", f"{PART} select addr, round(case when v is not null then v + w else -1 end, 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).guard(lambda p, q: p + q, -1.0, grid(spark, sf_dir, "w"))))
query("mask_zip_add", f"{PART} select addr, round(v + w, 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir) + grid(spark, sf_dir, "w")))

# ---- selecting and gathering
query("index_select", f"{PART} select addr, km as v from a where km > 40")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").select(F.col("v") > 40))
query("index_select_array", f"{PART} select addr, k as v from a where b")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").select(grid(spark, sf_dir, "b", "boolean")))
query("index_compact_select", f"{PART} select row_number() over (order by addr) - 1 as addr, km as v from a where km > 40")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").compact_select(F.col("v") > 40).df)
query("index_point", f"{PART} select 0::bigint as addr, k as v from a where addr = 53")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").at(1, 3).df)
query("index_block", f"{PART} select (i1 - 5) // 10 + i0 * 5 as addr, k as v from a where i1 >= 5 and (i1 - 5) % 10 = 0")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").slice(None, slice(5, 50, 10)).df)
query("index_gather", f"{PART} select p.addr, q.k as v from a p join a q on q.addr = p.k")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").gather(grid(spark, sf_dir, "k", "int64")).df)
query("index_project", f"{PART} select p.addr, case when p.km - 20 < 0 then -1 else q.k end as v from a p left join a q on q.addr = p.km - 20")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").project(grid(spark, sf_dir, F.col("km") - 20, "int64"), -1, -2).df)
query("index_grid", f"{PART} select i0 * 3 + case i1 when 4 then 0 when 49 then 1 else 2 end as addr, k as v from a where i1 in (4, 49, 7)")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").grid(None, [4, -1, 7]).df)
query("index_store", f"{PART} select addr, case when i1 = 3 then 0 else k end as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").store(F.col("i1") == 3, 0).df)
query("index_where", f"{PART} select addr from a where b")(lambda spark, sf_dir: grid(spark, sf_dir, "b", "boolean").where())
query("index_where_range", f"{PART} select min(addr) as first, max(addr) as last from (select addr, addr - row_number() over (order by addr) as g from a where c) group by g")(lambda spark, sf_dir: grid(spark, sf_dir, "c", "boolean").where_range())
query("index_first", f"{PART} select arg_min(k, addr) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").first())
query("index_last", f"{PART} select arg_max(k, addr) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").last())
query("index_swap", f"{PART} select case addr when 1 then 7 when 7 then 1 else addr end as addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").swap(1, 7).df)
query("index_incr", f"{PART} select addr, case when addr = 5 then k + 1 else k end as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").incr(5).df)
query("index_fetch_linear", f"{PART}, x as (select addr, k + 0.25 as x from a) select x.addr, round(p.w * 0.75 + q.w * 0.25, 6) as v from x join a p on p.addr = floor(x) join a q on q.addr = ceil(x)")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, "w").fetch_linear_addr(grid(spark, sf_dir, F.col("k") + 0.25))))
query("index_valid_addr", f"{PART} select addr, addr - 30 between -(select count(*) from a) and (select count(*) from a) - 1 as r from a")(lambda spark, sf_dir: (lambda g: g.df.select("addr", g.valid_addr(F.col("addr") - 30).alias("r")))(grid(spark, sf_dir)))

# ---- lookups
_REF = "r as (select s_suppkey as addr, s_nationkey as v from supplier)"


def suppliers(spark, sf_dir) -> NDArray:
    return NDArray.from_table(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", (), "int32")


def scale(spark, sf_dir) -> NDArray:
    return NDArray.from_table(table(spark, sf_dir, "nation"), "n_nationkey", F.col("n_nationkey") * F.col("n_nationkey") / 10.0)


query("lookup_matchup", f"{PART}, {_REF} select a.addr, m.p as v from a left join (select v, min(addr) as p from r group by v) m on m.v = a.km")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").matchup(suppliers(spark, sf_dir)).df)
query("lookup_bsearch", f"{PART}, {_REF} select a.addr, m.p as v from a left join (select v, min(addr) as p from r group by v) m on m.v = a.k")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").bsearch(suppliers(spark, sf_dir)).df)
query("lookup_search", f"{PART} select min(addr) as v from a where km = 20")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").search(20))
query("lookup_search_eps", f"{PART} select min(addr) as v from a where abs(v - 2.5) <= 0.3")(lambda spark, sf_dir: grid(spark, sf_dir).search(2.5, 0.3))
query("lookup_search_nearest", f"{PART} select arg_min(addr, {{d: abs(v - 2.51), a: addr}}) as v from a where v is not null")(lambda spark, sf_dir: grid(spark, sf_dir).search_nearest(2.51))
_SECTION = """, n as (select n_nationkey as k, n_nationkey * n_nationkey / 10.0 as lo, (n_nationkey + 1) * (n_nationkey + 1) / 10.0 as hi from nation where n_nationkey < 24),
 f as (select a.addr, n.k + (a.km - n.lo) / (n.hi - n.lo) as x from a join n on (a.km >= n.lo or n.k = 0) and (a.km < n.hi or n.k = 23) where a.km is not null)"""
query("lookup_section", f"{PART}{_SECTION} select a.addr, round(f.x, 6) as v from a left join f on f.addr = a.addr")(lambda spark, sf_dir: rounded_cells(scale(spark, sf_dir).section(grid(spark, sf_dir, "km"))))
query("lookup_section_linear", f"{PART}{_SECTION} select a.addr, case when a.km is not null then round(coalesce(f.x, -1), 6) end as v from a left join f on f.addr = a.addr")(lambda spark, sf_dir: rounded_cells(scale(spark, sf_dir).section_linear(grid(spark, sf_dir, "km"))))
query("lookup_matchup_nearest", f"{PART}{_SECTION} select a.addr, cast(floor(round(f.x, 9)) as bigint) as v from a left join f on f.addr = a.addr")(lambda spark, sf_dir: grid(spark, sf_dir, "km").matchup_nearest(scale(spark, sf_dir), "floor").df)
_TIMES = lambda spark, sf_dir: table(spark, sf_dir, "events").select(F.col("event_id").alias("addr"), F.col("user_id").alias("k"), F.col("ts").alias("t"))
query("lookup_asof", f"{EVENTS} select l.addr, r.addr as found from e l asof left join e r on l.k = r.k and l.t > r.t")(lambda spark, sf_dir: (lambda e: lookup.asof(e, e, "t", ("k",), strict=True).select("addr", "found"))(_TIMES(spark, sf_dir)))
query("lookup_asof_forward", f"{EVENTS} select l.addr, r.addr as found from e l asof left join e r on l.t < r.t")(lambda spark, sf_dir: (lambda e: lookup.asof(e, e, "t", direction="forward", strict=True).select("addr", "found"))(_TIMES(spark, sf_dir)))
query("lookup_broadcast_to", f"{PART} select y.i * 50 + a.addr as addr, a.k as v from a, (select unnest(range(3)) as i) y where a.i0 = 0")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").slice(0, None).broadcast_to(3, 50).df)

# ---- groups and bins
query("group_classes", f"{PART} select km as class, count(*) as n, round(avg(km), 6) as mean from a where km is not null group by km")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").classes("mean").select("class", "n", F.round("mean", 6).alias("mean")))
query("group_ndiming", f"{PART} select km as class, count(*) as n from a where km is not null group by km")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").ndiming())
query("group_axis", f"{PART} select i1 as i1, round(sum(v), 6) as total, round(max(v), 6) as most from a group by i1")(lambda spark, sf_dir: grid(spark, sf_dir).grouped_stats((1,), "sum", "max").select("i1", F.round("sum", 6).alias("total"), F.round("max", 6).alias("most")))
query("group_blocks_mean", f"{PART} select (i0 // 2) * 7 + i1 // 7 as addr, round(avg(v), 6) as v from a where i1 < 49 and i0 < (select max(i0) + 1 from a) // 2 * 2 group by 1")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).block_stat("mean", 2, 7)))
query("group_block_pick", f"{PART} select (i0 // 2) * 10 + i1 // 5 as addr, k as v from a where i0 % 2 = 1 and i1 % 5 = 2")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").block_pick(7, 2, 5).df)
query("group_histogram", f"{PART}, g as (select unnest(range(5))::int as b0), h as (select least(floor((km - 0.0) / 10), 4)::int as b0, count(*)::double as n from a where km is not null group by 1) select g.b0, coalesce(h.n, 0) as n from g left join h using (b0)")(lambda spark, sf_dir: grid(spark, sf_dir, "km").histogram([0, 10, 20, 30, 40]))
query("group_histogram_2d", f"{PART}, g as (select x.b0::int as b0, y.b1::int as b1 from (select unnest(range(3)) as b0) x, (select unnest(range(2)) as b1) y), h as (select least(floor(km / 20), 2)::int as b0, least(floor((w + 12) / 15), 1)::int as b1, round(sum(w), 6) as n from a where km is not null group by 1, 2) select g.b0, g.b1, coalesce(h.n, 0) as n from g left join h using (b0, b1)")(lambda spark, sf_dir: groups.histogram(part(spark, sf_dir).where("km is not null"), [(F.col("km"), [0, 20, 40]), (F.col("w") + 12, [0, 15])], F.col("w")).select("b0", "b1", F.round("n", 6).alias("n")))
query("group_bin_upper", f"{PART} select addr, case when km is not null then nullif(least(ceil(km / 10.0) - 1, 4), -1)::int end as v from a")(lambda spark, sf_dir: part(spark, sf_dir).select("addr", groups.bin_of(F.col("km").cast("double"), [0, 10, 20, 30, 40], include_upper=True).alias("v")))
query("group_classify", f"{PART} select addr, case when km < 10 then -1 when km < 20 then 0 when km < 40 then 1 when km >= 40 then 2 end::int as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "km").classify([10, 20, 40]).df)
query("group_quantize", f"{PART} select addr, cast(floor((v - min(v) over ()) / ((max(v) over () - min(v) over ()) * 8.0 / 7) * 8) as bigint) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir).quantize(8).df)
query("group_incr_addr", f"{PART} select a.addr, a.k + coalesce(c.n, 0) as v from a left join (select km as addr, count(*) as n from a where km is not null group by km) c on c.addr = a.addr")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int64").incr_addr(grid(spark, sf_dir, "km", "int32")).df)
query("group_duplicated_values", f"{PART} select km as value, addr, n from (select km, addr, row_number() over (partition by km order by addr) - 1 as n from a where km is not null) where n > 0")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").duplicated_values())
query("group_outer", "select p.n_nationkey * 5 + q.r_regionkey as addr, cast(p.n_nationkey * q.r_regionkey as double) as v from nation p, region q")(lambda spark, sf_dir: (lambda p, q: p.outer(q))(NDArray.from_table(table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey"), NDArray.from_table(table(spark, sf_dir, "region"), "r_regionkey", "r_regionkey")).df)
query("group_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))

# ---- running values, shifts, windows
_FRAME = "over (order by addr rows between unbounded preceding and current row)"
for _name, (_call, _sql) in {
    "cumsum": (lambda a: a.cumsum(), f"coalesce(sum(v) {_FRAME}, 0)"), "cumcount": (lambda a: a.cumcount(), f"count(v) {_FRAME}"),
    "cummin": (lambda a: a.cummin(), f"coalesce(min(v) {_FRAME}, (select arg_min(v, addr) from e where v is not null))"), "cummax": (lambda a: a.cummax(), f"coalesce(max(v) {_FRAME}, (select arg_min(v, addr) from e where v is not null))"),
    "cumsum_min_count": (lambda a: a.cumsum(min_count=3, fill=-1.0), f"case when count(v) {_FRAME} < 3 then -1 else sum(v) {_FRAME} end"), "cumwsum": (lambda a: a.cumwsum(a), f"coalesce(sum(v * v) {_FRAME}, 0)"),
    "shift": (lambda a: a.shift(2), "coalesce(lag(v, 2) over (order by addr), case when addr < 2 then 0 end)"), "roll": (lambda a: a.roll(3), "(select v from e f where f.addr = (e.addr - 3 + (select count(*) from e)) % (select count(*) from e))"),
    "diff": (lambda a: a.diff(), "v - coalesce(lag(v) over (order by addr), case when addr = 0 then 0 end)"),
    "moving_mean": (lambda a: a.windows("mean", (-2, 2), bounds="mask"), "avg(v) over (order by addr rows between 2 preceding and 2 following)"),
    "moving_max": (lambda a: a.windows("max", (-1, 1), bounds="mask"), "max(v) over (order by addr rows between 1 preceding and 1 following)"),
    "moving_count": (lambda a: a.windows("count_valid", (-1, 1), bounds="mask"), "nullif(count(v) over (order by addr rows between 1 preceding and 1 following), 0)"),
}.items():
    query(f"window_{_name}", f"{EVENTS} select addr, round(cast({_sql} as double), 4) as v from e")(lambda spark, sf_dir, call=_call: rounded_cells(call(vector(spark, sf_dir, "events")), 4))
query("window_cumprod", f"{PART} select addr, round(exp(coalesce(sum(ln(1 + km / 100000.0)) {_FRAME}, 0)), 5) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, 1 + F.col("km") / 100000.0).cumprod(), 5))
query("window_dimcumsum", f"{PART} select addr, round(coalesce(sum(v) over (partition by i0 order by i1 rows between unbounded preceding and current row), 0), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir).dimcumsum(1)))
query("window_dimcumcount", f"{PART} select addr, count(v) over (partition by i0 order by i1 rows between unbounded preceding and current row) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir).dimcumcount(1).df)
query("window_shift_2d", f"{PART} select a.addr, case when b.addr is null then 0 else b.km end as v from a left join a b on b.i0 = a.i0 - 1 and b.i1 = a.i1 + 2")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").shifted(1, -2).df)
query("window_2d_sum", f"{PART} select a.addr, cast(sum(b.k) as double) as v from a join a b on abs(a.i0 - b.i0) <= 1 and abs(a.i1 - b.i1) <= 1 group by a.addr")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, "k", "int32").windows("sum", (-1, 1), (-1, 1))))
query("window_periodic", f"{PART} select a.addr, cast(sum(b.k) as double) as v from a join a b on a.i0 = b.i0 and (b.i1 - a.i1 + 50) % 50 in (0, 1, 49) group by a.addr")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, "k", "int32").windows("sum", (0, 0), (-1, 1), bounds="periodic")))
query("window_rectangle", f"{PART}, c as (select unnest(range(9)) as addr) select c.addr, coalesce(a.k, 0) as v from c left join a on a.i0 = c.addr // 3 - 1 and a.i1 = c.addr % 3 - 1 and c.addr % 3 > 0 and c.addr // 3 > 0")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").window((-1, 1), (-1, 1)).df)

# ---- order
query("order_sort", f"{ORDERS}, r as (select v, row_number() over (order by v, addr) as n from o where v is not null), p as (select addr, row_number() over (order by addr) as n from o where v is not null) select o.addr, r.v from o left join p on p.addr = o.addr left join r on r.n = p.n")(lambda spark, sf_dir: vector(spark, sf_dir).sort().df)
query("order_sort_addr", f"{PART} select row_number() over (order by km nulls last, w, addr) - 1 as addr, addr as source from a")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").sort_addr(grid(spark, sf_dir, "w")))
query("order_rank", f"{ORDERS} select o.addr, r.n as v from o left join (select addr, row_number() over (order by v, addr) - 1 as n from o where v is not null) r on r.addr = o.addr")(lambda spark, sf_dir: vector(spark, sf_dir).order().df)
query("order_rank_down", f"{PART} select a.addr, r.n as v from a left join (select addr, row_number() over (order by km desc, addr desc) - 1 as n from a where km is not null) r on r.addr = a.addr")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").order(-1).df)
query("order_sort_by", f"{PART} select row_number() over (order by k % 10, addr) - 1 as addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").sort_by(F.col("v") % 10).df)
query("order_sort_with", f"{PART} select row_number() over (order by k, addr) - 1 as addr, k as v, round(w, 6) as w0 from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").sort_with(grid(spark, sf_dir, "w")).select("addr", "v", F.round("w0", 6).alias("w0")))
query("order_reverse", f"{PART} select (select count(*) from a) - 1 - addr as addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").reverse().df)
query("order_nlargest", f"{ORDERS} select addr, v from o where v is not null order by v desc, addr limit 10")(lambda spark, sf_dir: vector(spark, sf_dir).nlargest(10))
query("order_nsmallest", f"{ORDERS} select addr, v from o where v is not null order by v, addr limit 10")(lambda spark, sf_dir: vector(spark, sf_dir).nsmallest(10))
query("order_max_by", f"{PART} select arg_max(k, {{x: k % 10, a: -addr}}) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").max_by(F.col("v") % 10))
query("order_min_by", f"{PART} select arg_min(k, {{x: k % 10, a: addr}}) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").min_by(F.col("v") % 10))
query("order_max_with", f"{PART} select km as v, k as w0, round(w, 6) as w1 from a where km is not null order by km desc, addr limit 1")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").max_with(grid(spark, sf_dir, "k", "int32"), grid(spark, sf_dir, "w")).select("v", "w0", F.round("w1", 6).alias("w1")))
query("order_min_with", f"{PART} select km as v, k as w0 from a where km is not null order by km, addr limit 1")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").min_with(grid(spark, sf_dir, "k", "int32")))
query("order_uniq", f"{PART} select km as v, min(addr) as addr from a where km is not null group by km")(lambda spark, sf_dir: grid(spark, sf_dir, "km", "int32").uniq())

# ---- composition and shapes
_N = "(select count(*) from a)"
query("compose_bind", f"{PART} select addr, k as v from a union all select addr + {_N}, k + 1 from a")(lambda spark, sf_dir: (lambda g: compose.bind([g, g.with_value(F.col("v") + 1)]))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_bind_axis1", f"{PART} select i0 * 100 + i1 as addr, k as v from a union all select i0 * 100 + 50 + i1, k + 1 from a")(lambda spark, sf_dir: (lambda g: compose.bind([g, g.with_value(F.col("v") + 1)], 1))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_merge", f"{PART} select addr * 2 as addr, k as v from a union all select addr * 2 + 1, k + 1 from a")(lambda spark, sf_dir: (lambda g: compose.merge([g, g.with_value(F.col("v") + 1)]))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_combine", f"{PART} select i0 * 100 + i1 + j.x * 50 + j.y * {_N} * 2 as addr, k as v from a, (select 0 as x, 0 as y union all select 1, 0 union all select 0, 1 union all select 1, 1) j")(lambda spark, sf_dir: (lambda g: compose.combine([[g, g], [g, g]]))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_join", f"{PART} select addr * 2 as addr, k as v from a union all select addr * 2 + 1, k from a")(lambda spark, sf_dir: (lambda g: compose.join([g.flatten(), g.flatten()]))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_resize", f"{PART}, c as (select unnest(range(60 * 3)) as addr) select c.addr, coalesce(a.k, -1) as v from c left join a on a.i0 = c.addr // 60 and a.i1 = c.addr % 60 and c.addr % 60 < 50")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").resize(3, 60, fill_value=-1).df)
query("compose_insert_block", f"{PART}, c as (select unnest(range({_N} // 50 * 52)) as addr) select c.addr, coalesce(a.k, 0) as v from c left join a on a.i0 = c.addr // 52 and a.i1 = case when c.addr % 52 < 10 then c.addr % 52 when c.addr % 52 >= 12 then c.addr % 52 - 2 end")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").insert_block((0, 10), (0, 2)).df)
query("compose_delete_block", f"{PART} select i0 * 48 + case when i1 > 11 then i1 - 2 else i1 end as addr, k as v from a where i1 not in (10, 11)")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").delete_block((0, 10), (0, 2)).df)
query("compose_paste", f"{PART} select a.addr, coalesce(b.k + 100, a.k) as v from a left join a b on b.i0 = a.i0 - 1 and b.i1 = a.i1 - 48")(lambda spark, sf_dir: (lambda g: g.paste((1, 48), g.with_value(F.col("v") + 100)))(grid(spark, sf_dir, "k", "int32")).df)
query("compose_clip", f"{PART} select (i0 - 1) * 4 + i1 - 5 as addr, k as v from a where i0 between 1 and 2 and i1 between 5 and 8")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").clip((1, 5), (2, 4)).df)
query("compose_split", f"{PART} select i0, string_agg(cast(k as varchar), ' ' order by addr) as v from a group by i0")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").split(0).select("i0", F.array_join("v", " ").alias("v")))
query("shape_transpose", f"{PART} select i1 * ({_N} // 50) + i0 as addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").transpose().df)
query("shape_reshape", f"{PART} select addr // 25 as i0, addr % 25 as i1, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").reshape(-1, 25).indexed().select("i0", "i1", "v"))
query("shape_pull", f"{PART} select addr * 3 + r as addr, k as v from a, (select unnest(range(3)) as r)")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").flatten().pull(None, 3).df)
query("shape_reversed", f"{PART} select ({_N} // 50 - 1 - i0) * 50 + 49 - i1 as addr, k as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int32").reversed().df)
query("record_pack", f"{PART} select addr, k as size, round(w, 6) as price from a")(lambda spark, sf_dir: members(grid(spark, sf_dir, "k", "int32").pack(grid(spark, sf_dir, "w"), names=["size", "price"])).select("addr", "size", F.round("price", 6).alias("price")))

# ---- generators
query("generate_arange", "select unnest(range(0, 50)) as addr, unnest(range(5, 105, 2)) as v")(lambda spark, sf_dir: create.arange(spark, 5, 105, 2).df)
query("generate_linspace", "select i as addr, round(1 + i * 0.25, 6) as v from (select unnest(range(0, 21)) as i)")(lambda spark, sf_dir: rounded_cells(create.linspace(spark, 1, 6, 21)))
query("generate_span", "select i as addr, 9 - i as v from (select unnest(range(0, 10)) as i)")(lambda spark, sf_dir: create.span(spark, 9, 0).df)
query("generate_full", "select i as addr, cast(7 as bigint) as v from (select unnest(range(0, 6)) as i)")(lambda spark, sf_dir: create.full(spark, (2, 3), 7).df)
query("generate_zeros", "select i as addr, 0.0::double as v from (select unnest(range(0, 6)) as i)")(lambda spark, sf_dir: create.zeros(spark, 2, 3).df)
query("generate_ones", "select i as addr, 1.0::double as v from (select unnest(range(0, 6)) as i)")(lambda spark, sf_dir: create.ones(spark, 2, 3).df)
query("generate_eye", "select i as addr, case when i // 4 + 1 = i % 4 then 1.0 else 0.0 end::double as v from (select unnest(range(0, 12)) as i)")(lambda spark, sf_dir: create.eye(spark, 3, 4, 1).df)
query("generate_seq", f"{PART} select addr, cast(addr * 3 + 2 as bigint) as v from a")(lambda spark, sf_dir: grid(spark, sf_dir, "k", "int64").seq(2, 3).df)
query("generate_scale", f"{PART} select addr, round(1 + addr * (4.0 / ({_N} - 1)), 6) as v from a")(lambda spark, sf_dir: rounded_cells(grid(spark, sf_dir, "k").scale(1, 5)))
query("generate_span_fill", "select i as addr, cast(1 + floor(i * 5 / 10.0) as bigint) as v from (select unnest(range(0, 10)) as i)")(lambda spark, sf_dir: create.zeros(spark, 10, kind="int64").span(1, 5).df)
query("generate_meshgrid", "select n_nationkey * 5 + r_regionkey as addr, cast(r_regionkey as double) as v from nation, region")(lambda spark, sf_dir: create.meshgrid(NDArray.from_table(table(spark, sf_dir, "region"), "r_regionkey", "r_regionkey"), NDArray.from_table(table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey"))[0].df)
query("generate_recurrence", "with recursive f as (select 0::bigint as addr, 0.0::double as v, 1.0::double as w union all select addr + 1, w, v + w from f where addr < 19) select addr, v from f")(lambda spark, sf_dir: create.recurrence(spark, 20, [0, 1], "element_at(a, -1) + element_at(a, -2)").df)
query("generate_parse", "select c_custkey, 0 as row, 0 as column, cast(c_nationkey as double) as v from customer union all select c_custkey, 1, 0, null from customer")(lambda spark, sf_dir: create.parsed(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit("; _")).alias("s")), "s", "c_custkey"))
query("generate_random")(lambda spark, sf_dir: create.random(spark, (100, 10), 1).df)
query("generate_randomn")(lambda spark, sf_dir: create.randomn(spark, (100, 10), 1).df)

# ---- user functions, records, containers, vectors
query("udf_map", f"{PART} select addr, round(v * 2 + 1, 6) as v from a")(lambda spark, sf_dir: rounded_cells(udf.map_values(grid(spark, sf_dir), lambda v: v * 2 + 1)))
query("udf_map_with_addr", f"{PART} select addr, round(v + addr, 6) as v from a")(lambda spark, sf_dir: rounded_cells(udf.map_with_addr(grid(spark, sf_dir), lambda v, a: v + a)))
query("udf_outputs", f"{PART} select addr, round(v + w, 6) as total, round(v - w, 6) as apart from a")(lambda spark, sf_dir: udf.outputs(grid(spark, sf_dir), lambda v, w: {"total": v + w, "apart": v - w}, ["total", "apart"], grid(spark, sf_dir, "w")).select("addr", F.round("total", 6).alias("total"), F.round("apart", 6).alias("apart")))
query("udf_calculate", f"{PART} select i0, round(max(w) - min(w), 6) as v from a group by i0")(lambda spark, sf_dir: udf.calculate(grid(spark, sf_dir, "w"), (0,), lambda v: v.max() - v.min()).select("i0", F.round("v", 6).alias("v")))
query("udf_filter_groups", f"{PART} select addr, round(w - first_value(w) over (partition by i0 order by i1), 6) as v from a")(lambda spark, sf_dir: rounded_cells(udf.filter_groups(grid(spark, sf_dir, "w"), (0,), lambda v: v - v[0])))
query("udf_inject", "select cast(sum(n_nationkey) as double) as v from nation")(lambda spark, sf_dir: udf.inject(NDArray.from_table(table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey"), 0, "acc + x"))
_RECORD = Record(("a", "uint8"), ("b", "int32"), ("c", "fixlen", 3), pack=1)
query("record_decode", f"{PART} select addr, k as b from a")(lambda spark, sf_dir: _RECORD.decode_column(part(spark, sf_dir).select("addr", F.unhex(F.concat(F.lit("07"), F.lpad(F.hex("k"), 2, "0"), F.lit("000000616263"))).alias("v")), "v").select("addr", "v.b"))
query("container_cells", "select i as addr, i * 1.5::double as v from (select unnest(range(0, 6)) as i)")(lambda spark, sf_dir: (lambda got: NDArray.from_list(spark, got[0].tolist(), "float64").df)(container.load(container.dump(create_values(), "float64"))))
query("vector_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) as v from embeddings")(lambda spark, sf_dir: table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(F.transform("embedding", lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda s, e: s + e)), 5).alias("v")))
query("vector_axis_mean", "select label, round(avg(embedding[1]), 5) as v from embeddings group by label")(lambda spark, sf_dir: table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 5).alias("v")))
query("stream_tumbling", "select time_bucket(interval 1 hour, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1")(lambda spark, sf_dir: streams.windowed(table(spark, sf_dir, "events"), "ts", "1 hour").select("start", "n", F.round("total", 4).alias("total")))
query("stream_sessions", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")(lambda spark, sf_dir: streams.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id").select("user_id", "start", "n"))


def create_values():
    import numpy as np

    return np.arange(6) * 1.5


@query("revenue_by_flag", "select l_returnflag, round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.05 and 0.07 group by l_returnflag")
def revenue_by_flag(spark, sf_dir):
    """Revenue of a range of discounts by flag: filter and projection reach the scan."""
    d = table(spark, sf_dir, "lineitem").where(F.col("l_discount").between(0.05, 0.07))
    return d.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("lineitem_histogram", "select least(floor(l_quantity / 10), 5)::int as b0, count(*)::double as n from lineitem group by 1")
def lineitem_histogram(spark, sf_dir):
    return groups.histogram(table(spark, sf_dir, "lineitem"), [(F.col("l_quantity"), [0, 10, 20, 30, 40, 50])]).where("n > 0")


@query("semi_contains", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_contains(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


from . import queries_more  # noqa: E402, F401
