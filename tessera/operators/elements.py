"""Element-wise operations and masks on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.types import SPARK, canonical, cast, is_integer, promote, wrap

COMPARE = {"eq": S.eq, "ne": S.ne, "gt": S.gt, "lt": S.lt, "ge": S.ge, "le": S.le, "feq": S.feq}
LOGIC = {"and_": S.logical_and, "or_": S.logical_or, "xor": S.logical_xor}
EXACT = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
COMPLEX = {"add": S.c_add, "sub": S.c_sub, "mul": S.c_mul, "div": S.c_div, "pow": S.c_pow}
BITWISE = {"bit_and": S.bit_and, "bit_or": S.bit_or, "bit_xor": S.bit_xor}


class Elements:
    """Methods of NDArray."""

    def with_value(self, value: Column, kind: str | None = None):
        kind = canonical(kind or self.kind)
        return self.like(self.df.select("addr", value.alias("v")), kind=kind)

    def zip_with(self, other, f, kind: str):
        """f on this array's and another's values at equal addresses (a scalar stands for all)."""
        from ..plans.array import NDArray

        if not isinstance(other, NDArray):
            return self.with_value(f(F.col("v"), S.lit(other)), kind)
        known = [s for s in (self._shape, other._shape) if None not in s]
        if len(known) == 2 and known[0] != known[1]:
            raise ValueError(f"shapes {self._shape} and {other._shape} differ")
        joined = self.df.select("addr", "v").join(other.df.select("addr", F.col("v").alias("w")), "addr")
        return self.like(joined.select("addr", f(F.col("v"), F.col("w")).alias("v")), kind=canonical(kind))

    def _kind_with(self, other) -> str:
        from ..plans.array import NDArray
        from .create import guess_kind

        if isinstance(other, NDArray):
            return promote(self.kind, other.kind)
        return promote(self.kind, guess_kind([other]), scalar=True)

    def _binary(self, name: str, other):
        kind = self._kind_with(other)
        if kind.startswith("cmplx"):
            return self.as_type(kind).zip_with(other.as_type(kind), COMPLEX[name], kind)
        if is_integer(kind):
            if name == "div":
                return self.zip_with(other, S.int_div, kind)
            if name in EXACT:
                f = EXACT[name]
                return self.zip_with(other, lambda a, b: wrap(f(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")), kind), kind)
        if name == "pow":
            if is_integer(kind) and isinstance(other, int):
                return self.with_value(wrap(S.int_power(F.col("v"), other), kind), kind)
            return self.zip_with(other, S.power, "float64")
        f = {**EXACT, "div": S.div, "mod": S.mod, "remainder": S.remainder, "pmax": S.pmax, "pmin": S.pmin}[name]
        return self.zip_with(other, lambda a, b: f(a.cast(SPARK[kind]), b.cast(SPARK[kind])).cast(SPARK[kind]), kind)

    def add(self, other):
        return self._binary("add", other)

    def sub(self, other):
        return self._binary("sub", other)

    def mul(self, other):
        return self._binary("mul", other)

    def div(self, other):
        return self._binary("div", other)

    def mod(self, other):
        return self._binary("mod", other)

    def pow(self, other):
        return self._binary("pow", other)

    def reminder(self, other):
        return self._binary("remainder", other)

    def pmax(self, other):
        return self._binary("pmax", other)

    def pmin(self, other):
        return self._binary("pmin", other)

    __add__, __sub__, __mul__, __truediv__, __mod__, __pow__ = add, sub, mul, div, mod, pow

    def compare(self, name: str, other):
        return self.zip_with(other, COMPARE[name], "boolean")

    def logic(self, name: str, other):
        return self.zip_with(other, LOGIC[name], "boolean")

    def bitwise(self, name: str, other):
        return self.zip_with(other, BITWISE[name], self._kind_with(other))

    def apply(self, name: str):
        """A function of one argument by name; integers become doubles where the function has no integer form."""
        value = F.col("v")
        if is_integer(self.kind) and name in ("neg", "abs", "sign"):
            return self.with_value(wrap(S.UNARY[name](value.cast("decimal(38,0)")), self.kind))
        return self.with_value(S.UNARY[name](value.cast("double")), self.kind if self.kind.startswith("float") else "float64")

    def trim(self, low=None, high=None, fill=..., mask: bool = False):
        return self.with_value(S.trim(F.col("v"), low, high, fill, mask))

    def as_type(self, kind: str):
        return self.with_value(cast(F.col("v"), kind, self.kind), kind)

    to_type = as_type

    def convert(self, f, kind: str | None = None):
        """f: from a column to a column; masked stays masked."""
        return self.with_value(F.when(F.col("v").isNotNull(), f(F.col("v"))), kind)

    def fill(self, value):
        return self.with_value(F.lit(value).cast(SPARK[self.kind]))

    template = fill

    def seq(self, init=0, step=1):
        kind = SPARK[self.kind]
        value = F.col("addr") * F.lit(step) + F.lit(init)
        return self.with_value(cast(value.cast("double"), self.kind, "float64") if is_integer(self.kind) else value.cast(kind))

    def scale(self, first: float, last: float):
        n = self.elements
        return self.with_value((F.lit(float(first)) + F.col("addr") * ((last - first) / (n - 1))), "float64")

    def span(self, first: int, last: int, exclude_end: bool = False):
        """Fills the cells to cover the range; integers take the floor of a rational step."""
        n = self.elements
        if is_integer(self.kind):
            width = last - first + (0 if exclude_end else 1)
            return self.with_value((F.lit(first) + F.floor(F.col("addr") * width / n)).cast(SPARK[self.kind]))
        return self.with_value(F.lit(float(first)) + F.col("addr") * ((last - first) / (n if exclude_end else n - 1)))

    # masks

    def with_mask(self, masked: Column):
        """Masks cells and keeps their values underneath."""
        raw = F.col("raw") if "raw" in self.df.columns else F.col("v")
        return self.like(self.df.select("addr", F.when(~F.coalesce(masked, F.lit(False)), raw).alias("v"), raw.alias("raw")))

    @property
    def value(self):
        """The values, also those under the mask."""
        return self.with_value(F.col("raw") if "raw" in self.df.columns else F.col("v"))

    @property
    def mask(self):
        return self.with_value(F.col("v").isNull(), "boolean")

    is_masked = mask

    @property
    def is_not_masked(self):
        return self.with_value(F.col("v").isNotNull(), "boolean")

    def unmask(self, fill=None):
        """Fills masked cells; without a fill it shows the values under the mask."""
        return self.value if fill is None else self.with_value(F.coalesce(F.col("v"), F.lit(fill)).cast(SPARK[self.kind]))

    unmask_copy = unmask

    def maskout(self, where: Column | None = None, value=None):
        """Masks cells where the condition holds, or those equal to the value."""
        condition = where if where is not None else S.eq_any(F.col("v"), value)
        return self.with_mask(F.col("v").isNull() | condition)

    def invert_mask(self):
        return self.like(self.df.select("addr", F.when(F.col("v").isNull(), F.col("raw")).alias("v"), "raw"))

    def inherit_mask(self, *others, replace: bool = False):
        """Masks what any of the others masks; with replace only that."""
        df = self.df.select("addr", (F.col("raw") if replace and "raw" in self.df.columns else F.col("v")).alias("v"))
        for k, o in enumerate(others):
            df = df.join(o.df.select("addr", F.col("v").isNull().alias(f"m{k}")), "addr")
        any_ = F.lit(False)
        for k in range(len(others)):
            any_ = any_ | F.col(f"m{k}")
        return self.like(df.select("addr", F.when(~any_, F.col("v")).alias("v")))

    def any_masked(self):
        return self.df.agg(F.coalesce(F.bool_or(F.col("v").isNull()), F.lit(False)).alias("v"))

    def all_masked(self):
        return self.df.agg(F.coalesce(F.bool_and(F.col("v").isNull()), F.lit(True)).alias("v"))

    def guard(self, f, fill, *others):
        """f of all values where none is masked, else the fill."""
        df = self.df.select("addr", "v")
        names = []
        for k, o in enumerate(others):
            df = df.join(o.df.select("addr", F.col("v").alias(f"o{k}")), "addr")
            names.append(F.col(f"o{k}"))
        ok = F.col("v").isNotNull()
        for c in names:
            ok = ok & c.isNotNull()
        return self.like(df.select("addr", F.when(ok, f(F.col("v"), *names)).otherwise(F.lit(fill)).alias("v")))
