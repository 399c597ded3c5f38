"""String functions; masked strings stay masked. Patterns are Java's, character sets those of a bracket expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def length(s):
    return F.char_length(s)


def bytesize(s):
    return F.octet_length(s)


def gsub(s, pattern, replacement, literal: bool = False):
    return F.replace(s, F.lit(pattern), F.lit(replacement)) if literal else F.regexp_replace(s, pattern, replacement)


def sub(s, pattern, replacement):
    """Replaces the first match; the pattern has no groups of its own."""
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def encode(s, charset):
    return F.encode(s, charset)


def decode(b, charset):
    return F.decode(b, charset)


def encoding(s):
    return F.when(s.isNotNull(), F.lit("UTF-8"))


def is_end_with(s, *suffixes):
    return F.when(s.isNotNull(), any_of(s.endswith(x) for x in suffixes))


def is_start_with(s, *prefixes):
    return F.when(s.isNotNull(), any_of(s.startswith(x) for x in prefixes))


def includes(s, part):
    return s.contains(part)


def index(s, part, start: int = 0):
    """Place of the first occurrence from start on; masked if there is none."""
    return F.nullif(F.locate(part, s, start + 1) - 1, F.lit(-1))


def rindex(s, part):
    at = F.locate(part[::-1], F.reverse(s))
    return F.when(at > 0, F.char_length(s) - at - len(part) + 1)


def intern(s):
    return s


def scrub(b):
    return F.make_valid_utf8(b)


def downcase(s):
    return F.lower(s)


def upcase(s):
    return F.upper(s)


def capitalize(s):
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def swapcase(s):
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(s, low + up, up + low)


def chomp(s, suffix: str | None = None):
    if suffix is None:
        return F.regexp_replace(s, r"(\r\n|\n|\r)\z", "")
    return delete_suffix(s, suffix)


def chop(s):
    n = F.when(s.endswith("\r\n"), 2).otherwise(1)
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))


def first_char(s):
    return F.substring(s, 1, 1)


def clear(s):
    return F.when(s.isNotNull(), F.lit(""))


def count(s, chars):
    return F.regexp_count(s, F.lit(f"[{chars}]"))


def delete(s, chars):
    return F.regexp_replace(s, f"[{chars}]", "")


def delete_prefix(s, prefix):
    return F.when(s.startswith(prefix), F.substring(s, F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def delete_suffix(s, suffix):
    return F.when(s.endswith(suffix), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def dump(s):
    """In double quotes, with escapes."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, told in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(told))
    return F.concat(F.lit('"'), out, F.lit('"'))


def ljust(s, width: int, pad: str = " "):
    return F.when(F.length(s) < width, F.rpad(s, width, pad)).otherwise(s)


def rjust(s, width: int, pad: str = " "):
    return F.when(F.length(s) < width, F.lpad(s, width, pad)).otherwise(s)


def center(s, width: int, pad: str = " "):
    """The odd pad goes to the right."""
    room = F.lit(width) - F.length(s)
    left = F.call_function("div", room, F.lit(2)).cast("int")
    fill = F.repeat(F.lit(pad), F.lit(width))
    return F.when(room > 0, F.concat(F.substring(fill, F.lit(1), left), s, F.substring(fill, F.lit(1), room - left))).otherwise(s)


def to_i(s):
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0)))


def to_f(s):
    return F.when(s.isNotNull(), F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def to_r(s):
    """struct<num, den>"""
    den = F.regexp_extract(s, r"^\s*[+-]?\d+/(\d+)", 1).try_cast("bigint")
    return F.when(s.isNotNull(), F.struct(to_i(s).alias("num"), F.coalesce(den, F.lit(1)).alias("den")))


def strip(s):
    return rstrip(lstrip(s))


def rstrip(s):
    return F.regexp_replace(s, r"[\s\x00]+\z", "")


def lstrip(s):
    return F.regexp_replace(s, r"^\s+", "")


def is_empty(s):
    return s == ""


def matches(s, pattern):
    return s.rlike(pattern)


def extract(s, pattern, template: str = r"\0"):
    """The first match written by the template (\\0, \\1, ...), or an empty string."""
    parts = [F.regexp_extract(s, pattern, int(p[1:])) if re.fullmatch(r"\\\d", p) else F.lit(p) for p in re.split(r"(\\\d)", template) if p]
    return F.when(s.rlike(pattern), F.concat(*parts)).when(s.isNotNull(), F.lit(""))


def formatted(value, addr, *formats):
    """printf; several formats take turns by address."""
    out = F.when(F.lit(False), F.lit(""))
    for k, f in enumerate(formats):
        out = out.when(addr % len(formats) == k, F.format_string(f, value))
    return F.when(value.isNotNull(), out)


def format_columns(fmt, *columns):
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull()
    return F.when(ok, F.format_string(fmt, *columns))
