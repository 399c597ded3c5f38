"""Functions of times; masked stays masked."""

from __future__ import annotations

from pyspark.sql import functions as F

#: strptime and strftime directives as Java patterns; fixed values.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "E", "j": "DDD", "I": "hh", "p": "a", "L": "SSS", "N": "SSSSSS", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "e": "d", "%": "%"}


def pattern(directives: str) -> str:
    """A strftime format as a Java date pattern."""
    out, i = "", 0
    while i < len(directives):
        c = directives[i]
        if c == "%" and i + 1 < len(directives):
            i += 1
            if directives[i] not in DIRECTIVES:
                raise ValueError(f"unknown directive %{directives[i]}")
            out += DIRECTIVES[directives[i]]
        elif c == "'":
            out += "''"
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


def strptime(s, fmt):
    """Masked where the text doesn't fit."""
    return F.try_to_timestamp(s, F.lit(pattern(fmt)))


def to_time(s, fmt=None):
    return F.try_to_timestamp(s) if fmt is None else strptime(s, fmt)


def to_datetime(s, fmt=None):
    """Fails where the text doesn't fit."""
    return F.to_timestamp(s) if fmt is None else F.to_timestamp(s, pattern(fmt))


def strftime(t, fmt):
    return F.date_format(t, pattern(fmt))


year, month, day, hour, minute = F.year, F.month, F.dayofmonth, F.hour, F.minute


def second(t):
    return F.extract(F.lit("SECOND"), t).cast("double")


def jd(t):
    return F.unix_date(t.cast("date")) + 2440588


def ajd(t):
    return F.unix_micros(t.cast("timestamp")) / 86400e6 + 2440587.5


def is_leap(t):
    y = F.year(t)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
