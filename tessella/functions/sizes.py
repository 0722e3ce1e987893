"""Sizes and time spans as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text forms.
UNITS = ["E", "P", "T", "G", "M", "K", "B"]
SPANS = [("y", 31557600000000000), ("month", 2629800000000000), ("w", 604800000000000), ("d", 86400000000000), ("h", 3600000000000), ("min", 60000000000), ("s", 1000000000), ("ms", 1000000), ("us", 1000), ("ns", 1)]

_PART = re.compile(r"\s*(\d+)(?:\.(\d*))?\s*([EPTGMKB]?)")


def parse_size(text: str) -> int:
    """Bytes of `64K`, `1.5M` or `1M512K`; units are powers of 1024 in descending order."""
    rest, total, before = text.strip(), 0, len(UNITS) + 1
    if not rest:
        raise ValueError("a size is missing")
    rank = len(UNITS)
    last = -1
    while rest:
        m = _PART.match(rest)
        if not m:
            raise ValueError(f"{text!r} isn't a size")
        at = UNITS.index(m[3] or "B")
        if at <= last:
            raise ValueError(f"the units of {text!r} aren't in descending order")
        last, unit = at, 1024 ** (len(UNITS) - 1 - at)
        total += int(m[1]) * unit + (int(m[2]) * unit // 10 ** len(m[2]) if m[2] else 0)
        rest = rest[m.end() :].lstrip()
    if total >= 1 << 64:
        raise ValueError(f"{text!r} is too large")
    return total


def format_size(col: Column) -> Column:
    """`1.5M` with one digit after the point, cut off and not rounded; `12B` below 1024. Null stays null."""
    out = F.concat(col.cast("string"), F.lit("B"))
    for k, unit in reversed(list(enumerate(UNITS[:-1]))):
        factor = F.lit(1024 ** (len(UNITS) - 1 - k))
        whole = ((col - F.pmod(col, factor)) / factor).cast("long")
        # The remainder is below 2^60, so ten times it only fits a decimal.
        tenths, one = F.pmod(col, factor).cast("decimal(20,0)") * 10, factor.cast("decimal(20,0)")
        tenth = ((tenths - F.pmod(tenths, one)) / one).cast("int")
        out = F.when(col >= factor, F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"), F.lit(unit))).otherwise(out)
    return out


def format_timespan(ns: Column, accuracy: int = 1) -> Column:
    """`1h 2min 3.500s` of nanoseconds, `0` for none. What is left below a minute is
    one number with as many digits as `accuracy`, a power of ten in nanoseconds, leaves. Null stays null."""
    parts, left = [], ns
    for name, unit in SPANS[:6]:
        parts.append(F.when(left >= unit, F.concat(((left - F.pmod(left, F.lit(unit))) / F.lit(unit)).cast("long").cast("string"), F.lit(name))))
        left = F.pmod(left, F.lit(unit))
    last = F.lit(None).cast("string")
    for name, unit in reversed(SPANS[6:]):
        digits = len(str(unit)) - len(str(accuracy))
        rest = F.pmod(left, F.lit(unit))
        text = ((left - rest) / F.lit(unit)).cast("long").cast("string")
        if digits > 0:
            text = F.when(rest > 0, F.concat(text, F.lit("."), F.lpad(F.floor(rest / F.lit(accuracy)).cast("string"), digits, "0"))).otherwise(text)
        last = F.when(left >= unit, F.concat(text, F.lit(name))).otherwise(last)
    shown = (left >= accuracy) | (ns < SPANS[5][1])
    return F.when(ns == 0, F.lit("0")).when(ns.isNotNull(), F.concat_ws(" ", *parts, F.when(shown, last)))
