"""Intervals, ranges, chromosomes and positions as column expressions. Coordinates are closed and start at 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(first: Column, second: Column, kind: Column | None = None) -> Column:
    """A struct (low, high, sign, type): sign is 1 where first is below second, -1 above, 0 for a point."""
    sign = F.signum((second - first).cast("double")).cast("int")
    return F.struct(F.least(first, second).alias("low"), F.greatest(first, second).alias("high"), sign.alias("sign"), (F.lit(None).cast("string") if kind is None else kind).alias("type"))


def width(low: Column, high: Column) -> Column:
    return high - low + 1


def contains(low: Column, high: Column, position: Column) -> Column:
    return (low <= position) & (position <= high)


def overlaps(low: Column, high: Column, x: Column, y: Column) -> Column:
    return (x <= high) & (y >= low)


_RANGE = r"^(?:([^:]+):)?([\d,]+)(?:(\.\.|--|\+-|\+)([\d,]+))?$"


def parse_range(text: Column) -> Column:
    """A struct (div, low, high, sign) of chr:a..b, a..b, a, a+length, a+-length or a--b; null if it is none of them.

    b below a means the reverse strand; a+length starts at a, a+-length ends there in reverse.
    """
    part = [F.regexp_extract(text, _RANGE, i) for i in range(1, 5)]
    a = F.regexp_replace(part[1], ",", "").try_cast("long")
    b = F.regexp_replace(part[3], ",", "").try_cast("long")
    second = F.when(part[2] == "+", a + b - 1).when(part[2] == "+-", a - b + 1).when(part[2] == "", a).otherwise(b)
    found = interval(a, second)
    sign = F.when(part[2] == "+-", F.lit(-1)).when(part[2] == "+", F.lit(1)).otherwise(found["sign"])
    return F.when(text.rlike(_RANGE), F.struct(part[0].alias("div"), found["low"].alias("low"), found["high"].alias("high"), sign.alias("sign")))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def fold_circular(position: Column, length: Column) -> Column:
    """A position on a circular sequence, from 1 to length."""
    return F.pmod(position - 1, length) + 1


#: Chromosome classes in their order.
CLASSES = ("numeric", "sex", "mitochondrial", "numeric_alpha", "alpha")


def chromosome_key(name: Column) -> Column:
    """A struct (class, number, rest) that sorts chromosomes: numbers, X and Y, M, numbers with letters, other names.

    A leading chr is ignored. Numbers have up to four digits and do not start with 0.
    """
    bare = F.regexp_replace(name, "^chr", "")
    number = F.regexp_extract(bare, r"^([1-9]\d{0,3})(?!\d)", 1)
    rest = F.substring(bare, F.length(number) + 1, F.length(bare))
    klass = (
        F.when((number != "") & (rest == ""), 0).when(bare.isin("X", "Y"), 1).when(bare.isin("M", "MT"), 2).when(number != "", 3).otherwise(4)
    )
    return F.struct(klass.alias("class"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("number"), F.when(number != "", rest).otherwise(bare).alias("rest"))


def insert_length(low_end: Column, high_start: Column, length1: Column, length2: Column) -> Column:
    """From the outer end of one read to that of its mate: the gap between them (below 0 where they overlap) and both lengths."""
    return high_start - low_end - 1 + length1 + length2
