"""Saturating counters, number formatting and levels of concern.

A counter stops at its cap, and a counter at its cap has overflowed. Sums of
non-negative numbers may be clamped once, after adding.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CAP32, CAP64 = 2**32 - 1, 2**64 - 1
WIDE = "decimal(20,0)"
MOST_STARS = 30

#: Prefix systems: fixed names and steps.
METRIC = ("metric", 1000, ("", "k", "M", "G", "T", "P"))
BINARY = ("binary", 1024, ("", "Ki", "Mi", "Gi", "Ti", "Pi"))
SYSTEMS = {"metric": METRIC, "binary": BINARY}


def clamp32(x: Column) -> Column:
    """A null stays null."""
    return F.when(x > CAP32, CAP32).otherwise(x).cast("bigint")


def clamp64(x: Column) -> Column:
    wide, cap = x.cast("decimal(38,0)"), F.lit(Decimal(CAP64))
    return F.when(wide > cap, cap).otherwise(wide).cast(WIDE)


def sum32(x: Column) -> Column:
    """The clamped sum, 0 without rows; each number counts as its own clamped value, so 2^31 of them fit."""
    return clamp32(F.coalesce(F.sum(clamp32(x)), F.lit(0)))


def sum64(x: Column, narrow: bool = False) -> Column:
    """The clamped sum, 0 without rows. Numbers of 32 bits (narrow) add up without decimals, 2^31 of them at least."""
    if narrow:
        return F.coalesce(F.sum(x.cast("bigint")), F.lit(0)).cast(WIDE)
    return clamp64(F.coalesce(F.sum(x.cast(WIDE)), F.lit(Decimal(0))))


def count32(x: Column | None = None) -> Column:
    return clamp32(F.count(F.lit(1) if x is None else x))


def add32(*xs: Column) -> Column:
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return clamp32(total)


def overflowed(x: Column, cap: int) -> Column:
    return x.cast("decimal(20,0)") == F.lit(Decimal(cap))


def first_max(oid: Column, metric: Column, order: Column) -> Column:
    """The witness of a strict maximum: the first in order; none if the maximum is 0."""
    return F.when(F.max(metric) > 0, F.max_by(oid, F.struct(metric, -order)))


def last_max(oid: Column, metric: Column, order: Column) -> Column:
    """The witness of a lax maximum over rows that come in descending order: the last one that reaches it, even 0."""
    return F.max_by(oid, F.struct(metric, -order))


def level(value: Column, scale: Column) -> Column:
    return value.cast("double") / scale


def stars(value: Column, scale: Column, overflow: Column) -> Column:
    """Stars of concern; exclamation marks above MOST_STARS or on overflow."""
    marks = F.repeat(F.lit("!"), MOST_STARS)
    return F.when(overflow | (level(value, scale) > MOST_STARS), marks).otherwise(F.repeat(F.lit("*"), F.floor(level(value, scale)).cast("int")))


def format_number(n: int, system: tuple[str, int, tuple[str, ...]], unit: str = "") -> tuple[str, str]:
    """(numeral, unit with prefix): the largest prefix that leaves at least 1, three digits, rounded half to even."""
    _, step, prefixes = system
    power = 0
    while power + 1 < len(prefixes) and n // step ** (power + 1) >= 1:
        power += 1
    if not power:
        return str(n), unit
    whole, exact = n // step**power, n / step**power
    return f"{exact:.{0 if whole >= 100 else 1 if whole >= 10 else 2}f}", prefixes[power] + unit


def format_counter(n: int, cap: int, system: tuple[str, int, tuple[str, ...]], unit: str = "") -> tuple[str, str]:
    """As format_number; a counter at its cap is infinite."""
    return ("∞", unit) if n >= cap else format_number(n, system, unit)


def formatted(value: Column, system: str, unit: str = "") -> Column:
    """The numeral and its unit, one blank between, as a column; rounds as format_number does, in Arrow batches."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda n: " ".join(format_number(int(n), SYSTEMS[system], unit)).rstrip(), na_action="ignore")

    return of(value.cast("string"))
