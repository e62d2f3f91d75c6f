"""Text of quantities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of 1024 steps.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_blanks(text: Column) -> Column:
    """Drop Unicode blanks, and the separators U+001C to U+001F, from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _two_decimals(count: Column, size: int) -> Column:
    """count / size with two decimals, exact halves to the even digit."""
    unit = F.lit(size).cast("decimal(20,0)")
    rest = (count * 100) % unit
    whole = ((count * 100 - rest) / unit).cast("decimal(24,0)")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    cents = (whole + F.when(up, 1).otherwise(0)).cast("decimal(24,0)")
    return F.concat(
        ((cents - cents % 100) / 100).cast("decimal(24,0)").cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("decimal(2,0)").cast("string"), 2, "0"),
    )


def bytes_text(n: Column) -> Column:
    """A byte count as text with two decimals.

    Whole-number arithmetic, since printf-style formatting rounds exact halves up.
    """
    count = n.cast("double").cast("decimal(20,0)")
    text = F.concat(_two_decimals(count, 1024**5), F.lit(" PB"))
    for power in range(4, 0, -1):
        piece = F.concat(_two_decimals(count, 1024**power), F.lit(f" {BYTE_UNITS[power]}"))
        text = F.when(count < F.lit(1024 ** (power + 1)).cast("decimal(20,0)"), piece).otherwise(text)
    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(".00 B"))).otherwise(text)


def duration_text(seconds: Column) -> Column:
    """Seconds as text; from a day up the seconds are left out."""
    whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    hours = F.floor(minutes / 60).cast("bigint")
    days = F.floor(hours / 24).cast("bigint")

    def text(*parts: tuple[Column, str]) -> Column:
        return F.concat_ws(" ", *[F.concat(value.cast("string"), F.lit(unit)) for value, unit in parts])

    return (
        F.when(whole < 60, text((whole, "s")))
        .when(minutes < 60, text((minutes, "m"), (whole % 60, "s")))
        .when(hours < 24, text((hours, "h"), (minutes % 60, "m"), (whole % 60, "s")))
        .when(whole.isNotNull(), text((days, "d"), (hours % 24, "h"), (minutes % 60, "m")))
    )
