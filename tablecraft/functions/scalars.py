"""Numbers, casts and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def to_int(text: Column, strict: bool = False) -> Column:
    """Text to int. Text that is no number gives NULL, or raises if ``strict``."""
    return text.cast("int") if strict else text.try_cast("int")


def if_flag(flag: Column, label: str) -> Column:
    """The label where the flag holds, else an empty text."""
    return F.when(flag, label).otherwise("")


def recode(value: Column, names: dict[str, str]) -> Column:
    """Values by a short dictionary; others stay as they are."""
    first, *rest = names.items()
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), rest, F.when(value == first[0], first[1])).otherwise(value)


def rate_band(value: Column) -> Column:
    """Below 1 'Bad', 1 to 3 'Good', above 'Excellent'; NULL is 'Excellent' as well, since no comparison holds."""
    return F.when(value < 1, "Bad").when(value.between(1, 3), "Good").otherwise("Excellent")


def label_pct(value: Column, digits: int = 2) -> Column:
    """A number as text with a per cent sign."""
    return F.concat(F.format_number(value, digits), F.lit("%"))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def whole_years(days: Column) -> Column:
    """Days / 365 without the fraction."""
    return (days / 365).cast("int")


def gigabytes(size: Column, digits: int = 1) -> Column:
    """Bytes in GiB, cut down after ``digits`` digits."""
    return (F.floor(size / F.pow(F.lit(1024.0), F.lit(3.0)) * 10**digits) / 10**digits).cast("double")


def mask(value: Column, role: str, hidden_from: tuple[str, ...] = ("JUNIOR_DBA",), shown: str = "*******") -> Column:
    """The value, or stars for the roles it is hidden from."""
    return F.lit(shown) if role in hidden_from else value
