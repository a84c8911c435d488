"""Texts: addresses, names, and SQL pieces that other databases have under other names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before_comma(s: Column) -> Column:
    """Text before the first comma; NULL without a comma."""
    at = F.instr(s, ",")
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1))


def after_comma(s: Column, trim: bool = True) -> Column:
    """Text after the first comma; NULL without a comma."""
    at = F.instr(s, ",")
    rest = F.when(at > 0, F.substr(s, at + 1))
    return F.trim(rest) if trim else rest


def part_from_right(s: Column, n: int, most: int = 4) -> Column:
    """The n-th part from the right of a text cut at commas and points, trimmed; NULL if there are more than ``most``
    parts or fewer than n."""
    parts = F.split(s, "[,.]")
    return F.when(F.size(parts) <= most, F.trim(F.try_element_at(parts, F.lit(-n))))


def capitalize_first(s: Column) -> Column:
    """First letter upper, all others lower: MARY ANN gives Mary ann."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def same_text(a: Column, b: Column | str) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b if isinstance(b, Column) else F.lit(b))


def full_name(first: Column, last: Column) -> Column:
    """NULL if either is NULL."""
    return F.concat(first, F.lit(" "), last)
