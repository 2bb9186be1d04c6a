"""Number and text formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abbreviated(x: Column) -> Column:
    """A value with its magnitude: 1.2B, 3.4M, 5.6K, or as it is."""
    size = F.abs(x)
    scaled = F.when(size >= 1e9, F.format_string("%.1fB", x / 1e9)).when(size >= 1e6, F.format_string("%.1fM", x / 1e6)).when(size >= 1e3, F.format_string("%.1fK", x / 1e3))
    return scaled.otherwise(F.format_string("%.0f", x))


def currency(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), 0))


def percentage(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x)


def signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), abbreviated(F.abs(x)))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), F.lit("_"))


def glob_pattern(glob: Column) -> Column:
    """A regular expression for the whole value from a pattern in which * stands for any text and ? for one character."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
