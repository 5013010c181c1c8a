"""Rounding that agrees with binary half-even rounding of the exact double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` places; ties by the double's exact value, as most languages' formatters do."""
    pattern = "0" + ("." + "0" * digits if digits else "")
    return F.call_function("format_number", value.cast("double"), F.lit(pattern)).cast("double")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def loose_number(text: Column) -> Column:
    """The first number in a string, or null; booleans are no numbers."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(~F.lower(text).isin("true", "false"), found.try_cast("double"))
