"""Ordinal words of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal words of the days 1 to 31.
_ONES = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
_TEENS = ("tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth")
WORDS = (*_ONES, *_TEENS, "twentieth", *(f"twenty-{w}" for w in _ONES), "thirtieth", "thirty-first")


def word(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), day.cast("int"))


def day(text: Column) -> Column:
    """The day an ordinal word names; null for other words."""
    return F.nullif(F.array_position(F.array(*map(F.lit, WORDS)), F.lower(F.trim(text))), F.lit(0)).cast("int")
