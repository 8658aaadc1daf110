"""Small scalar helpers: names, clean-up, clipping, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNNAMED = "(unnamed)"
BUCKET_NAMES = {"morning": "Morning (6–11)", "midday": "Midday (11–16)", "evening": "Evening (16–22)", "late_night": "Late night (22–2)"}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def display_name(category: Column) -> Column:
    """Underscores to spaces, the word ``and`` to ``&``, every word capitalised."""
    return F.initcap(F.regexp_replace(F.regexp_replace(category, "_", " "), r"\band ", "& "))


def bucket_name(bucket: Column) -> Column:
    named = F.lit(None).cast("string")
    for key, name in BUCKET_NAMES.items():
        named = F.when(bucket == key, name).otherwise(named)
    return F.coalesce(named, F.initcap(F.regexp_replace(bucket, "_", " ")))


def shown_name(name: Column) -> Column:
    """``(unnamed)`` for a null, blank or ``nan`` name."""
    return F.when(name.isNull() | F.trim(name).isin("", "nan"), UNNAMED).otherwise(name)


def number_or_null(x: Column) -> Column:
    """NaN as null: engines order and aggregate NaN differently."""
    return F.when(~F.isnan(x), x)


def whole_metres(x: Column) -> Column:
    """Rounded half to even."""
    return F.bround(x, 0).cast("int")


def id_suffix(cell_id: Column, n: int = 8) -> Column:
    """A short label only; joins always use the whole id."""
    return F.right(cell_id.cast("string"), F.lit(n))


def coordinates(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f, %.4f", lat, lon)
