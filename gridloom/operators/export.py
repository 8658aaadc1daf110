"""Map-layer tables: colours, elevations and labels ready to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ramp stops with red, green, blue; its alpha; the colour of a missing score; bands of
# walk minutes. EPSILON keeps the divisor of a ramp step off zero; it shows where a part ends.
RAMP = ((0.0, (90, 60, 40)), (0.25, (140, 95, 55)), (0.5, (200, 150, 90)), (0.75, (230, 195, 130)), (1.0, (255, 225, 160)))
ALPHA = 215
EPSILON = 1e-9
MISSING = (60, 50, 42, 120)
BANDS = ((5, (100, 210, 230, 150)), (10, (100, 210, 230, 90)), (15, (100, 210, 230, 50)))
BEYOND = (0, 0, 0, 0)


def _rgba(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def colour(score: Column) -> Column:
    """array<int> red, green, blue, alpha: piecewise linear between stops, clamped, truncated."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))

    def channel(c: int) -> Column:
        value = F.lit(None).cast("double")
        for (low, start), (high, end) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
            part = (s - F.lit(low)) / F.lit(high - low + EPSILON)
            value = F.when(s <= high, F.lit(float(start[c])) + part * F.lit(float(end[c] - start[c]))).otherwise(value)
        return value.cast("int")

    return F.when(score.isNull() | F.isnan(score), _rgba(MISSING)).otherwise(F.array(*[channel(c) for c in range(3)], F.lit(ALPHA)))


def band_colour(minutes: Column) -> Column:
    """The colour of a walk-time band; transparent beyond the last."""
    out = _rgba(BEYOND)
    for most, rgba in reversed(BANDS):
        out = F.when(minutes <= most, _rgba(rgba)).otherwise(out)
    return out


def layer(cells: DataFrame, score: str, cell: str = "cell_id", height: float = 400.0) -> DataFrame:
    """(cell_id, colour, elevation, percent)."""
    s = F.col(score)
    known = F.when(s.isNull() | F.isnan(s), 0.0).otherwise(s)
    return cells.select(cell, colour(s).alias("colour"), (known * height).alias("elevation"), (F.rint(known * 1000.0) / 10.0).alias("percent"))
