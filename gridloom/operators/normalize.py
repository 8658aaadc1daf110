"""Robust normalisation in two passes: bounds are fitted once on a whole scope, then applied anywhere.

Bounds are a table of their own, so that scores of a subset, even of one cell, are those that the
cell has within its scope. They are exact: a sketch brackets each bound, and only the values inside
the bracket are put in order, so that no task holds a column; ``accuracy`` takes approximate ones instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import clip
from gridloom.operators.order import running
from gridloom.sources.store import kept

LOW, HIGH = 0.05, 0.95
#: The sketch is off by a rank in ACCURACY at most; brackets reach four times as far.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY


def fit_bounds(df: DataFrame, columns: Sequence[str], scope: str | None = None, accuracy: int | None = None) -> DataFrame:
    """(scope?, feature, p05, p95, is_degenerate): a missing value counts as 0, a missing column is all 0."""
    keys = [scope] if scope else []
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("x")) for c in columns])).alias("b")).select(*keys, "b.*")
    if accuracy is None:
        found = _percentiles(long, [*keys, "feature"])
    else:
        both = F.percentile_approx("x", F.array(F.lit(LOW), F.lit(HIGH)), accuracy)
        found = long.groupBy(*keys, "feature").agg(both.alias("b")).select(*keys, "feature", F.col("b")[0].alias("p05"), F.col("b")[1].alias("p95"))
    if not scope:  # an empty table has bounds too: null
        found = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(found, "feature", "left")
    return found.withColumn("is_degenerate", F.col("p95") <= F.col("p05"))


def _percentiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p05, p95) of x, exact, with linear interpolation between the two values around a position.

    A sketch brackets each position; one more aggregate counts the rows below the bracket and takes the
    distinct values inside, about 1 in 1,250 rows, whose order is all that is needed. Groups of few rows are
    bracketed by their ends. Should a bracket miss its position, the values are put in order by ranges.
    """
    ends = [q for p in (LOW, HIGH) for q in (p - MARGIN, p + MARGIN)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", F.array(*map(F.lit, ends)), ACCURACY).alias("q"))
    many = F.col("n") * MARGIN >= 4
    each = [F.struct(F.lit(p).alias("p"), F.when(many, F.col("q")[2 * i]).otherwise(F.col("least")).alias("low"), F.when(many, F.col("q")[2 * i + 1]).otherwise(F.col("most")).alias("high")) for i, p in enumerate((LOW, HIGH))]
    brackets = sketch.select(*keys, F.col("n").alias("all"), F.explode(F.array(*each)).alias("b")).select(*keys, "all", "b.*")
    looked = rows.join(brackets, keys).where(F.col("x") <= F.col("high"))
    counted = looked.groupBy(*keys, "p", "all", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys, "p").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    held = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    position = (F.col("all") - 1) * F.col("p")
    both = held.groupBy(*keys, "p").agg(_between(position, F.col("before")).alias("v"))
    found = kept(both.groupBy(*keys).agg(F.max(F.when(F.col("p") == LOW, F.col("v"))).alias("p05"), F.max(F.when(F.col("p") == HIGH, F.col("v"))).alias("p95")), "bounds")
    if found.where("p05 is null or p95 is null").isEmpty():
        return found
    return _by_ranges(rows, keys)


def _between(position: Column, before: Column) -> Column:
    """The value at a position of rows that are counted by value: (x, n), ``before`` of them before."""
    at = lambda rank: F.max(F.when((before <= rank) & (rank < before + F.col("n")), F.col("x")))
    low, high = F.floor(position), F.ceil(position)
    share = F.max(position - low)
    return F.when(at(low) == at(high), at(low)).otherwise(at(low) * (1.0 - share) + at(high) * share)


def _by_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As _percentiles(), by an order of all distinct values."""
    held = running(rows.groupBy(*keys, "x").agg(F.count("*").alias("n")), keys, [F.col("x")], F.col("n"))
    return held.groupBy(*keys).agg(*[_between((F.col("_all") - 1) * F.lit(p), F.col("_before")).alias(name) for p, name in ((LOW, "p05"), (HIGH, "p95"))])


def norm(x: Column, low: Column, high: Column) -> Column:
    """0 at ``low``, 1 at ``high``, clipped; 0.5 everywhere if they coincide."""
    return F.when(high <= low, 0.5).otherwise(clip((x - low) / F.nullif(high - low, F.lit(0.0))))


def inverted(x: Column, low: Column, high: Column) -> Column:
    return 1.0 - norm(x, low, high)


def apply_bounds(df: DataFrame, bounds: DataFrame, columns: Sequence[str], scope: str | None = None, prefix: str = "n_") -> DataFrame:
    """Adds n_<column> for each column. The bounds are one row for each scope."""
    b = bounds.groupBy(*([scope] if scope else [])).agg(*[F.struct(F.max(F.when(F.col("feature") == c, F.col("p05"))).alias("low"), F.max(F.when(F.col("feature") == c, F.col("p95"))).alias("high")).alias(f"_b_{c}") for c in columns])
    # without a scope the bounds are a single row
    joined = df.join(b, scope, "left") if scope else df.crossJoin(F.broadcast(b))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    added = {f"{prefix}{c}": norm(value(c), F.col(f"_b_{c}.low"), F.col(f"_b_{c}.high")) for c in columns}
    return joined.withColumns(added).drop(*[f"_b_{c}" for c in columns])


def zscores(df: DataFrame, id_column: str, columns: Sequence[str], scope: str | None = None) -> DataFrame:
    """(id, scope?, z array<double>): population mean and deviation; a constant column becomes 0."""
    keys = [scope] if scope else []
    filled = df.select(id_column, *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stats = filled.groupBy(*keys).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_s_{c}") for c in columns])
    joined = filled.join(stats, scope) if scope else filled.crossJoin(F.broadcast(stats))
    z = F.array(*[(F.col(c) - F.col(f"_s_{c}.m")) / F.when(F.col(f"_s_{c}.s") > 0, F.col(f"_s_{c}.s")).otherwise(1.0) for c in columns])
    return joined.select(id_column, *keys, z.alias("z"))
