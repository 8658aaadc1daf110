"""Composite scores: a definition is a table of weights, and the extension point of this module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import bucket_name, clip
from gridloom.operators.normalize import apply_bounds, fit_bounds

#: {component: (weight in the score, {feature: weight in the component})}
Definition = dict[str, tuple[float, dict[str, float]]]

# Weights of the scores and of the activity profile.
SITE: Definition = {
    "foot_traffic": (0.25, {"poi_count": 0.5, "amenity_count": 0.5}),
    "accessibility": (0.25, {"transit_stop_count": 0.5, "intersection_count": 0.5}),
    "commercial_vibrancy": (0.20, {"category_entropy": 0.5, "nightlife_count": 0.5}),
    "demographic_density": (0.15, {"building_count": 1.0}),
    "retail_ecosystem": (0.15, {"shop_count": 0.5, "restaurant_count": 0.5}),
}
CHARACTER: Definition = {
    "amenity_walkability": (0.20, {"amenity_count": 0.5, "shop_count": 0.5}),
    "green_access": (0.15, {"greenery_count": 1.0}),
    "safety_perception": (0.15, {"safety_count": 0.6, "nightlife_count": 0.4}),
    "evening_vibrancy": (0.15, {"nightlife_count": 0.5, "restaurant_count": 0.5}),
    "connectivity": (0.20, {"transit_stop_count": 0.5, "intersection_count": 0.5}),
    "mixed_use": (0.15, {"category_entropy": 1.0}),
}
ACTIVITY: dict[str, dict[str, float]] = {
    "morning": {"transit_stop_count": 0.5, "intersection_count": 0.3, "shop_count": 0.2},
    "midday": {"restaurant_count": 0.4, "shop_count": 0.3, "amenity_count": 0.3},
    "evening": {"nightlife_count": 0.4, "restaurant_count": 0.3, "amenity_count": 0.3},
    "late_night": {"nightlife_count": 0.7, "restaurant_count": 0.3},
}
SCORES: dict[str, Definition] = {"site": SITE, "character": CHARACTER}


def features_of(definition: Definition) -> list[str]:
    return sorted({f for _, parts in definition.values() for f in parts})


def all_features() -> list[str]:
    return sorted({f for d in SCORES.values() for f in features_of(d)} | {f for parts in ACTIVITY.values() for f in parts})


def _weighted(parts: dict[str, float]) -> Column:
    total = None
    for feature, weight in parts.items():
        term = F.lit(weight) * F.col(f"n_{feature}")
        total = term if total is None else total + term
    return total


def components(df: DataFrame, bounds: DataFrame, definition: Definition, scope: str | None = None) -> DataFrame:
    """Adds a column for each component."""
    normed = apply_bounds(df, bounds, features_of(definition), scope)
    return normed.withColumns({c: _weighted(parts) for c, (_, parts) in definition.items()}).drop(*[f"n_{f}" for f in features_of(definition)])


def _score(definition: Definition) -> Column:
    total = None
    for c, (weight, _) in definition.items():
        term = F.lit(weight) * F.col(c)
        total = term if total is None else total + term
    return clip(total)


def score(df: DataFrame, bounds: DataFrame, definition: Definition, into: str, scope: str | None = None) -> DataFrame:
    return components(df, bounds, definition, scope).withColumn(into, _score(definition)).drop(*definition)


def with_all(df: DataFrame, bounds: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Every score and the activity profile; bounds are fitted once for the union of their features."""
    bounds = fit_bounds(df, all_features(), scope) if bounds is None else bounds
    out = apply_bounds(df, bounds, all_features(), scope)
    for name, definition in SCORES.items():
        out = out.withColumns({c: _weighted(parts) for c, (_, parts) in definition.items()}).withColumn(f"score_{name}", _score(definition)).drop(*definition)
    out = out.withColumns({f"activity_{b}": clip(_weighted(parts)) for b, parts in ACTIVITY.items()})
    return out.drop(*[f"n_{f}" for f in all_features()])


def activity(df: DataFrame, bounds: DataFrame, scope: str | None = None) -> DataFrame:
    features = sorted({f for parts in ACTIVITY.values() for f in parts})
    normed = apply_bounds(df, bounds, features, scope)
    return normed.withColumns({f"activity_{b}": clip(_weighted(parts)) for b, parts in ACTIVITY.items()}).drop(*[f"n_{f}" for f in features])


def activity_long(profile: DataFrame, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, bucket, label, activity)."""
    keys = [cell, *([scope] if scope else [])]
    named = profile.select(*keys, *[F.col(f"activity_{b}").alias(b) for b in ACTIVITY])
    long = named.unpivot(keys, list(ACTIVITY), "bucket", "activity")
    return long.select(*keys, "bucket", bucket_name(F.col("bucket")).alias("label"), "activity")


def breakdown(df: DataFrame, bounds: DataFrame, definition: Definition, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, component, weight, value, weighted), by the bounds of the whole scope."""
    parts = components(df, bounds, definition, scope)
    keys = [cell, *([scope] if scope else [])]
    long = parts.select(*keys, *definition).unpivot(keys, list(definition), "component", "value")
    weight = F.lit(None).cast("double")
    for c, (w, _) in definition.items():
        weight = F.when(F.col("component") == c, w).otherwise(weight)
    value = clip(F.col("value"))
    return long.select(*keys, "component", weight.alias("weight"), value.alias("value"), (weight * value).alias("weighted"))


def top_cells(df: DataFrame, by: str, n: int = 10, scope: str | None = None, cell: str = "cell_id") -> DataFrame:
    """The n best cells (of each scope) with their rank from 1; ties go to the smaller id."""
    if scope is None:
        best = df.orderBy(F.desc(by), cell).limit(n)  # each task keeps n rows
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), cell)))
    order = Window.partitionBy(scope).orderBy(F.desc(by), cell)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
