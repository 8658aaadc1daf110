"""Per-cell features: counts of points, tag labels, category mix, neighbourhood sums, centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.hexgrid import disk

# Tag sets of the amenity labels. They overlap on purpose.
RESTAURANT = ("restaurant", "cafe", "fast_food", "food_court", "ice_cream", "bar", "pub")
NIGHTLIFE = ("bar", "pub", "cafe", "ice_cream")
SAFETY = ("police", "hospital", "clinic", "fire_station")
GREENERY = ("park", "garden")


def labels() -> dict[str, Column]:
    """A condition for each label, over columns amenity, shop and leisure (null, "" and "nan": missing)."""
    shop = F.coalesce(F.col("shop"), F.lit(""))
    return {
        "amenity": F.lit(True),
        "restaurant": F.coalesce(F.col("amenity").isin(*RESTAURANT), F.lit(False)),
        "nightlife": F.coalesce(F.col("amenity").isin(*NIGHTLIFE), F.lit(False)),
        "safety": F.coalesce(F.col("amenity").isin(*SAFETY), F.lit(False)),
        "greenery": F.coalesce(F.col("leisure").isin(*GREENERY), F.lit(False)),
        "shop": (shop != "") & (shop != "nan"),
    }


def _keys(cell: str, scope: str | None) -> list[str]:
    """What tells cells apart: their id, within a scope such as the city if there is one."""
    return [cell, *([scope] if scope else [])]


def count_labels(amenities: DataFrame, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, <label>_count ...): one pass, partially aggregated before the shuffle."""
    return count_layers(amenities, {}, cell, scope)


def count_points(points: DataFrame, into: str, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    return points.where(F.col(cell).isNotNull()).groupBy(*_keys(cell, scope)).agg(F.count("*").alias(into))


def count_layers(amenities: DataFrame, layers: dict[str, DataFrame], cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """(cell_id, scope?, <layer> ..., <label>_count ...): count_points and count_labels of all layers in one shuffle.

    ``layers``: a table of points for each column of counts.
    """
    keys = _keys(cell, scope)
    names = [*layers, *(f"{name}_count" for name in labels())]
    # a bit for each count: generated code of as many conditions would be too long a method to be compiled
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(labels().values()):
        bits = bits + F.when(condition, F.lit(1 << (len(layers) + i)).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = amenities.select(*keys, bits.alias("_bits"))
    for i, points in enumerate(layers.values()):
        rows = rows.union(points.select(*keys, F.lit(1 << i).cast("long")))
    counts = [F.sum(F.shiftright("_bits", i).bitwiseAND(F.lit(1).cast("long"))).alias(name) for i, name in enumerate(names)]
    return rows.where(F.col(cell).isNotNull()).groupBy(*keys).agg(*counts)


def category_counts(pois: DataFrame, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """The sparse (cell_id, scope?, category, count) table that all category questions start from."""
    # not dropna(), whose condition goes to the scan with the whole formula of the id written out
    return pois.where(F.col(cell).isNotNull() & F.col("category").isNotNull()).groupBy(*_keys(cell, scope), "category").agg(F.count("*").alias("count"))


def poi_features(counts: DataFrame, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """poi_count, unique_categories, category_entropy (natural log) and top_category of each cell.

    Takes the sparse counts, so that both aggregations shuffle no more than a row for each category
    of a cell. Ties for the top go to the first name in order.
    """
    n = F.col("count").cast("double")
    total = F.sum(n)
    return counts.groupBy(*_keys(cell, scope)).agg(
        F.sum("count").alias("poi_count"),
        F.count("*").alias("unique_categories"),
        F.greatest(F.log(total) - F.sum(n * F.log(n)) / total, F.lit(0.0)).alias("category_entropy"),
        F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("top_category"),
    )


def with_counts(cells: DataFrame, *tables: DataFrame, cell: str = "cell_id", scope: str | None = None) -> DataFrame:
    """Left lookups with zeros where a cell has no row; rows outside the grid drop out."""
    out = cells
    for table in tables:
        new = [c for c in table.columns if c not in _keys(cell, scope)]
        out = out.join(table, _keys(cell, scope), "left").fillna(0, subset=new)
    return out


def kring_sum(values: DataFrame, grid: DataFrame, value: str, into: str, k: int = 2, cell: str = "cell_id", by: Sequence[str] = (), inside_only: bool = False, sparse: bool = False, scope: str | None = None) -> DataFrame:
    """(cell_id, by..., into): for each grid cell the sum of ``value`` over all cells within k steps.

    Every valued cell is sent to its neighbours, so the work follows the valued cells and not the
    grid. ``inside_only``: values of cells outside the grid are left out. ``sparse``: only sums of
    cells that a value reaches; else every grid cell has a row, with 0 where nothing does. ``scope``:
    a column of both tables, such as the city, whose cells have ids of their own.
    """
    keys = [scope] if scope else []
    ids = grid.select(cell, *keys).distinct()
    rows = values.where(F.col(cell).isNotNull() & (F.coalesce(F.col(value), F.lit(0)) != 0)).select(cell, *keys, *by, F.col(value).alias("_v"))
    if inside_only:
        rows = rows.join(ids, [cell, *keys], "left_semi")
    sent = rows.select(*keys, *by, "_v", F.explode(disk(F.col(cell), k)).alias(cell)).groupBy(cell, *keys, *by).agg(F.sum("_v").alias(into))
    inside = sent.join(ids, [cell, *keys], "left_semi" if sparse or by else "inner")
    if sparse or by:
        return inside
    return ids.join(inside, [cell, *keys], "left").fillna(0, subset=[into])


def ring_centroids(rings: DataFrame, origin: tuple[float, float] = (37.77, -122.44)) -> DataFrame:
    """(feature_id, lat, lon): area centroid of each polygon, from ring vertices (feature_id, ring, seq, lat, lon).

    Shoelace sums around a local origin; rings may be open or closed, holes run the other way. A
    feature without area (or with one vertex) takes the mean of its vertices; null vertices drop out.
    """
    points = rings.dropna(subset=["feature_id", "ring", "seq", "lat", "lon"]).select("feature_id", "ring", "seq", (F.col("lon") - origin[1]).alias("x"), (F.col("lat") - origin[0]).alias("y"))
    order = Window.partitionBy("feature_id", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = points.select("feature_id", "x", "y", F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(order), F.first("y").over(whole)).alias("y2"))
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = step.groupBy("feature_id").agg(F.sum(cross).alias("k"), F.sum((F.col("x") + F.col("x2")) * cross).alias("kx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("ky"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    flat = F.abs(F.col("k")) < 1e-18
    x = F.when(flat, F.col("mx")).otherwise(F.try_divide(F.col("kx"), 3.0 * F.col("k")))
    y = F.when(flat, F.col("my")).otherwise(F.try_divide(F.col("ky"), 3.0 * F.col("k")))
    return sums.select("feature_id", (y + origin[0]).alias("lat"), (x + origin[1]).alias("lon"))
