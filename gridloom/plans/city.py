"""The feature build of a city, from point tables to scored cells, as one declared plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.hexgrid import HexGrid
from gridloom.operators import features, scores
from gridloom.sources.store import kept


@dataclass(frozen=True)
class Layers:
    """Point tables of a city: pois (lat, lon, category), amenities (tags), and plain points.

    For many cities at once, every table has a column that names the city, the ``scope`` below.
    """

    pois: DataFrame
    amenities: DataFrame
    transit: DataFrame
    intersections: DataFrame
    buildings: DataFrame


def cell_features(layers: Layers, grid: HexGrid, k: int = 2, scope: str | None = None) -> DataFrame:
    """Every cell that holds a point of interest, with its features.

    Points of interest are counted by category, all other layers together, each in one shuffle of
    partial counts, which are joined by cell. The grid is where points of interest are; other layers' points outside it drop out.
    With a ``scope``, ids count within it: each city may have a grid of its own (HexGrid.of_scopes).
    """
    keys = ["cell_id", *([scope] if scope else [])]
    pois = grid.with_cell(layers.pois)
    counts = features.category_counts(pois, scope=scope)
    own = features.poi_features(counts, scope=scope)
    lat, lon = grid.centre(F.col("cell_id"))
    cells = own.select(*keys, lat.alias("center_lat"), lon.alias("center_lon"), "poi_count", "unique_categories", "category_entropy", "top_category")
    points = {"intersection_count": layers.intersections, "building_count": layers.buildings, "transit_stop_count": layers.transit}
    counted = features.count_layers(grid.with_cell(layers.amenities), {name: grid.with_cell(p) for name, p in points.items()}, scope=scope)
    filled = kept(features.with_counts(cells, counted, scope=scope), "filled")  # read three times below
    ring = features.kring_sum(filled.select(*keys, "restaurant_count"), filled, "restaurant_count", "restaurant_count_kring", k, inside_only=True, scope=scope)
    return filled.join(ring, keys)


def scored_cells(layers: Layers, grid: HexGrid, k: int = 2, scope: str | None = None) -> DataFrame:
    return scores.with_all(cell_features(layers, grid, k, scope), scope=scope)
