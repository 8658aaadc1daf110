"""The registered queries: every operator over the whole of its tables.

Doubles are rounded to six decimals last, as the SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, scalars
from gridloom.functions.hexgrid import HexGrid
from gridloom.operators import catchment, export, features, normalize, opportunity, proximity, scores, similarity
from gridloom.plans import city, standins
from gridloom.sources import tables
from gridloom.sources.store import kept, new_path

GRID = HexGrid()
CITY_GRIDS = {"west": GRID, "east": HexGrid(lat0=37.74, lon0=-122.47)}
SIMILAR = ("poi_count", "unique_categories", "category_entropy", "intersection_count", "building_count", "transit_stop_count", "amenity_count", "restaurant_count", "nightlife_count", "safety_count", "greenery_count", "shop_count", "restaurant_count_kring")


def six(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    # a table of its own, as bounds are fitted on it and then applied to it
    return kept(city.cell_features(standins.layers(spark, sf), GRID), "cells")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scores.with_all(_cells(spark, sf))


def _pois(spark: SparkSession, sf: str) -> DataFrame:
    return GRID.with_cell(standins.pois(spark, sf))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.category_counts(_pois(spark, sf))


def bbox_subset(spark, sf):
    inside = tables.within(standins.pois(spark, sf), tables.BBox(-122.48, 37.74, -122.40, 37.80))
    return inside.groupBy("category").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def resolve_columns(spark, sf):
    raw = standins.pois(spark, sf).withColumnsRenamed({"lat": "latitude", "lon": "lng", "category": "primary_category"})
    return _rounded(tables.slim_pois(tables.resolve_columns(raw)))


def valid_points(spark, sf):
    key = F.col("id")
    some = standins.pois(spark, sf).select("id", F.when(key % 5 == 0, 90.0).when(key % 7 == 0, float("nan")).otherwise(F.col("lat")).alias("lat"), F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, -180.0).otherwise(F.col("lon")).alias("lon"))
    return _rounded(tables.valid_points(some))


def tagged_features(spark, sf):
    some = standins.amenities(spark, sf).select("id", F.nullif("amenity", F.lit("")).alias("amenity"), F.nullif("leisure", F.lit("")).alias("leisure"))
    return tables.tagged(some, {"amenity": ("restaurant", "police"), "leisure": None})


def cell_binning(spark, sf):
    lat, lon = GRID.centre(F.col("cell_id"))
    return _rounded(GRID.with_cell(standins.amenities(spark, sf)).groupBy("cell_id").agg(F.count("*").alias("n")).select("cell_id", "n", lat.alias("center_lat"), lon.alias("center_lon")))


def poi_cell_features(spark, sf):
    return _rounded(features.poi_features(_counts(spark, sf)))


def point_counts(spark, sf):
    layers = standins.layers(spark, sf)
    cells = _counts(spark, sf).select("cell_id").distinct()
    return features.with_counts(cells, *[features.count_points(GRID.with_cell(points), name) for name, points in (("intersection_count", layers.intersections), ("building_count", layers.buildings), ("transit_stop_count", layers.transit))])


def classify_amenities(spark, sf):
    return features.count_labels(GRID.with_cell(standins.amenities(spark, sf)))


def category_counts(spark, sf):
    return _counts(spark, sf)


def list_categories(spark, sf):
    return opportunity.categories(_counts(spark, sf), 10)


def kring_sum_grid(spark, sf):
    values = features.count_points(GRID.with_cell(standins.amenities(spark, sf)), "n")
    return features.kring_sum(values, _counts(spark, sf), "n", "kring", 2, inside_only=True)


def kring_sum_open(spark, sf):
    values = features.count_points(GRID.with_cell(standins.amenities(spark, sf)), "n")
    return features.kring_sum(values, _counts(spark, sf), "n", "kring", 2)


def norm_bounds(spark, sf):
    return _rounded(normalize.fit_bounds(_cells(spark, sf), scores.all_features()))


def robust_norm(spark, sf):
    cells = _cells(spark, sf)
    bounds = normalize.fit_bounds(cells, ["poi_count", "category_entropy", "safety_count"])
    return _rounded(normalize.apply_bounds(cells, bounds, ["poi_count", "category_entropy", "safety_count"]).select("cell_id", "n_poi_count", "n_category_entropy", "n_safety_count"))


def feature_profile(spark, sf):
    return _rounded(tables.profile(_cells(spark, sf), SIMILAR))


def raw_features(spark, sf):
    return _rounded(tables.raw_features(_cells(spark, sf), "cell_id", SIMILAR))


def _score(name: str):
    def run(spark, sf):
        return _rounded(_scored(spark, sf).select("cell_id", f"score_{name}"))

    return run


def _breakdown(name: str):
    def run(spark, sf):
        cells = _cells(spark, sf)
        bounds = normalize.fit_bounds(cells, scores.features_of(scores.SCORES[name]))
        return _rounded(scores.breakdown(cells, bounds, scores.SCORES[name]))

    return run


def temporal_profile(spark, sf):
    return _rounded(_scored(spark, sf).select("cell_id", *[f"activity_{b}" for b in scores.ACTIVITY]))


def temporal_long(spark, sf):
    return _rounded(scores.activity_long(_scored(spark, sf)))


def opportunity_all(spark, sf):
    return _rounded(opportunity.opportunity(_counts(spark, sf), _cells(spark, sf)))


def _dense(spark, sf):
    return opportunity.densify(_counts(spark, sf), _cells(spark, sf), opportunity.categories(_counts(spark, sf)))


def opportunity_top10(spark, sf):
    best = opportunity.top_opportunities(_counts(spark, sf), _cells(spark, sf), 10)
    return _rounded(best.select("category", "cell_id", "demand_proxy", "opportunity", "rank"))


def whitespace_summary(spark, sf):
    return opportunity.summary(_counts(spark, sf), _cells(spark, sf))


def whitespace_verdict(spark, sf):
    dense = _dense(spark, sf)
    return dense.select("category", "cell_id", opportunity.verdict(F.col("cat_count_kring"), F.col("cat_count_cell")).alias("verdict"))


def scan_fallback(spark, sf):
    raw = tables.scan(spark, f"{sf}/pois_slim.parquet", f"{sf}/part.parquet")  # there is no slim copy
    return raw.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))


def landed_table(spark, sf):
    """Written by category and read back; a second write leaves what has landed."""
    path = new_path(spark, "pois")
    some = standins.pois(spark, sf)
    tables.save(some, path, ["category"], ["id"])
    tables.save(some.limit(1), path, ["category"], ["id"], mode="ignore")
    return tables.scan(spark, path).groupBy("category").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("name").alias("first_name"))


def inverted_norm(spark, sf):
    cells = _cells(spark, sf)
    low, high = (F.col(c) for c in ("p05", "p95"))
    bounds = normalize.fit_bounds(cells, ["poi_count"])  # one row
    return _rounded(cells.crossJoin(F.broadcast(bounds)).select("cell_id", normalize.inverted(F.col("poi_count").cast("double"), low, high).alias("far_from_pois")))


def walk_bands(spark, sf):
    colour = export.band_colour(F.col("minutes"))
    return _times(spark, sf).select("src_cell", "cell_id", *[colour[i].alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))])


def category_display_name(spark, sf):
    slugs = _pois(spark, sf).select(F.concat_ws("_and_", F.lower(F.regexp_replace("category", " ", "_")), F.lit("brand_store")).alias("slug")).distinct()
    return slugs.select("slug", scalars.display_name(F.col("slug")).alias("display_name"))


def _centres(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))


def _grid_cells(spark, sf):
    lat, lon = GRID.centre(F.col("cell_id"))
    return _counts(spark, sf).select("cell_id").distinct().select("cell_id", lat.alias("lat"), lon.alias("lon"))


def nearest_competitors(spark, sf):
    return proximity.nearest_within(_grid_cells(spark, sf), standins.pois(spark, sf), k=5, radius_m=1500.0)


def nearest_cell(spark, sf):
    found = proximity.nearest(standins.transit(spark, sf).select("id", "lat", "lon"), _grid_cells(spark, sf), "id", "cell_id")
    return found.select("id", "cell_id")


def _starts(spark, sf):
    return proximity.nearest(_grid_cells(spark, sf), standins.road_nodes(spark, sf).withColumnRenamed("id", "node"), "cell_id", "node")


def nearest_node(spark, sf):
    return _starts(spark, sf).select("cell_id", "node")


def zscore(spark, sf):
    z = normalize.zscores(_cells(spark, sf), "cell_id", SIMILAR)
    return z.select("cell_id", F.posexplode("z").alias("position", "value")).select("cell_id", "position", six("value").alias("value"))


def _z(spark, sf):
    # rounded, so that ties are the same ties on every engine
    return kept(normalize.zscores(_cells(spark, sf), "cell_id", SIMILAR).select("cell_id", F.transform("z", six).alias("z")), "zscores")


def similar_cells(spark, sf):
    return _rounded(similarity.exact_knn(_z(spark, sf), "cell_id", k=5))


def similar_enriched(spark, sf):
    found = similarity.exact_knn(_z(spark, sf), "cell_id", k=5)
    return similarity.enrich(found, _scored(spark, sf), "score_site").select("cell_id", "rank", "nbr_id", "centre", "score_pct", "top_category", "distance")


def similar_lsh(spark, sf):
    return similarity.approximate_knn(_z(spark, sf), "cell_id", k=5)


def embedding_knn(spark, sf):
    vectors = standins.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e4 + 0.5)).alias("z"))
    return similarity.exact_knn(vectors, "vec_id", k=5)


def road_edges(spark, sf):
    return catchment.undirected(standins.road_edges(spark, sf))


def _times(spark, sf):
    block = F.floor(F.col("lat") * 20) * 10_000 + F.floor(F.col("lon") * 20)
    nodes = GRID.with_cell(standins.road_nodes(spark, sf)).select(F.col("id").alias("node"), "cell_id", block.alias("region"))
    edges = kept(catchment.undirected(standins.road_edges(spark, sf)), "edges")
    return catchment.walk_times(_starts(spark, sf).select(F.col("cell_id").alias("src_cell"), "node"), edges, nodes.select("node", "cell_id"), 15.0, regions=nodes.select("node", "region"))


def walk_time_cells(spark, sf):
    return _rounded(_times(spark, sf))


def catchment_summary(spark, sf):
    return catchment.summary(_times(spark, sf), features.poi_features(_counts(spark, sf)))


def ring_centroids(spark, sf):
    centres = features.ring_centroids(standins.building_rings(spark, sf))
    return _rounded(GRID.with_cell(centres).drop("cell_id"))


def map_layer(spark, sf):
    layer = export.layer(_scored(spark, sf).withColumn("score_site", six("score_site")), "score_site")
    return _rounded(layer.select("cell_id", *[F.col("colour")[i].alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))], "elevation", "percent"))


def top_cells(spark, sf):
    scored = _scored(spark, sf).select("cell_id", six("score_site").alias("score_site"), "top_category")
    return scores.top_cells(scored, "score_site", 10)


def _city_grid() -> HexGrid:
    return HexGrid.of_scopes(CITY_GRIDS, "city")


def _city_cells(spark, sf):
    return kept(city.cell_features(standins.city_layers(spark, sf), _city_grid(), scope="city"), "cells")


def city_scores(spark, sf):
    scored = scores.with_all(_city_cells(spark, sf), scope="city")
    return _rounded(scored.select("city", "cell_id", "poi_count", "restaurant_count_kring", "center_lat", "center_lon", "score_site", "score_character", "activity_evening"))


def city_bounds(spark, sf):
    return _rounded(normalize.fit_bounds(_city_cells(spark, sf), scores.all_features(), scope="city"))


def city_opportunity_top5(spark, sf):
    counts = features.category_counts(_city_grid().with_cell(standins.city_layers(spark, sf).pois), scope="city")
    best = opportunity.top_opportunities(counts, _city_cells(spark, sf), 5, scope="city")
    return _rounded(best.select("city", "category", "cell_id", "demand_proxy", "opportunity", "rank"))


def city_similar(spark, sf):
    z = normalize.zscores(_city_cells(spark, sf), "cell_id", SIMILAR, scope="city")
    return _rounded(similarity.exact_knn(kept(z.select("city", "cell_id", F.transform("z", six).alias("z")), "zscores"), "cell_id", k=5, scope="city"))


def city_walks(spark, sf):
    nodes = _city_grid().with_cell(standins.city_layers(spark, sf).intersections).withColumnRenamed("id", "node")
    lat, lon = _city_grid().centre(F.col("cell_id"))
    sites = _city_grid().with_cell(standins.city_layers(spark, sf).pois).select("city", "cell_id").distinct().select("city", "cell_id", lat.alias("lat"), lon.alias("lon"))
    starts = proximity.nearest(sites, nodes, "cell_id", "node", scope="city").withColumnRenamed("cell_id", "src_cell")
    edges = kept(catchment.undirected(standins.city_edges(spark, sf), scope="city"), "edges")
    return _rounded(catchment.walk_times(starts, edges, nodes.select("node", "city", "cell_id"), 15.0, scope="city"))


def activity_windows(spark, sf):
    from gridloom.streaming.activity import windows

    events = standins.table(spark, sf, "events").select("ts", "user_id", GRID.cell_id(standins.lat(F.col("event_id"), 11), standins.lon(F.col("event_id"), 11)).alias("cell_id"))
    counted = windows(events, exact=True)
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "cell_id", "devices")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bbox_subset, resolve_columns, valid_points, tagged_features, cell_binning, poi_cell_features, point_counts, classify_amenities, category_counts,
        list_categories, kring_sum_grid, kring_sum_open, norm_bounds, robust_norm, feature_profile, raw_features, temporal_profile, temporal_long,
        opportunity_all, opportunity_top10, whitespace_summary, whitespace_verdict, category_display_name, nearest_competitors, nearest_cell, nearest_node,
        zscore, similar_cells, similar_enriched, similar_lsh, embedding_knn, road_edges, walk_time_cells, catchment_summary, ring_centroids, map_layer,
        top_cells, activity_windows, scan_fallback, landed_table, inverted_norm, walk_bands,
        city_scores, city_bounds, city_opportunity_top5, city_similar, city_walks,
    )
} | {"site_score": _score("site"), "character_score": _score("character"), "site_breakdown": _breakdown("site"), "character_breakdown": _breakdown("character")}
