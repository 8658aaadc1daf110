"""SQL (DuckDB) that gives the rows of the registered queries, on the same tables.

Common tables are stated once and put in front of each query; unused ones cost nothing.
"""

from __future__ import annotations

from gridloom.functions.hexgrid import disk_offsets

_LAT0, _LON0, _EDGE, _MLAT, _MLON = "37.77e0", "(-122.44e0)", "174.0e0", "111195.0e0", "87892.0e0"


def _binned(points: str) -> str:
    """A query with cell_id added to the rows of ``points`` (lat, lon, ...)."""
    return f"""(
  SELECT * EXCLUDE (fq, fr, rq, rr, rs, dq, dr, ds),
    (CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) + 1048576) * 4194304
    + CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) + 1048576 AS cell_id
  FROM (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs + fq + fr) AS ds
    FROM (SELECT *, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(-fq - fr + 0.5e0) AS rs
      FROM (SELECT *, (0.5773502691896258e0 * ((lon - {_LON0}) * {_MLON}) - ((lat - {_LAT0}) * {_MLAT}) / 3.0e0) / {_EDGE} AS fq,
              (((lat - {_LAT0}) * {_MLAT}) * 2.0e0 / 3.0e0) / {_EDGE} AS fr
            FROM {points}))))"""


def _at(key: str, shift: int) -> str:
    return f"37.71e0 + (({key} * 7919 + {shift}) % 12000) / 1e5 AS lat, -122.52e0 + (({key} * 104729 + {shift}) % 16000) / 1e5 AS lon"


def _r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


_Q = "(cell_id // 4194304 - 1048576)"
_R = "(cell_id % 4194304 - 1048576)"
_CLAT = f"({_EDGE} * (1.5e0 * {_R})) / {_MLAT} + {_LAT0}"
_CLON = f"({_EDGE} * (1.7320508075688772e0 * {_Q} + 1.7320508075688772e0 / 2.0e0 * {_R})) / {_MLON} + {_LON0}"
_DISK = ", ".join(str(q * 4194304 + r) for q, r in disk_offsets(2))

_FEATURES = ("poi_count", "unique_categories", "category_entropy", "intersection_count", "building_count", "transit_stop_count", "amenity_count", "restaurant_count", "nightlife_count", "safety_count", "greenery_count", "shop_count", "restaurant_count_kring")
_NORMED = ("amenity_count", "building_count", "category_entropy", "greenery_count", "intersection_count", "nightlife_count", "poi_count", "restaurant_count", "safety_count", "shop_count", "transit_stop_count")


def _norm(c: str) -> str:
    low, high = f"quantile_cont({c}::DOUBLE, 0.05) OVER ()", f"quantile_cont({c}::DOUBLE, 0.95) OVER ()"
    return f"CASE WHEN {high} <= {low} THEN 0.5e0 ELSE least(greatest(({c} - {low}) / nullif({high} - {low}, 0), 0e0), 1e0) END AS n_{c}"


TABLES: dict[str, str] = {
    "pois": f"SELECT p_partkey AS id, {_at('p_partkey', 0)}, p_type AS category, p_name AS name FROM part",
    "amenities": f"""SELECT event_id AS id, {_at('event_id', 11)},
      CASE event_type WHEN 'purchase' THEN 'restaurant' WHEN 'view' THEN 'cafe' WHEN 'click' THEN 'bar' WHEN 'error' THEN 'police' WHEN 'signup' THEN '' END AS amenity,
      CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'nan' ELSE 'bakery' END ELSE '' END AS shop,
      CASE WHEN event_id % 11 = 0 THEN 'park' ELSE '' END AS leisure FROM events""",
    "transit": f"SELECT s_suppkey AS id, {_at('s_suppkey', 23)} FROM supplier",
    "nodes": f"SELECT c_custkey AS id, {_at('c_custkey', 37)} FROM customer",
    "buildings": f"SELECT o_orderkey AS id, {_at('o_orderkey', 41)} FROM orders",
    "raw_edges": """SELECT o_custkey AS u, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS v,
      CASE WHEN o_orderkey % 97 = 0 THEN 0e0 ELSE CAST(100 + (o_orderkey * 37) % 900 AS DOUBLE) END AS length FROM orders""",
    "edges": """SELECT u, v, length FROM (SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS length FROM raw_edges WHERE length > 0 GROUP BY 1, 2)
      UNION ALL SELECT v, u, length FROM (SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS length FROM raw_edges WHERE length > 0 GROUP BY 1, 2) WHERE u <> v""",
    "poi_cells": f"SELECT * FROM {_binned('pois')}",
    "amenity_cells": f"SELECT * FROM {_binned('amenities')}",
    "counts": "SELECT cell_id, category, count(*) AS count FROM poi_cells GROUP BY 1, 2",
    "poi_features": """SELECT cell_id, CAST(sum(count) AS BIGINT) AS poi_count, count(*) AS unique_categories,
      greatest(ln(sum(count)::DOUBLE) - sum(count * ln(count::DOUBLE)) / sum(count), 0e0) AS category_entropy,
      arg_min(category, (-count, category)) AS top_category FROM counts GROUP BY 1""",
    "labels": """SELECT cell_id, count(*) AS amenity_count, count(*) FILTER (amenity IN ('restaurant', 'cafe', 'fast_food', 'food_court', 'ice_cream', 'bar', 'pub')) AS restaurant_count,
      count(*) FILTER (amenity IN ('bar', 'pub', 'cafe', 'ice_cream')) AS nightlife_count, count(*) FILTER (amenity IN ('police', 'hospital', 'clinic', 'fire_station')) AS safety_count,
      count(*) FILTER (leisure IN ('park', 'garden')) AS greenery_count, count(*) FILTER (shop <> '' AND shop <> 'nan') AS shop_count FROM amenity_cells GROUP BY 1""",
    "roads": f"SELECT cell_id, count(*) AS intersection_count FROM {_binned('nodes')} GROUP BY 1",
    "built": f"SELECT cell_id, count(*) AS building_count FROM {_binned('buildings')} GROUP BY 1",
    "stops": f"SELECT cell_id, count(*) AS transit_stop_count FROM {_binned('transit')} GROUP BY 1",
    "base": f"""SELECT cell_id, {_CLAT} AS center_lat, {_CLON} AS center_lon, poi_count, unique_categories, category_entropy, top_category,
      coalesce(intersection_count, 0) AS intersection_count, coalesce(building_count, 0) AS building_count, coalesce(transit_stop_count, 0) AS transit_stop_count,
      coalesce(amenity_count, 0) AS amenity_count, coalesce(restaurant_count, 0) AS restaurant_count, coalesce(nightlife_count, 0) AS nightlife_count,
      coalesce(safety_count, 0) AS safety_count, coalesce(greenery_count, 0) AS greenery_count, coalesce(shop_count, 0) AS shop_count
      FROM poi_features LEFT JOIN roads USING (cell_id) LEFT JOIN built USING (cell_id) LEFT JOIN stops USING (cell_id) LEFT JOIN labels USING (cell_id)""",
    "disk": f"SELECT unnest([{_DISK}]) AS step",
    "cells": """SELECT base.*, CAST(ring.n AS BIGINT) AS restaurant_count_kring FROM base
      JOIN (SELECT a.cell_id, sum(coalesce(b.restaurant_count, 0)) AS n FROM base a, disk LEFT JOIN base b ON b.cell_id = a.cell_id + step GROUP BY 1) ring USING (cell_id)""",
    "normed": f"SELECT *, {', '.join(_norm(c) for c in _NORMED)} FROM cells",
    "parts": """SELECT *, 0.5e0 * n_poi_count + 0.5e0 * n_amenity_count AS foot_traffic, 0.5e0 * n_transit_stop_count + 0.5e0 * n_intersection_count AS accessibility,
      0.5e0 * n_category_entropy + 0.5e0 * n_nightlife_count AS commercial_vibrancy, n_building_count AS demographic_density, 0.5e0 * n_shop_count + 0.5e0 * n_restaurant_count AS retail_ecosystem,
      0.5e0 * n_amenity_count + 0.5e0 * n_shop_count AS amenity_walkability, n_greenery_count AS green_access, 0.6e0 * n_safety_count + 0.4e0 * n_nightlife_count AS safety_perception,
      0.5e0 * n_nightlife_count + 0.5e0 * n_restaurant_count AS evening_vibrancy, n_category_entropy AS mixed_use FROM normed""",
    "scored": """SELECT *, least(greatest(0.25e0 * foot_traffic + 0.25e0 * accessibility + 0.20e0 * commercial_vibrancy + 0.15e0 * demographic_density + 0.15e0 * retail_ecosystem, 0e0), 1e0) AS score_site,
      least(greatest(0.20e0 * amenity_walkability + 0.15e0 * green_access + 0.15e0 * safety_perception + 0.15e0 * evening_vibrancy + 0.20e0 * accessibility + 0.15e0 * mixed_use, 0e0), 1e0) AS score_character,
      least(greatest(0.5e0 * n_transit_stop_count + 0.3e0 * n_intersection_count + 0.2e0 * n_shop_count, 0e0), 1e0) AS activity_morning,
      least(greatest(0.4e0 * n_restaurant_count + 0.3e0 * n_shop_count + 0.3e0 * n_amenity_count, 0e0), 1e0) AS activity_midday,
      least(greatest(0.4e0 * n_nightlife_count + 0.3e0 * n_restaurant_count + 0.3e0 * n_amenity_count, 0e0), 1e0) AS activity_evening,
      least(greatest(0.7e0 * n_nightlife_count + 0.3e0 * n_restaurant_count, 0e0), 1e0) AS activity_late_night FROM parts""",
    "dense": """SELECT *, CASE WHEN high > low THEN least(greatest((opportunity_raw - low) / nullif(high - low, 0), 0e0), 1e0) ELSE opportunity_raw END AS opportunity
      FROM (SELECT *, min(opportunity_raw) OVER (PARTITION BY category) AS low, max(opportunity_raw) OVER (PARTITION BY category) AS high
      FROM (SELECT *, least(greatest(demand_proxy * (1e0 - saturation), 0e0), 1e0) AS opportunity_raw
      FROM (SELECT *, CASE WHEN most > 0 THEN cat_count_kring / (most + 1) ELSE 0e0 END AS saturation
      FROM (SELECT *, max(cat_count_kring) OVER (PARTITION BY category) AS most
      FROM (SELECT n.cell_id, c.category, 0.4e0 * n_poi_count + 0.3e0 * n_amenity_count + 0.3e0 * n_transit_stop_count AS demand_proxy,
              CAST(coalesce(own.count, 0) AS BIGINT) AS cat_count_cell, CAST(coalesce(ring.n, 0) AS BIGINT) AS cat_count_kring
            FROM normed n CROSS JOIN (SELECT DISTINCT category FROM counts) c LEFT JOIN counts own ON own.cell_id = n.cell_id AND own.category = c.category
            LEFT JOIN (SELECT counts.cell_id + step AS cell_id, category, sum(count) AS n FROM counts, disk GROUP BY 1, 2) ring ON ring.cell_id = n.cell_id AND ring.category = c.category)))))""",
    "sites": f"SELECT cell_id, {_CLAT} AS lat, {_CLON} AS lon FROM (SELECT DISTINCT cell_id FROM counts)",
    "z": f"""SELECT cell_id, [{', '.join(_r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1e0 END") for c in _FEATURES)}] AS z FROM cells""",
    "knn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist_sq, nbr_id) AS rank
      FROM (SELECT a.cell_id, b.cell_id AS nbr_id, list_sum(list_transform(range(1, len(a.z) + 1), lambda i: (b.z[i] - a.z[i]) * (b.z[i] - a.z[i]))) AS dist_sq FROM z a, z b WHERE a.cell_id <> b.cell_id)) WHERE rank <= 5""",
    "starts": """SELECT cell_id, id AS node FROM (SELECT s.cell_id, n.id, row_number() OVER (PARTITION BY s.cell_id ORDER BY (n.lat - s.lat) * (n.lat - s.lat) + (n.lon - s.lon) * (n.lon - s.lon), n.id) AS k FROM sites s, nodes n) WHERE k = 1""",
}

_WALK = f"""
walk(src, node, d) USING KEY (src, node) AS (
  SELECT cell_id, node, 0e0 FROM starts
  UNION
  SELECT w.src, e.v, min(w.d + e.length) FROM walk w JOIN edges e ON e.u = w.node LEFT JOIN recurring.walk k ON k.src = w.src AND k.node = e.v
  WHERE w.d + e.length <= 1200 AND (k.d IS NULL OR w.d + e.length < k.d) GROUP BY 1, 2
), times AS (
  SELECT src_cell, cell_id, min(minutes) AS minutes FROM (
    SELECT w.src AS src_cell, n.cell_id, w.d / 80e0 AS minutes FROM walk w JOIN {_binned('nodes')} n ON n.id = w.node
    UNION ALL SELECT cell_id, cell_id, 0e0 FROM sites) GROUP BY 1, 2
)"""


def sql(select: str, more: str = "") -> str:
    """A query with the tables it needs, in order, in front."""
    import re

    need, text = [], f"{more} {select}"
    todo = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    while todo:
        t = todo.pop()
        if t not in need:
            need.append(t)
            todo += [x for x in TABLES if x != t and re.search(rf"\b{x}\b", TABLES[t])]
    parts = [f"{t} AS ({TABLES[t]})" for t in TABLES if t in need]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if more else ''}{', '.join(parts)} {select}" if parts else select


def _breakdown(names: tuple[tuple[str, str, float], ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT cell_id, '{shown}' AS component, {w}e0 AS weight, least(greatest({c}, 0e0), 1e0) AS value FROM parts" for shown, c, w in names)
    return sql(f"SELECT cell_id, component, {_r('weight')} AS weight, {_r('value')} AS value, {_r('weight * value')} AS weighted FROM ({rows})")


_HAV = """2.0e0 * 6371008.8e0 * asin(least(sqrt(sin(radians(p.lat - s.lat) / 2.0e0) * sin(radians(p.lat - s.lat) / 2.0e0)
  + cos(radians(s.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - s.lon) / 2.0e0) * sin(radians(p.lon - s.lon) / 2.0e0)), 1e0))"""
_BEAR = """degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon))))"""
_RAMP = ((0.0, (90, 60, 40)), (0.25, (140, 95, 55)), (0.5, (200, 150, 90)), (0.75, (230, 195, 130)), (1.0, (255, 225, 160)))


def _channel(c: int) -> str:
    cases = " ".join(f"WHEN s <= {h}e0 THEN {a[c]}e0 + (s - {low}e0) / ({h}e0 - {low}e0 + 1e-9) * {b[c] - a[c]}e0" for (low, a), (h, b) in zip(_RAMP, _RAMP[1:], strict=False))
    return f"CAST(trunc(CASE {cases} END) AS INTEGER)"


_LONG = " UNION ALL ".join(f"SELECT cell_id, '{b}' AS bucket, '{label}' AS label, {_r(f'activity_{b}')} AS activity FROM scored" for b, label in (("morning", "Morning (6–11)"), ("midday", "Midday (11–16)"), ("evening", "Evening (16–22)"), ("late_night", "Late night (22–2)")))



def _by_city(select: str, more: str = "") -> str:
    """The rows of two cities, each with an origin of its own and every other row of each table."""
    parts = []
    for name, n, lat0, lon0 in (("west", 0, _LAT0, _LON0), ("east", 1, "37.74e0", "(-122.47e0)")):
        text = sql(select, more).replace(_LAT0, lat0).replace(_LON0, lon0).replace("raw_edges WHERE", f"raw_edges WHERE u % 2 = {n} AND v % 2 = {n} AND")
        for end, key in (("AS name FROM part", "p_partkey"), ("AS leisure FROM events", "event_id"), ("AS lon FROM supplier", "s_suppkey"), ("AS lon FROM customer", "c_custkey"), ("AS lon FROM orders", "o_orderkey")):
            text = text.replace(end, f"{end} WHERE {key} % 2 = {n}")
        parts.append(f"SELECT '{name}' AS city, * FROM ({text})")
    return " UNION ALL ".join(parts)


_BOUNDS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'quantile_cont({c}::DOUBLE, 0.05)')} AS p05, {_r(f'quantile_cont({c}::DOUBLE, 0.95)')} AS p95, quantile_cont({c}::DOUBLE, 0.95) <= quantile_cont({c}::DOUBLE, 0.05) AS is_degenerate FROM cells" for c in _NORMED)


def _best(n: int) -> str:
    return f"SELECT category, cell_id, demand_proxy, opportunity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY opportunity DESC, cell_id) AS rank FROM (SELECT category, cell_id, {_r('demand_proxy')} AS demand_proxy, {_r('opportunity')} AS opportunity FROM dense)) WHERE rank <= {n}"


SQL: dict[str, str] = {
    "city_scores": _by_city(f"SELECT cell_id, poi_count, restaurant_count_kring, {', '.join(f'{_r(c)} AS {c}' for c in ('center_lat', 'center_lon', 'score_site', 'score_character', 'activity_evening'))} FROM scored"),
    "city_bounds": _by_city(_BOUNDS),
    "city_opportunity_top5": _by_city(_best(5)),
    "city_similar": _by_city(f"SELECT cell_id, CAST(rank AS INTEGER) AS rank, nbr_id, {_r('dist_sq')} AS dist_sq FROM knn"),
    "city_walks": _by_city(f"SELECT src_cell, cell_id, {_r('minutes')} AS minutes FROM times", _WALK),
    "bbox_subset": sql("SELECT category, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM pois WHERE lon BETWEEN -122.48e0 AND -122.40e0 AND lat BETWEEN 37.74e0 AND 37.80e0 GROUP BY 1"),
    "resolve_columns": sql(f"SELECT id, name, category, {_r('lat')} AS lat, {_r('lon')} AS lon FROM pois"),
    "valid_points": sql(f"SELECT id, {_r('lat')} AS lat, {_r('lon')} AS lon FROM pois WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0"),
    "tagged_features": sql("SELECT id, amenity, leisure FROM amenities WHERE amenity IN ('restaurant', 'police') OR leisure <> ''"),
    "cell_binning": sql(f"SELECT cell_id, count(*) AS n, {_r(_CLAT)} AS center_lat, {_r(_CLON)} AS center_lon FROM amenity_cells GROUP BY cell_id"),
    "poi_cell_features": sql(f"SELECT cell_id, poi_count, unique_categories, {_r('category_entropy')} AS category_entropy, top_category FROM poi_features"),
    "point_counts": sql("SELECT cell_id, intersection_count, building_count, transit_stop_count FROM base"),
    "classify_amenities": sql("SELECT * FROM labels"),
    "category_counts": sql("SELECT * FROM counts"),
    "list_categories": sql("SELECT category, CAST(sum(count) AS BIGINT) AS total, count(*) AS n_cells, upper(substr(category, 1, 1)) || lower(substr(category, 2)) AS display_name FROM counts GROUP BY category HAVING sum(count) >= 10"),
    "kring_sum_grid": sql("SELECT a.cell_id, CAST(coalesce(sum(amenity_count), 0) AS BIGINT) AS kring FROM base a, disk LEFT JOIN base b ON b.cell_id = a.cell_id + step GROUP BY 1".replace("sum(amenity_count)", "sum(b.amenity_count)")),
    "kring_sum_open": sql("SELECT a.cell_id, CAST(coalesce(sum(b.amenity_count), 0) AS BIGINT) AS kring FROM base a, disk LEFT JOIN labels b ON b.cell_id = a.cell_id + step GROUP BY 1"),
    "norm_bounds": sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'quantile_cont({c}::DOUBLE, 0.05)')} AS p05, {_r(f'quantile_cont({c}::DOUBLE, 0.95)')} AS p95, quantile_cont({c}::DOUBLE, 0.95) <= quantile_cont({c}::DOUBLE, 0.05) AS is_degenerate FROM cells" for c in _NORMED)),
    "robust_norm": sql(f"SELECT cell_id, {', '.join(f'{_r(f"n_{c}")} AS n_{c}' for c in ('poi_count', 'category_entropy', 'safety_count'))} FROM normed"),
    "feature_profile": sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(*) FILTER ({c} > 0) AS n_positive, {_r(f'avg({c}::DOUBLE)')} AS mean, {_r(f'max({c}::DOUBLE)')} AS most FROM cells" for c in _FEATURES)),
    "raw_features": sql(" UNION ALL ".join(f"SELECT cell_id, '{c}' AS feature, {_r(f'{c}::DOUBLE')} AS value FROM cells" for c in _FEATURES)),
    "site_score": sql(f"SELECT cell_id, {_r('score_site')} AS score_site FROM scored"),
    "character_score": sql(f"SELECT cell_id, {_r('score_character')} AS score_character FROM scored"),
    "site_breakdown": _breakdown((("foot_traffic", "foot_traffic", 0.25), ("accessibility", "accessibility", 0.25), ("commercial_vibrancy", "commercial_vibrancy", 0.20), ("demographic_density", "demographic_density", 0.15), ("retail_ecosystem", "retail_ecosystem", 0.15))),
    "character_breakdown": _breakdown((("amenity_walkability", "amenity_walkability", 0.20), ("green_access", "green_access", 0.15), ("safety_perception", "safety_perception", 0.15), ("evening_vibrancy", "evening_vibrancy", 0.15), ("connectivity", "accessibility", 0.20), ("mixed_use", "mixed_use", 0.15))),
    "temporal_profile": sql(f"SELECT cell_id, {', '.join(f'{_r(f"activity_{b}")} AS activity_{b}' for b in ('morning', 'midday', 'evening', 'late_night'))} FROM scored"),
    "temporal_long": sql(_LONG),
    "opportunity_all": sql(f"SELECT cell_id, category, cat_count_cell, cat_count_kring, {', '.join(f'{_r(c)} AS {c}' for c in ('demand_proxy', 'saturation', 'opportunity_raw', 'opportunity'))} FROM dense WHERE cat_count_kring > 0"),
    "opportunity_top10": sql(f"SELECT category, cell_id, demand_proxy, opportunity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY opportunity DESC, cell_id) AS rank FROM (SELECT category, cell_id, {_r('demand_proxy')} AS demand_proxy, {_r('opportunity')} AS opportunity FROM dense)) WHERE rank <= 10"),
    "whitespace_summary": sql("SELECT category, CAST(sum(count) AS BIGINT) AS total_in_grid, count(DISTINCT cell_id) AS cells_with, (SELECT count(DISTINCT cell_id) FROM counts) - count(DISTINCT cell_id) AS cells_without FROM counts GROUP BY category"),
    "whitespace_verdict": sql("SELECT category, cell_id, CASE WHEN cat_count_kring = 0 THEN 'wide open' WHEN cat_count_cell = 0 THEN 'moderate' ELSE 'saturated' END AS verdict FROM dense"),
    "category_display_name": sql("SELECT DISTINCT lower(replace(category, ' ', '_')) || '_and_brand_store' AS slug, upper(substr(category, 1, 1)) || lower(substr(category, 2)) || ' & Brand Store' AS display_name FROM pois"),
    "nearest_competitors": sql(f"""SELECT cell_id, category, CAST(rank AS INTEGER) AS rank, id, CASE WHEN name IS NULL OR trim(name) IN ('', 'nan') THEN '(unnamed)' ELSE name END AS name, CAST(round_even(d, 0) AS INTEGER) AS distance_m,
      (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((((bear + 360e0) % 360e0) + 22.5e0) % 360e0) / 45e0) AS INTEGER) + 1] AS direction
      FROM (SELECT *, {_BEAR} AS bear, row_number() OVER (PARTITION BY cell_id, category ORDER BY floor(d * 1e6 + 0.5e0), id) AS rank
      FROM (SELECT s.cell_id, s.lat, s.lon, p.id, p.category, p.name, p.lat AS lat2, p.lon AS lon2, {_HAV} AS d FROM sites s, pois p) WHERE d <= 1500) WHERE rank <= 5"""),
    "nearest_cell": sql("SELECT id, cell_id FROM (SELECT t.id, s.cell_id, row_number() OVER (PARTITION BY t.id ORDER BY (s.lat - t.lat) * (s.lat - t.lat) + (s.lon - t.lon) * (s.lon - t.lon), s.cell_id) AS k FROM transit t, sites s) WHERE k = 1"),
    "nearest_node": sql("SELECT cell_id, node FROM starts"),
    "zscore": sql("SELECT cell_id, CAST(unnest(range(len(z))) AS INTEGER) AS position, unnest(z) AS value FROM z"),
    "similar_cells": sql(f"SELECT cell_id, CAST(rank AS INTEGER) AS rank, nbr_id, {_r('dist_sq')} AS dist_sq FROM knn"),
    "similar_enriched": sql("""SELECT knn.cell_id, CAST(rank AS INTEGER) AS rank, nbr_id, printf('%.4f, %.4f', center_lat, center_lon) AS centre, round_even(score_site * 1000e0, 0) / 10e0 AS score_pct, top_category, round_even(sqrt(dist_sq) * 100e0, 0) / 100e0 AS distance FROM knn JOIN scored ON nbr_id = scored.cell_id"""),
    "embedding_knn": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1e4 + 0.5e0)) AS z FROM embeddings)
      SELECT vec_id, CAST(rank AS INTEGER) AS rank, nbr_id, dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist_sq, nbr_id) AS rank
      FROM (SELECT a.vec_id, b.vec_id AS nbr_id, list_sum(list_transform(range(1, len(a.z) + 1), lambda i: (a.z[i] - b.z[i]) * (a.z[i] - b.z[i]))) AS dist_sq FROM v a, v b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5""",
    "road_edges": sql("SELECT u, v, length FROM edges"),
    "walk_time_cells": sql(f"SELECT src_cell, cell_id, {_r('minutes')} AS minutes FROM times", _WALK),
    "catchment_summary": sql("SELECT src_cell, CAST(within_min AS INTEGER) AS within_min, count(*) FILTER (minutes <= within_min) AS n_cells, CAST(coalesce(sum(poi_count) FILTER (minutes <= within_min), 0) AS BIGINT) AS n_pois FROM times JOIN poi_features USING (cell_id), (SELECT unnest([5, 10, 15]) AS within_min) GROUP BY 1, 2", _WALK),
    "scan_fallback": "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1",
    "landed_table": sql("SELECT category, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, min(name) AS first_name FROM pois GROUP BY 1"),
    "inverted_norm": sql(f"SELECT cell_id, {_r('1e0 - n_poi_count')} AS far_from_pois FROM normed"),
    "walk_bands": sql("SELECT src_cell, cell_id, CASE WHEN minutes <= 15 THEN 100 ELSE 0 END AS red, CASE WHEN minutes <= 15 THEN 210 ELSE 0 END AS green, CASE WHEN minutes <= 15 THEN 230 ELSE 0 END AS blue, CASE WHEN minutes <= 5 THEN 150 WHEN minutes <= 10 THEN 90 WHEN minutes <= 15 THEN 50 ELSE 0 END AS alpha FROM times", _WALK),
    "ring_centroids": sql(f"SELECT id AS feature_id, {_r('lat + (id % 5 + 1) / 1e5 / 2e0')} AS lat, {_r('lon + (id % 7 + 1) / 1e5')} AS lon FROM buildings"),
    "map_layer": sql(f"SELECT cell_id, {_channel(0)} AS red, {_channel(1)} AS green, {_channel(2)} AS blue, 215 AS alpha, {_r('s * 400e0')} AS elevation, {_r('round_even(s * 1000e0, 0) / 10e0')} AS percent FROM (SELECT cell_id, {_r('score_site')} AS s FROM scored)"),
    "top_cells": sql(f"SELECT *, CAST(row_number() OVER (ORDER BY score_site DESC, cell_id) AS INTEGER) AS rank FROM (SELECT cell_id, {_r('score_site')} AS score_site, top_category FROM scored) ORDER BY score_site DESC, cell_id LIMIT 10"),
    "activity_windows": sql("SELECT strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, cell_id, count(DISTINCT user_id) AS devices FROM ticks GROUP BY 1, 2", f"ticks AS (SELECT ts, user_id, cell_id FROM {_binned('(SELECT ts, user_id, ' + _at('event_id', 11) + ' FROM events)')})").replace("WITH RECURSIVE", "WITH"),
}
