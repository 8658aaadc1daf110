"""Hand-computed cases of each operator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, scalars
from gridloom.functions.hexgrid import HexGrid, disk, disk_offsets, pack
from gridloom.operators import boxtree, catchment, export, features, normalize, opportunity, proximity, scores, similarity
from gridloom.sources import tables

GRID = HexGrid()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def cell(q, r):
    return (q + (1 << 20)) * (1 << 22) + r + (1 << 20)


@pytest.mark.parametrize(("k", "n"), [(0, 1), (1, 7), (2, 19), (3, 37)])
def test_disk_sizes(spark, k, n):
    assert len(disk_offsets(k)) == n
    ids = spark.range(1).select(disk(pack(F.lit(5), F.lit(-3)), k).alias("d")).first().d
    assert len(set(ids)) == n and cell(5, -3) in ids


def test_cell_of_its_own_centre(spark):
    ids = spark.createDataFrame([(cell(q, r),) for q in range(-9, 10, 3) for r in range(-8, 9, 4)], "c long")
    lat, lon = GRID.centre(F.col("c"))
    back = GRID.with_cell(ids.select("c", lat.alias("lat"), lon.alias("lon")))
    assert back.where("c <> cell_id").count() == 0


def test_norm(spark):
    df = spark.createDataFrame([(i, float(i), 0.0 if i < 21 else 5.0) for i in range(1, 22)], "id int, x double, y double")
    bounds = normalize.fit_bounds(df, ["x", "y", "missing"])
    assert {r.feature: (r.p05, r.p95, r.is_degenerate) for r in bounds.collect()} == {"x": (2.0, 20.0, False), "y": (0.0, 0.0, True), "missing": (0.0, 0.0, True)}
    out = {r.id: (r.n_x, r.n_y, r.n_missing) for r in normalize.apply_bounds(df, bounds, ["x", "y", "missing"]).collect()}
    assert [out[i][0] for i in (1, 2, 11, 20, 21)] == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert {v[1:] for v in out.values()} == {(0.5, 0.5)}
    assert normalize.apply_bounds(df.where("id = 20"), bounds, ["x"]).first().n_x == 1.0  # never refitted on a subset


def test_bounds_by_scope(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(21)] + [("b", i, float(i * 10)) for i in range(21)], "city string, id int, x double")
    bounds = normalize.fit_bounds(df, ["x"], scope="city")
    out = normalize.apply_bounds(df, bounds, ["x"], scope="city").where("id = 10")
    assert rows(out.select("city", "n_x")) == [("a", 0.5), ("b", 0.5)]


def test_kring(spark):
    values = spark.createDataFrame([(cell(0, 0), 3), (cell(2, 0), 4), (cell(3, 0), 5)], "cell_id long, v long")
    inside = features.kring_sum(values, values, "v", "s", 2)
    assert rows(inside) == [(cell(0, 0), 7), (cell(2, 0), 12), (cell(3, 0), 9)]
    grid = values.where(f"cell_id <> {cell(2, 0)}")
    assert dict(rows(features.kring_sum(values, grid, "v", "s", 2, inside_only=True)))[cell(0, 0)] == 3
    assert dict(rows(features.kring_sum(values, grid, "v", "s", 2)))[cell(0, 0)] == 7


def test_labels(spark):
    df = spark.createDataFrame([(1, "bar", "", None), (1, None, "nan", "park"), (1, "", None, ""), (1, "x", "bakery", "nan"), (None, "bar", "", "")], "cell_id long, amenity string, shop string, leisure string")
    got = features.count_labels(df).first().asDict()
    assert got == {"cell_id": 1, "amenity_count": 4, "restaurant_count": 1, "nightlife_count": 1, "safety_count": 0, "greenery_count": 1, "shop_count": 1}


def test_valid_points(spark):
    nan = float("nan")
    df = spark.createDataFrame([(90.0, 1.0), (-90.0, 1.0), (1.0, 180.0), (None, 1.0), (nan, 1.0), (37.7, -122.4)], "lat double, lon double")
    assert rows(tables.valid_points(df)) == [(37.7, -122.4)]


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", "n", 5)], "latitude double, lng double, primary_category string, name string, other int")
    assert tables.resolve_columns(df).columns == ["lat", "lon", "category", "name"]
    with pytest.raises(ValueError, match="no column for lon"):
        tables.resolve_columns(df.drop("lng"))


def test_scan_falls_back(spark, tmp_path):
    tables.save(spark.range(3), f"file://{tmp_path}/raw")
    assert tables.scan(spark, f"file://{tmp_path}/slim", f"file://{tmp_path}/raw").count() == 3
    with pytest.raises(tables.MissingInput):
        tables.scan(spark, f"file://{tmp_path}/none")
    tables.save(spark.range(9), f"file://{tmp_path}/raw", mode="ignore")
    assert spark.read.parquet(f"file://{tmp_path}/raw").count() == 3


def test_city_subset(spark):
    cells = spark.createDataFrame([(1, 37.75, -122.4)], "cell_id long, center_lat double, center_lon double")
    pois = spark.createDataFrame([(1, 37.75, -122.4), (2, 10.0, 10.0)], "id long, lat double, lon double")
    box = tables.SAN_FRANCISCO
    assert [d.count() for d in tables.city_subset(cells, pois, box)] == [1, 1]
    with pytest.warns(UserWarning, match="no point of interest"):
        tables.city_subset(cells, pois.where("id = 2"), box)
    with pytest.raises(tables.MissingInput, match="no cell"):
        tables.city_subset(cells.where("false"), pois, box)


def test_a_hot_value_is_written_in_parts(spark, tmp_path):
    rows_of = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("city"))
    for name, sort in (("sorted", ["id"]), ("not", [])):
        tables.save(rows_of, f"file://{tmp_path}/{name}", ["city"], sort)
        assert spark.read.parquet(f"file://{tmp_path}/{name}").groupBy("city").count().orderBy("city").collect() == [("a", 3600), ("b", 400)]


def test_compass(spark):
    angles = [0.0, 22.4, 22.5, 45.0, 180.0, 337.4, 337.5, 359.9]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(angles)], "i int, a double")
    assert [r[1] for r in rows(df.select("i", geo.compass(F.col("a"))), "i")] == ["N", "N", "NE", "NE", "S", "NW", "N", "N"]


def test_names(spark):
    df = spark.createDataFrame([("brand_store",), ("food_and_drink",)], "c string")
    assert [r[0] for r in rows(df.select(scalars.display_name(F.col("c")).alias("n")))] == ["Brand Store", "Food & Drink"]
    df = spark.createDataFrame([(None,), (" ",), ("nan",), ("Joe",)], "n string")
    assert sorted(r[0] for r in df.select(scalars.shown_name(F.col("n"))).collect()) == ["(unnamed)"] * 3 + ["Joe"]


def test_competitors(spark):
    step = 1.0 / (geo.EARTH_RADIUS_M * math.pi / 180)  # degrees of latitude to a metre
    centre = spark.createDataFrame([(1, 0.0, 0.0)], "cell_id long, lat double, lon double")
    pois = spark.createDataFrame([(1, 0.0, 0.0, "c", "same"), (2, 1499.9 * step, 0.0, "c", None), (3, 1500.1 * step, 0.0, "c", "far"), (4, 0.0, 700 * step, "d", "other")], "id long, lat double, lon double, category string, name string")
    got = rows(proximity.nearest_within(centre, pois).select("category", "rank", "id", "name", "distance_m", "direction"))
    assert got == [("c", 1, 1, "same", 0, "N"), ("c", 2, 2, "(unnamed)", 1500, "N"), ("d", 1, 4, "other", 700, "E")]


@pytest.mark.parametrize("lat", [0.0, 70.0, -85.0, 89.99])
@pytest.mark.parametrize("lon", [10.0, 179.995])
def test_competitors_anywhere(spark, lat, lon):
    rng = random.Random(7)
    wide = min(0.04 / max(math.cos(math.radians(lat)), 1e-3), 180.0)

    def some(n):
        return [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for i in range(n)]

    centres, points = some(25), some(250)
    c = spark.createDataFrame([(*r, "a") for r in centres] + [(99, lat, lon, "b")], "cell_id long, lat double, lon double, city string")
    p = spark.createDataFrame([(*r, "x", "a") for r in points] + [(500, None, 1.0, "x", "a")], "id long, lat double, lon double, category string, city string")

    def metres(a, b):
        (la, lo), (lb, ob) = [(math.radians(x), math.radians(y)) for _, x, y in (a, b)]
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))

    want = {(x[0], y[0]) for x in centres for y in points if metres(x, y) <= 1500}
    found = proximity.nearest_within(c, p, k=1000, scope="city").collect()
    assert want and len(found) == len(want) and {(r.cell_id, r.id) for r in found} == want


def test_nearest_equals_brute_force(spark):
    points = [(i, (i * 37 % 101) / 50.0, (i * 53 % 97) / 50.0) for i in range(60)] + [(99, 40.0, 60.0)]
    targets = [(i, (i * 71 % 89) / 45.0, (i * 29 % 83) / 45.0) for i in range(25)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    t = spark.createDataFrame(targets, "t long, lat double, lon double")
    got = {r.id: r.t for r in proximity.nearest(p, t, "id", "t").collect()}
    assert got == {i: min(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in targets)[1] for i, x, y in points}


@pytest.mark.parametrize("rows_per_block", [1, 5, 64])
def test_nearest_in_dense_blocks(spark, rows_per_block):
    """A third of all targets in a speck, many at one place, a far outlier, ids that are strings, two scopes."""
    rng = random.Random(3)
    speck = [(37.7 + rng.uniform(0, 1e-7), -122.4 + rng.uniform(0, 1e-7)) for _ in range(200)]
    spread = [(rng.uniform(37, 38), rng.uniform(-123, -122)) for _ in range(300)] + [(37.5, -122.5)] * 100 + [(-80.0, 170.0)]
    targets = [(f"t{i}", *x, "a" if i % 3 else "b") for i, x in enumerate(speck + spread)]
    places = [(rng.uniform(37, 38), rng.uniform(-123, -122)) for _ in range(80)] + [(37.7, -122.4), (37.5, -122.5), (89.0, 179.0), (-80.1, 170.0), (0.0, 0.0)]
    points = [(i, *x, city) for i, x in enumerate(places) for city in "ab"]
    p = spark.createDataFrame([*points, points[0], (1000, None, 1.0, "a"), (1001, float("nan"), 1.0, "a"), (1002, float("inf"), 1.0, "a"), (1003, 1.0, 1.0, "none"), (1004, 1.0, 1.0, None)], "id long, lat double, lon double, city string")
    t = spark.createDataFrame([*targets, ("t", 37.5, None, "a"), ("s", float("nan"), 1.0, "a")], "t string, lat double, lon double, city string")
    found = proximity.nearest(p, t, "id", "t", rows_per_block, scope="city")
    got = sorted((r.id, r.city, r.d2, r.t) for r in found.collect())
    assert got == sorted((i, city, *min(((a - x) * (a - x) + (b - y) * (b - y), j) for j, a, b, of in targets if of == city)) for i, x, y, city in points)
    assert proximity.nearest(p, t.where("false"), "id", "t").count() == 0 == proximity.nearest(p.where("false"), t, "id", "t").count()


def test_blocks_and_visits_are_bounded(spark):
    """Blocks stay small however dense the places are, and a point visits few of them."""
    rng = random.Random(5)
    places = [(0, 10 + rng.gauss(0, 1e-4), 20 + rng.gauss(0, 1e-4)) for _ in range(3000)] + [(0, rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)]
    t = spark.createDataFrame(places, "_s int, t_lat double, t_lon double")
    placed = proximity.blocks(t, 16).cache()
    sizes = [r["count"] for r in placed.groupBy("_b").count().collect()]
    assert max(sizes) <= 16 and sum(sizes) == 6000 and len(sizes) < 4000
    p = spark.createDataFrame([(0, i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(0, 200 + i, 10 + rng.gauss(0, 1e-3), 20 + rng.gauss(0, 1e-3)) for i in range(200)], "_s int, _p int, lat double, lon double")
    met = [r["count"] for r in boxtree.visits(p, placed, together=50).groupBy("_p").count().collect()]
    assert len(met) == 400 and sum(met) / 400 < 12


def test_opportunity(spark):
    cells = spark.createDataFrame([(cell(10 * i, 0), i, i, i) for i in range(6)], "cell_id long, poi_count int, amenity_count int, transit_stop_count int")
    counts = spark.createDataFrame([(cell(0, 0), "a", 4), (cell(50, 0), "a", 2), (cell(1, 0), "b", 1)], "cell_id long, category string, count long")
    sparse = opportunity.opportunity(counts, cells)
    dense = opportunity.densify(counts, cells, ["a", "b", "none"])
    want = {(r.cell_id, r.category): round(r.opportunity, 9) for r in dense.collect()}
    got = {(r.cell_id, r.category): round(r.opportunity, 9) for r in sparse.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    top = dense.where(f"category = 'a' AND cell_id = {cell(0, 0)}").first()
    assert (top.cat_count_kring, top.saturation) == (4, 4 / 5)
    assert {r.saturation for r in dense.where("category = 'none'").collect()} == {0.0}
    assert rows(opportunity.summary(counts, cells)) == [("a", 6, 2, 4)]


def test_opportunity_of_two_cities_with_equal_ids(spark):
    rng = random.Random(11)
    grid = [cell(q, r) for q in range(9) for r in range(9)]
    cells = [(c, city, rng.randrange(6), rng.randrange(4), rng.randrange(3)) for city in ("a", "b") for c in rng.sample(grid, 60)]
    counts = [(c, city, name, rng.randrange(1, 5)) for city in ("a", "b") for name, n in (("x", 3), ("y", 25)) for c in rng.sample(grid, n)]
    df = spark.createDataFrame(cells, "cell_id long, city string, poi_count int, amenity_count int, transit_stop_count int")
    n = spark.createDataFrame(counts, "cell_id long, city string, category string, count long")
    key = ["cell_id", "category", "cat_count_cell", "cat_count_kring"]
    both = opportunity.opportunity(n, df, scope="city")
    dense = opportunity.densify(n, df, ["x", "y"], scope="city")
    for city in ("a", "b"):
        one, own = df.where(F.col("city") == city).drop("city"), n.where(F.col("city") == city).drop("city")
        shown = lambda d: rows(d.select(*key, F.round("opportunity", 9)))
        alone = opportunity.opportunity(own, one)
        assert shown(both.where(F.col("city") == city)) == shown(alone)
        whole = shown(opportunity.densify(own, one, ["x", "y"]))
        assert shown(dense.where(F.col("city") == city)) == whole
        assert shown(alone) == [r for r in whole if r[3] > 0]
        assert rows(opportunity.summary(n, df, scope="city").where(F.col("city") == city).drop("city")) == rows(opportunity.summary(own, one))
        best = opportunity.best_per_category(dense, 4, scope="city")
        assert best.where(F.col("city") == city).count() == 8


def test_the_first_free_rank(spark):
    groups = {"none missing": range(1, 9001), "first": range(2, 50), "later": [r for r in range(1, 9000) if r != 8500], "a block": [*range(1, 4097), *range(9000, 9100)], "edge": range(1, 4097)}
    df = spark.createDataFrame([(g, r) for g, ranks in groups.items() for r in ranks], "g string, r long")
    got = dict(rows(opportunity._free(df, ["g"], "r")))
    assert got == {"none missing": 9001, "first": 1, "later": 8500, "a block": 4097, "edge": 4097}
    for n in (3, 5000):
        several = opportunity._free(df.union(spark.createDataFrame([("nothing", 0), ("first", 0)], df.schema)), ["g"], "r", n)
        found = {}
        for g, r in rows(several):
            found.setdefault(g, []).append(r)
        assert found == {g: [r for r in range(1, 20_000) if r not in set(ranks)][:n] for g, ranks in (groups | {"nothing": []}).items()}


def test_edges(spark):
    df = spark.createDataFrame([(1, 2, 100.0), (2, 1, 80.0), (1, 2, -5.0), (1, 2, float("nan")), (3, None, 1.0)], "u long, v long, length double")
    assert rows(catchment.undirected(df)) == [(1, 2, 80.0), (2, 1, 80.0)]


def test_walk(spark):
    edges = catchment.undirected(spark.createDataFrame([(1, 2, 400.0), (2, 3, 800.0), (3, 4, 1.0)], "u long, v long, length double"))
    starts = spark.createDataFrame([(100, 1)], "src_cell long, node long")
    cells = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, 400)], "node long, cell_id long")
    times = catchment.walk_times(starts, edges, cells)
    assert rows(times) == [(100, 100, 0.0), (100, 200, 5.0), (100, 300, 15.0)]


def test_paths_over_regions(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(0, 500))) for _ in range(150)] + [(1, 2, float("nan")), (1, 3, -5.0)]
    edges = catchment.undirected(spark.createDataFrame(pairs, "u long, v long, length double"))
    starts = spark.createDataFrame([(f"s{i}", i) for i in range(0, 60, 3)] + [("s0", 33), ("away", 999), (None, 1), ("none", None)], "src string, node long")
    graph = {}
    for u, v, d in edges.collect():
        graph.setdefault(u, []).append((v, d))
    want = set()
    for src in {s for s, n in starts.collect() if s is not None and n is not None}:
        best = {n: 0.0 for s, n in starts.collect() if s == src}
        todo = list(best)
        while todo:
            u = todo.pop()
            for v, d in graph.get(u, []):
                if best[u] + d <= 900 and best[u] + d < best.get(v, math.inf):
                    best[v] = best[u] + d
                    todo.append(v)
        want |= {(src, n, d) for n, d in best.items()}
    cuts = {n: spark.createDataFrame([(i, i % n) for i in range(55)], "node long, region long") for n in (7, 100)}  # some nodes have none
    for regions, most_nodes, per_task in ((None, 1000, 128), (None, 30, 2), (cuts[7], 20, 3), (cuts[7], 3, 128), (cuts[100], 20, 128)):
        got = [tuple(r) for r in catchment.shortest_paths(starts, edges, 900.0, regions, most_nodes=most_nodes, sources_per_task=per_task).collect()]
        assert len(got) == len(want) and set(got) == want
    assert catchment.shortest_paths(starts, edges.where("false"), 900.0).where("d > 0").count() == 0


def test_buckets(spark):
    times = spark.createDataFrame([(1, c, m) for c, m in ((1, 0.0), (2, 5.0), (3, 5.01), (4, 15.0), (9, 1.0))], "src_cell long, cell_id long, minutes double")
    cells = spark.createDataFrame([(1, 10), (2, None), (3, 5), (4, 1)], "cell_id long, poi_count long")
    assert rows(catchment.summary(times, cells)) == [(1, 5, 2, 10), (1, 10, 3, 15), (1, 15, 4, 16)]
    assert catchment.as_map(catchment.summary(times, cells)).first().buckets["10_min"].n_pois == 15


def test_similarity(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 1.0, 7.0), (3, 5.0, 7.0), (4, None, 7.0)], "id long, a double, b double")
    z = normalize.zscores(df, "id", ["a", "b"])
    assert {r.z[1] for r in z.collect()} == {0.0}
    got = rows(similarity.exact_knn(z, "id", k=2, rows_per_block=2), "id", "rank")
    assert [(r[0], r[2]) for r in got if r[1] == 1][:2] == [(1, 2), (2, 1)]
    assert all(r[0] != r[2] for r in got) and got[0][3] == 0.0


def test_two_cities_with_equal_ids(spark):
    rng = random.Random(5)
    vectors = [(c, i, [rng.gauss(0, 1 + 9 * (i % 7 == 0)) for _ in range(4)]) for c in ("a", "b") for i in range(120)]
    df = spark.createDataFrame([*vectors, (None, 1, [0.0] * 4), ("a", 500, None)], "city string, id long, z array<double>")
    key = ["id", "rank", "nbr_id"]
    exact = similarity.exact_knn(df, "id", k=3, rows_per_block=50, scope="city")
    rough = similarity.approximate_knn(df, "id", k=3, rows_per_block=50, scope="city")
    for city in ("a", "b"):
        one = lambda d: set(rows(d.where(F.col("city") == city).select(*key)))
        alone = set(rows(similarity.exact_knn(df.where(F.col("city") == city), "id", k=3).select(*key)))
        assert len(alone) == 360 and one(exact) == alone
        assert len(one(rough)) == 360 and len(one(rough) & alone) >= 0.9 * 360
    edges = catchment.undirected(spark.createDataFrame([(1, 2, 400.0, "a"), (2, 3, 400.0, "a"), (1, 2, 800.0, "b")], "u long, v long, length double, city string"), scope="city")
    starts = spark.createDataFrame([(7, "a", 1), (7, "b", 2)], "src_cell long, city string, node long")
    cells = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("a", 3, 9), ("b", 1, 8), ("b", 2, 7)], "city string, node long, cell_id long")
    cut = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "city string, node long, region long")
    times = catchment.walk_times(starts, edges, cells, scope="city")
    both = catchment.shortest_paths(starts.withColumnRenamed("src_cell", "src"), edges, 1200.0, cut, "city", most_nodes=1)
    assert rows(both.select("city", "node", "d")) == [("a", 1, 0.0), ("a", 2, 400.0), ("a", 3, 800.0), ("b", 1, 800.0), ("b", 2, 0.0)]
    assert rows(times.select("city", "cell_id", "minutes")) == [("a", 7, 0.0), ("a", 8, 5.0), ("a", 9, 10.0), ("b", 7, 0.0), ("b", 8, 10.0)]
    pois = spark.createDataFrame([("a", 8, 3), ("b", 8, 5)], "city string, cell_id long, poi_count long")
    found = catchment.as_map(catchment.summary(times, pois, scope="city"), scope="city")
    assert {r.city: (r.buckets["5_min"].n_pois, r.buckets["10_min"].n_pois) for r in found.collect()} == {"a": (3, 3), "b": (0, 5)}


def brute_knn(known, asked, k):
    out = []
    for i, v in asked:
        far = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in known if j != i)
        out += [(i, rank, j) for rank, (_, j) in enumerate(far[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 16])
def test_knn_by_blocks_against_brute_force(spark, pivots):
    """Integer vectors with many ties, a third of all rows at one place, far rows; queries that are not known rows."""
    rng = random.Random(8)
    known = [(i, [float(rng.randrange(9)) for _ in range(3)]) for i in range(120)] + [(200 + i, [4.0] * 3) for i in range(60)]
    known += [(300, [1e6, 0.0, 0.0]), (301, [-1e6, 5.0, 0.0])]
    asked = [known[0], known[150], known[-1]] + [(900 + i, [rng.uniform(-20, 30) for _ in range(3)]) for i in range(20)]
    df = spark.createDataFrame([*known, (None, [0.0] * 3), (400, None), (401, [float("nan"), 0.0, 0.0])], "id long, z array<double>")
    got = similarity.exact_knn(df, "id", k=4, rows_per_block=16, pivots=pivots)
    assert rows(got.select("id", "rank", "nbr_id")) == brute_knn(known, known, 4)
    some = similarity.exact_knn(df, "id", k=4, rows_per_block=16, queries=spark.createDataFrame(asked, df.schema), pivots=pivots)
    assert rows(some.select("id", "rank", "nbr_id")) == brute_knn(known, asked, 4)
    few = similarity.exact_knn(df.where("id < 3"), "id", k=9, rows_per_block=1, pivots=pivots)
    assert rows(few.select("id", "rank", "nbr_id")) == brute_knn(known[:3], known[:3], 9)
    assert similarity.exact_knn(df.where("false"), "id").count() == 0


def test_knn_of_clusters_meets_few_blocks(spark):
    rng = random.Random(9)
    centres = [[rng.uniform(-100, 100) for _ in range(6)] for _ in range(40)]
    known = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 40]]) for i in range(4000)]
    df = similarity._rows(spark.createDataFrame(known, "id long, z array<double>"), "id", "z")
    a, b, _, _, near = similarity._planned(df, df, similarity._sized(df, 64), 5, 64, 256)
    n = a.count()
    assert n >= 50 and near.count() < 0.2 * n * b.count()


def test_bounds_of_a_hot_scope(spark):
    values = [("hot", float(i % 997)) for i in range(6000)] + [("one", 3.5), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(values, "city string, x double")
    got = {r.city: (r.p05, r.p95) for r in normalize.fit_bounds(df, ["x"], scope="city").collect()}
    want = {r.city: tuple(r.b) for r in df.groupBy("city").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("b")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for c in got for a, b in zip(got[c], want[c], strict=True))


def test_bounds_by_a_sketch(spark):
    """Groups far larger than those that are bracketed by their ends; ties at a bound; brackets that miss."""
    x = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0 - 1e4)
    df = spark.range(60_000).select(x.alias("x"), F.when(F.col("id") % 5 == 0, "few").otherwise("most").alias("city"))
    want = {r.city: tuple(r.b) for r in df.groupBy("city").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("b")).collect()}
    rows_of = df.withColumn("feature", F.lit("x"))
    for found in (normalize._percentiles(rows_of, ["city"]), normalize._by_ranges(rows_of, ["city"])):
        got = {r.city: (r.p05, r.p95) for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for c in got for a, b in zip(got[c], want[c], strict=True))


def test_bounds_where_brackets_miss(spark, monkeypatch):
    df = spark.range(30_000).select((F.col("id") * 1.0).alias("x"), F.lit("x").alias("feature"))
    approximate = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, q, n: F.transform(approximate(c, q, n), lambda v: v + 500.0))
    got = normalize._percentiles(df, ["feature"]).first()
    assert (round(got.p05, 6), round(got.p95, 6)) == (1499.95, 28499.05)


def test_entropy_and_top(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "a", 4)], "cell_id long, category string, count long")
    got = rows(features.poi_features(counts))
    assert got[0][:3] == (1, 4, 2) and abs(got[0][3] - math.log(2)) < 1e-12 and got[0][4] == "a"
    assert got[1] == (2, 4, 1, 0.0, "a")


def test_centroids(spark):
    square = [(1, 0, i, y, x) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)])]
    triangle = [(2, 0, i, y, x) for i, (x, y) in enumerate([(0, 0), (3, 0), (0, 3)])]
    line = [(3, 0, i, 1.0, float(x)) for i, x in enumerate([0, 2])]
    df = spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in square + triangle + line], "feature_id long, ring int, seq int, lat double, lon double")
    got = {r.feature_id: (round(r.lat, 9), round(r.lon, 9)) for r in features.ring_centroids(df, origin=(0.0, 0.0)).collect()}
    assert got == {1: (0.5, 1.0), 2: (1.0, 1.0), 3: (1.0, 1.0)}


def test_breakdown_of_one_cell(spark):
    names = scores.features_of(scores.SITE)
    df = spark.createDataFrame([(i, *[float(i + j) for j in range(len(names))]) for i in range(30)], ["cell_id", *names])
    bounds = normalize.fit_bounds(df, names)
    whole = rows(scores.breakdown(df, bounds, scores.SITE).where("cell_id = 7"))
    assert rows(scores.breakdown(df.where("cell_id = 7"), bounds, scores.SITE)) == whole
    total = scores.score(df, bounds, scores.SITE, "s").where("cell_id = 7").first().s
    assert abs(sum(r[4] for r in whole) - total) < 1e-12


def test_colours(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (0.5,), (9.0,)], "s double")
    got = [r[0] for r in df.select(export.colour(F.col("s"))).collect()]
    assert got[:3] == [[60, 50, 42, 120], [60, 50, 42, 120], [90, 60, 40, 215]]
    assert got[4] == [254, 224, 159, 215]  # the ramp's divisor is a little over its step
    bands = spark.createDataFrame([(5.0,), (5.1,), (15.0,), (15.1,)], "m double")
    assert [r[0][3] for r in bands.select(export.band_colour(F.col("m"))).collect()] == [150, 90, 50, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "cell_id long, category string, count long")
    cells = spark.createDataFrame([], "cell_id long, poi_count int, amenity_count int, transit_stop_count int")
    assert features.poi_features(none).count() == 0
    assert opportunity.opportunity(none, cells).count() == 0
    assert normalize.fit_bounds(cells, ["poi_count"]).count() == 1
