"""Plans and steps whose cost must not grow faster than their tables."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.hexgrid import HexGrid
from gridloom.operators import catchment, features, proximity, similarity


def test_counts_do_not_filter_by_the_formula_of_a_cell(spark):
    grid = HexGrid.of_scopes({"west": HexGrid(), "east": HexGrid(lat0=37.74, lon0=-122.47)}, "city")
    points = spark.range(40).select((F.lit(37.7) + F.col("id") % 4 / 1e3).alias("lat"), F.when(F.col("id") != 5, -122.4).alias("lon"), F.when(F.col("id") % 2 == 0, "west").otherwise("east").alias("city"), F.when(F.col("id") != 7, "a").alias("category"))
    counts = features.category_counts(grid.with_cell(points), scope="city")
    # dropna() becomes this condition, which is pushed below all steps of the formula
    assert "atleastnnonnulls" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()
    assert counts.agg(F.sum("count")).first()[0] == 38


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e20])
def test_neighbours_found_block_after_block(scale):
    draw = np.random.default_rng(1)
    ids, x = np.arange(700), draw.integers(-3, 4, (700, 6)) * scale  # many ties
    x[13, 2], x[40, 0] = np.nan, np.inf
    near = similarity._Nearest(ids[:600], x[:600], 4)
    for low in range(0, 700, 100):
        near.meet(ids[low : low + 100], x[low : low + 100])
    got = {}
    for i, nbr, d in zip(*near.found(), strict=True):
        got.setdefault(i, []).append((d, nbr))
    want = {}
    for i in range(600):
        d = ((x - x[i]) ** 2).sum(axis=1)
        if i not in (13, 40):
            want[i] = sorted((d[j], j) for j in range(700) if j not in (i, 13, 40))[:4]
    assert {i: [j for _, j in found] for i, found in got.items()} == {i: [j for _, j in found] for i, found in want.items()}


def test_competitors_among_many_by_growing_radii(spark):
    draw = random.Random(3)
    places = [(37.7 + draw.randrange(40) / 4e3, -122.4 + draw.randrange(40) / 4e3) for _ in range(1200)]
    points = [(i, *places[i], draw.choice("ab") if i % 9 else None, None) for i in range(1200)]
    points += [(5000 + i, 37.7201, -122.4, "a", None) for i in range(300)]  # many at one place, beyond the first radii
    pois = spark.createDataFrame(points, "id long, lat double, lon double, category string, name string")
    centres = [(c, 37.7 + c / 900, -122.4 + c / 1100) for c in range(12)] + [(99, 37.7205, -122.4005)]
    got = {}
    for r in proximity.nearest_within(spark.createDataFrame(centres, "cell_id long, lat double, lon double"), pois, 3, 1200.0).collect():
        got.setdefault((r.cell_id, r.category), {})[r.rank] = r.id
    at = spark.createDataFrame([(c[0], p[0], p[3], *c[1:], *p[1:3]) for c in centres for p in points], "c long, i long, g string, a double, b double, x double, y double")
    far = at.withColumn("d", geo.haversine_m(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).where("d <= 1200").collect()
    want = {}
    for r in far:
        want.setdefault((r.c, r.g), []).append((int(r.d * 1e6 + 0.5), r.i))
    assert got == {k: dict(enumerate([i for _, i in sorted(v)[:3]], 1)) for k, v in want.items()}
    known = pois.select("id", F.col("category").alias("_m"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    assert len(proximity._radii(known, ["_m"], 3, 1200.0)) > 1


def test_points_of_one_place_look_once(spark, monkeypatch):
    looked = []
    visits = proximity.boxtree.visits
    monkeypatch.setattr(proximity.boxtree, "visits", lambda points, placed: looked.append(points.count()) or visits(points, placed))
    points = spark.range(500).select("id", (F.col("id") % 5).cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    targets = spark.range(300).select(F.col("id").alias("t"), (F.col("id") / 10.0).alias("lat"), F.lit(0.0).alias("lon"))
    found = proximity.nearest(points, targets, "id", "t", rows_per_block=16)
    assert found.where("t = id % 5 * 10 and d2 = 0").count() == 500 and looked == [5]


def test_walks_deal_only_labels_that_may_go_on(spark, monkeypatch):
    steps = []
    kept = catchment.kept
    monkeypatch.setattr(catchment, "kept", lambda df, name: steps.append((name, kept(df, name))) or steps[-1][1])
    # a hub whose 40 neighbours are at its far end of the cutoff: each is put out once, none is offered to its region
    pairs = [(0, 1, 500.0), *((1, i, 400.0) for i in range(2, 42)), *((i, i + 100, 200.0) for i in range(2, 42))]
    edges = catchment.undirected(spark.createDataFrame(pairs, "u long, v long, length double"))
    starts = spark.createDataFrame([(7, 0)], "src long, node long")
    got = {(r.node, r.d) for r in catchment.shortest_paths(starts, edges, 1000.0, most_nodes=4).collect()}
    assert got == {(0, 0.0), (1, 500.0), *((i, 900.0) for i in range(2, 42))}
    walks = [df for name, df in steps if name == "walk"]
    assert {r.node for df in walks for r in df.where("kind = 1").collect()} <= {1}  # offers
    dealt = [pickle.loads(r.blob) for df in walks for r in df.where("kind = 0").collect()]  # labels that are dealt again
    assert sum(len(d) for _, _, d in dealt) == 2
