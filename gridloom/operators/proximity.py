"""Range and nearest-neighbour joins, as equi-joins on buckets or blocks with an exact check behind."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import EARTH_RADIUS_M, bearing, compass, haversine_m
from gridloom.functions.scalars import shown_name, whole_metres
from gridloom.operators import boxtree
from gridloom.sources.store import kept


_TURN = 360.0


def _band(lat: Column, tall: float) -> Column:
    return F.floor(lat / F.lit(tall)).cast("long")


def _buckets_around(band: Column, tall: float) -> Column:
    """How many buckets a band of latitude has: each is at least as wide as a band is tall, at the band's edge nearest a pole."""
    edge = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(tall), F.lit(90.0))
    return F.greatest(F.floor(F.lit(_TURN / tall) * F.cos(F.radians(edge))), F.lit(1)).cast("long")


def _bucket_of(lon: Column, buckets: Column) -> Column:
    """The bucket of a longitude, before it is wrapped around the globe."""
    return F.floor((lon + F.lit(180.0)) * buckets / F.lit(_TURN)).cast("long")


def nearest_within(centres: DataFrame, pois: DataFrame, k: int = 5, radius_m: float = 1500.0, match: str | None = "category", scope: str | None = None) -> DataFrame:
    """The k nearest points of each centre within a radius, per category, anywhere on the globe.

    ``centres``: (cell_id, lat, lon); ``pois``: (id, lat, lon, category, name?). Bands of latitude are
    as tall as the radius and cut in buckets of about that width; a centre looks into the buckets
    that its radius touches in its own band and the two beside it, around the date line and poles too.
    Of a category's points at one place only the k of smallest ids can be among the nearest and are looked at.
    Radii grow from one within which about 8 k points of a category are to be expected; centres go on to the next
    for the categories of which they have found fewer than k.
    ``match=None``: the k nearest of any category. ``scope``: a column of both, such as the city, in
    whose limits points are looked for. Rows: cell_id, scope?, category, rank, id, name, distance_m (rounded
    half to even), direction. Ties go to the smaller id.
    """
    keys = [scope] if scope else []
    by = [*keys, *(["_m"] if match else [])]
    group = F.coalesce(F.concat(F.lit("="), F.col(match).cast("string")), F.lit("")) if match else F.lit("")  # null is a category too
    name = F.col("name") if "name" in pois.columns else F.lit(None).cast("string")
    known = pois.dropna(subset=["lat", "lon"]).select("id", *keys, group.alias("_m"), name.alias("name"), "category", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    same = Window.partitionBy(*by, "p_lat", "p_lon").orderBy("id")
    known = kept(known.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k).drop("_nth"), "places")
    # a table of its own, so that the filter does not carry the formulas of its columns to a scan
    asked = kept(centres.select("cell_id", *keys, "lat", "lon"), "centres").dropna(subset=["lat", "lon"])
    if match:  # a row for each category, as some may need a wider radius than others
        names = known.select(*by).distinct()
        asked = asked.join(names, keys) if keys else asked.crossJoin(names)
    asked, found = kept(asked, "asked"), []
    radii = _radii(known, by, k, radius_m)
    for i, radius in enumerate(radii):
        near = _within(asked, known, by, radius)
        if i == len(radii) - 1:
            found.append(near)
            break
        near = kept(_first(near, by, k), "near")
        # a point just beyond the radius may be as far in whole micrometres as one just within
        full = near.where((F.col("rank") == k) & (F.col("_um") < math.floor(radius * 1e6))).select("cell_id", *by)
        found.append(near.join(full, ["cell_id", *by], "left_semi").drop("rank"))
        asked = kept(asked.join(full, ["cell_id", *by], "left_anti"), "asked")
        if asked.isEmpty():
            break
    best = _first(functools.reduce(DataFrame.unionByName, found), by, k)
    return best.select("cell_id", *keys, "category", "rank", "id", shown_name(F.col("name")).alias("name"), whole_metres(F.col("_d")).alias("distance_m"), compass(bearing(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).alias("direction"))


#: Squared degrees that a group's points are taken to lie in at least.
_LEAST_BOX = 1e-9


def _radii(known: DataFrame, by: list[str], k: int, radius_m: float) -> list[float]:
    """Growing radii up to ``radius_m``, from one that holds about 8 k points of the group of fewest a square metre."""
    span = lambda c: F.max(c) - F.min(c)
    box = F.greatest(span("p_lat") * span("p_lon") * F.cos(F.radians(F.avg("p_lat"))), F.lit(_LEAST_BOX))
    density = known.groupBy(*by).agg((F.count("*") / (box * 111_000.0**2)).alias("n")).agg(F.percentile_approx("n", 0.25)).first()[0]
    out = [radius_m]
    first = math.sqrt(8 * k / (math.pi * density)) if density else radius_m
    while out[0] / 4 >= first:
        out.insert(0, out[0] / 4)
    if out[0] > first * 2:
        out.insert(0, max(first, out[0] / 4))
    return out


def _first(near: DataFrame, by: list[str], k: int) -> DataFrame:
    # the columns that are ranked by are made first, so that the rows beyond k can be left out before they are sent
    order = Window.partitionBy("cell_id", *by).orderBy("_um", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _within(asked: DataFrame, known: DataFrame, by: list[str], radius_m: float) -> DataFrame:
    """Points within a radius of each asked centre, of its scope and category, with their distance _d; in whole micrometres _um."""
    tall = radius_m / 111_000.0
    band = _band(F.col("lat"), tall)
    right = (known if "_m" in by else known.drop("_m")).withColumn("blat", _band(F.col("p_lat"), tall)).withColumn("_n", _buckets_around(F.col("blat"), tall)).withColumn("blon", F.pmod(_bucket_of(F.col("p_lon"), F.col("_n")), F.col("_n"))).drop("_n")
    # the largest difference in longitude within the radius; all of the globe where that holds a pole
    sine = F.lit(math.sin(radius_m / EARTH_RADIUS_M)) / F.cos(F.radians(F.col("lat")))
    polar = F.abs(F.col("lat")) + tall >= 90.0
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    look = asked.select("cell_id", *by, "lat", "lon", wide.alias("_wide"), F.explode(F.array(band - 1, band, band + 1)).alias("blat"))
    n = _buckets_around(F.col("blat"), tall)
    low = _bucket_of(F.col("lon") - F.col("_wide"), n)
    high = F.least(_bucket_of(F.col("lon") + F.col("_wide"), n), low + n - 1)
    left = look.select("cell_id", *by, "lat", "lon", "blat", F.explode(F.transform(F.sequence(low, high), lambda i: F.pmod(i, n))).alias("blon"))
    met = left.join(right, ["blat", "blon", *by]).drop("blat", "blon")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    return met.withColumn("_d", d).where(F.col("_d") <= radius_m).withColumn("_um", F.floor(F.col("_d") * 1e6 + 0.5))


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, rows_per_block: int = 64, scope: str | None = None) -> DataFrame:
    """(point_id, scope?, target_id, d2): the target with the least squared degree distance; ties: smaller id.

    Both are (id, lat, lon), and ``scope``, a column of both such as the city, if targets are those of
    the point's own scope; ids then count within it. Points without a target drop out, and so do nulls and
    coordinates that are not finite; repeated rows of a point are one. Targets are cut in blocks (see
    ``blocks``). Points descend a tree of the blocks' boxes, many at once in a task, and are joined with the
    blocks that may hold their nearest, of which there are a few. A task holds the boxes of one scope.
    """
    keys = [scope] if scope else []
    own = F.col(scope) if scope else F.lit(0)
    # tables of their own, as both are read again, and so that no filter carries the formulas of its columns to a scan
    given = lambda df, of, name: kept(df.select(own.alias("_s"), F.col(of).alias(name), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "places")
    finite = lambda df: df.dropna(subset=["_s", "lat", "lon"]).where((F.abs("lat") < math.inf) & (F.abs("lon") < math.inf))
    right = finite(given(targets, target_id, "_t")).withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    # one target for each place, so that no number of targets at one place makes a block large
    placed = blocks(right.groupBy("_s", "t_lat", "t_lon").agg(F.min("_t").alias("_t")), rows_per_block)
    every = finite(given(points, point_id, "_p"))
    # points of one place descend once, and a block's places are one row: a place meets each of its blocks in one row
    at = kept(every.select("_s", "lat", "lon").distinct().withColumn("_p", F.lit(0).cast("long")), "points")
    met = boxtree.visits(at, placed).drop("_p")
    packed = placed.groupBy("_s", "_b").agg(F.collect_list(F.struct("t_lat", "t_lon", "_t")).alias("_places"))
    d_lat, d_lon = lambda t: t["t_lat"] - F.col("lat"), lambda t: t["t_lon"] - F.col("lon")
    nearest_of = F.array_min(F.transform("_places", lambda t: F.struct((d_lat(t) * d_lat(t) + d_lon(t) * d_lon(t)).alias("d2"), t["_t"].alias("_t"))))
    best = met.join(packed, ["_s", "_b"]).select("_s", "lat", "lon", nearest_of.alias("best")).groupBy("_s", "lat", "lon").agg(F.min("best").alias("best"))
    found = every.distinct().join(best, ["_s", "lat", "lon"])
    return found.select(F.col("_p").alias(point_id), *([F.col("_s").alias(scope)] if scope else []), F.col("best._t").alias(target_id), "best.d2")


def blocks(places: DataFrame, rows_per_block: int) -> DataFrame:
    """``places`` (_s, t_lat, t_lon, ...) with ``_b``, a block of at most ``rows_per_block`` of a scope's places.

    The box of a scope's places is cut in cells by their number; cells with too many are cut again
    by their own number and box, until none has too many. Only their places go through another round. Of
    a scope of more than 2**18 * ``rows_per_block`` places the blocks are larger, so that there are a few
    times 2**18 at most. Equal places, if any, must be made one before.
    """
    box = [f(c).alias(f"_{m}_{c}") for m, f in (("low", F.min), ("high", F.max)) for c in ("t_lat", "t_lon")]
    most = F.greatest(F.lit(rows_per_block).cast("long"), F.floor(F.col("_n") / (1 << 18)))
    # cells a side, by the number that the cell is to be cut in; both ends of a box always come apart
    side = F.least(F.ceil(F.sqrt(F.col("_n") / F.col("_most"))) + 1, F.lit(1024))
    step = lambda c: F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), F.floor((F.col(c) - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}")) * (F.col("_side") - 1))).otherwise(0)
    left, settled = places.withColumns({"_b": F.lit(0).cast("long"), "_most": F.lit(None).cast("long")}), []
    while True:
        cells = left.groupBy("_s", "_b").agg(F.count("*").alias("_n"), F.coalesce(F.max("_most"), most).alias("_limit"), *box)
        cells = cells.withColumnRenamed("_limit", "_most").withColumn("_side", side)
        met = left.drop("_most").join(cells, ["_s", "_b"])
        open_still = F.col("_n") > F.col("_most")
        cut = F.when(open_still, F.xxhash64("_b", step("t_lat"), step("t_lon"))).otherwise(F.col("_b"))
        seen = kept(met.select(*places.columns, cut.alias("_b"), "_most", open_still.alias("_open")), "blocks")
        settled.append(seen.where("not _open").drop("_most", "_open"))
        left = seen.where("_open").drop("_open")
        if left.isEmpty():
            return functools.reduce(DataFrame.union, settled)
