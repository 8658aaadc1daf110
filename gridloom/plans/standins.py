"""City layers made from the driver's tables, which carry no coordinates of their own.

Coordinates follow from ids by integer arithmetic, so that any engine derives the same ones.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.city import Layers
from gridloom.sources.tables import scan

TAGS = {"purchase": "restaurant", "view": "cafe", "click": "bar", "error": "police", "signup": ""}


def lat(key: Column, shift: int = 0) -> Column:
    return F.lit(37.71) + ((key * 7919 + shift) % 12000) / F.lit(1e5)


def lon(key: Column, shift: int = 0) -> Column:
    return F.lit(-122.52) + ((key * 104729 + shift) % 16000) / F.lit(1e5)


def _points(df: DataFrame, key: str, shift: int, *more: Column) -> DataFrame:
    return df.select(F.col(key).alias("id"), lat(F.col(key), shift).alias("lat"), lon(F.col(key), shift).alias("lon"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", hint="the folder holds no such table")


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "part"), "p_partkey", 0, F.col("p_type").alias("category"), F.col("p_name").alias("name"))


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    key = F.col("event_id")
    return _points(
        table(spark, sf_dir, "events"),
        "event_id",
        11,
        tag[F.col("event_type")].alias("amenity"),
        F.when(F.col("event_type") == "signup", F.when(key % 3 == 0, "nan").otherwise("bakery")).otherwise("").alias("shop"),
        F.when(key % 11 == 0, "park").otherwise("").alias("leisure"),
    )


def transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "supplier"), "s_suppkey", 23, F.col("s_name").alias("name"))


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "customer"), "c_custkey", 37)


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, length): some lengths are zero, and many pairs have parallel edges."""
    orders, size = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))  # one row
    return orders.crossJoin(F.broadcast(size)).select(
        F.col("o_custkey").alias("u"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("n")).alias("v"),
        F.when(F.col("o_orderkey") % 97 == 0, 0.0).otherwise((100 + (F.col("o_orderkey") * 37) % 900).cast("double")).alias("length"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "orders"), "o_orderkey", 41)


def building_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners around each building, of a width and height that follow from its id."""
    key = F.col("id")
    wide, tall = (key % 7 + 1) / F.lit(1e5), (key % 5 + 1) / F.lit(1e5)
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("lat") + tall * dy).alias("lat"), (F.col("lon") + wide * dx).alias("lon")) for i, (dx, dy) in enumerate(((0, 0), (2, 0), (2, 1), (0, 1)))])
    return buildings(spark, sf_dir).select(key.alias("feature_id"), F.lit(0).alias("ring"), F.explode(corners).alias("c")).select("feature_id", "ring", "c.*")


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    return Layers(pois(spark, sf_dir), amenities(spark, sf_dir), transit(spark, sf_dir), road_nodes(spark, sf_dir), buildings(spark, sf_dir))


def _city(key: Column) -> Column:
    return F.when(key % 2 == 0, "west").otherwise("east").alias("city")


def _halved(points: DataFrame) -> DataFrame:
    """Every other point to each of two cities, in which ids are given anew, so that both have the same."""
    return points.withColumns({"city": _city(F.col("id")), "id": F.floor(F.col("id") / 2)})


def city_layers(spark: SparkSession, sf_dir: str) -> Layers:
    whole = layers(spark, sf_dir)
    return Layers(*[_halved(getattr(whole, f.name)) for f in fields(Layers)])


def city_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, length, city) of the edges between nodes of one city."""
    inside = road_edges(spark, sf_dir).where(F.col("u") % 2 == F.col("v") % 2)
    return inside.select(F.floor(F.col("u") / 2).alias("u"), F.floor(F.col("v") / 2).alias("v"), "length", _city(F.col("u")))
