"""A planar hexagonal grid in column expressions.

Coordinates are projected to metres around an origin (equirectangular: city or region scale), then
to axial coordinates (q, r) of pointy-top hexagons, rounded in cube coordinates. A cell id packs
(q, r) in one bigint. Only + - * / floor abs are used, so any engine agrees on the result, and
neighbourhoods are sums on (q, r): a k-ring is an equi-join with 1 + 3 k (k + 1) offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIFT = 1 << 20
_STRIDE = 1 << 22
#: sqrt(3) / 3 and its inverse, to double precision
_ROOT = 0.5773502691896258
_ROOT3 = 1.7320508075688772


@dataclass(frozen=True)
class HexGrid:
    """Origin in degrees, edge of a cell in metres, metres per degree at the origin.

    Each is a number, or a column of the rows that the grid is applied to.
    """

    lat0: float | Column = 37.77
    lon0: float | Column = -122.44
    edge_m: float | Column = 174.0
    m_per_lat: float | Column = 111_195.0
    m_per_lon: float | Column = 87_892.0

    @staticmethod
    def of_scopes(grids: dict[str, HexGrid], scope: str) -> HexGrid:
        """The grid that each row's ``scope`` has; no cell for scopes without one. For more cities than
        fit in an expression, give the tables columns of origins and make a grid of those."""
        pick = lambda field: F.create_map(*[F.lit(x) for name, g in grids.items() for x in (name, getattr(g, field))])[F.col(scope)]
        return HexGrid(*[pick(f.name) for f in fields(HexGrid)])

    def xy(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return (lon - F.lit(self.lon0)) * F.lit(self.m_per_lon), (lat - F.lit(self.lat0)) * F.lit(self.m_per_lat)

    def with_cell(self, points: DataFrame, lat: str = "lat", lon: str = "lon", into: str = "cell_id") -> DataFrame:
        """Adds the id of the cell that holds each point; null for a null or NaN coordinate.

        As cell_id(), in projections one upon another: each intermediate value is computed once, in generated code.
        """
        lat_c, lon_c = F.col(f"`{lat}`"), F.col(f"`{lon}`")
        valid = lat_c.isNotNull() & lon_c.isNotNull() & ~F.isnan(lat_c) & ~F.isnan(lon_c)
        fq, fr = self._axial(lat_c, lon_c)
        half = lambda c: F.floor(c + F.lit(0.5)).cast("double")
        whole = points.withColumns({"_fq": fq, "_fr": fr}).withColumns({"_q": half(F.col("_fq")), "_r": half(F.col("_fr")), "_s": half(-F.col("_fq") - F.col("_fr"))})
        moved = whole.withColumns({"_dq": F.abs(F.col("_q") - F.col("_fq")), "_dr": F.abs(F.col("_r") - F.col("_fr")), "_ds": F.abs(F.col("_s") + F.col("_fq") + F.col("_fr"))})
        by_q = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
        q = F.when(by_q, -F.col("_r") - F.col("_s")).otherwise(F.col("_q"))
        r = F.when(~by_q & (F.col("_dr") > F.col("_ds")), -F.col("_q") - F.col("_s")).otherwise(F.col("_r"))
        # never null where valid: a filter on the id that is pushed to the scan is one on the coordinates, not on all this
        known = F.coalesce(pack(q, r), F.lit(0).cast("long"))
        return moved.withColumn(into, F.when(valid, known)).drop("_fq", "_fr", "_q", "_r", "_s", "_dq", "_dr", "_ds")

    def _axial(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        x, y = self.xy(lat, lon)
        return (F.lit(_ROOT) * x - y / F.lit(3.0)) / F.lit(self.edge_m), (y * F.lit(2.0) / F.lit(3.0)) / F.lit(self.edge_m)

    def cell_id(self, lat: Column, lon: Column) -> Column:
        fq, fr = self._axial(lat, lon)
        # let-bindings by a one-element transform: each intermediate value is computed once
        whole = F.transform(F.array(F.struct(fq.alias("q"), fr.alias("r"))), _rounded)
        return pack(whole[0]["q"], whole[0]["r"])

    def centre(self, cell_id: Column) -> tuple[Column, Column]:
        """(lat, lon) of the middle of a cell."""
        q, r = unpack(cell_id)
        x = F.lit(self.edge_m) * (F.lit(_ROOT3) * q + F.lit(_ROOT3) / F.lit(2.0) * r)
        y = F.lit(self.edge_m) * (F.lit(1.5) * r)
        return y / F.lit(self.m_per_lat) + F.lit(self.lat0), x / F.lit(self.m_per_lon) + F.lit(self.lon0)


def _rounded(f: Column) -> Column:
    half = lambda c: F.floor(c + F.lit(0.5)).cast("double")
    near = F.array(F.struct(f["q"].alias("fq"), f["r"].alias("fr"), half(f["q"]).alias("q"), half(f["r"]).alias("r"), half(-f["q"] - f["r"]).alias("s")))
    return F.transform(near, _settled)[0]


def _settled(n: Column) -> Column:
    """The coordinate that rounding moved most is taken from the other two."""
    dq, dr, ds = F.abs(n["q"] - n["fq"]), F.abs(n["r"] - n["fr"]), F.abs(n["s"] + n["fq"] + n["fr"])
    by_q = (dq > dr) & (dq > ds)
    q = F.when(by_q, -n["r"] - n["s"]).otherwise(n["q"])
    r = F.when(~by_q & (dr > ds), -n["q"] - n["s"]).otherwise(n["r"])
    return F.struct(q.cast("long").alias("q"), r.cast("long").alias("r"))


def pack(q: Column, r: Column) -> Column:
    return (q.cast("long") + F.lit(_SHIFT)) * F.lit(_STRIDE) + (r.cast("long") + F.lit(_SHIFT))


def unpack(cell_id: Column) -> tuple[Column, Column]:
    return F.floor(cell_id / F.lit(_STRIDE)).cast("long") - F.lit(_SHIFT), cell_id % F.lit(_STRIDE) - F.lit(_SHIFT)


def disk_offsets(k: int) -> list[tuple[int, int]]:
    """(dq, dr) of all cells at hexagonal distance k or less: 1 + 3 k (k + 1) of them."""
    return [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k]


def disk(cell_id: Column, k: int) -> Column:
    """Array of the ids of all cells at distance k or less, the cell itself included."""
    return F.transform(F.array(*[F.lit(q * _STRIDE + r) for q, r in disk_offsets(k)]), lambda d: cell_id + d)


def neighbours(spark: SparkSession, cells: DataFrame, k: int, cell: str = "cell_id") -> DataFrame:
    """(cell_id, nbr_id) pairs of each cell's disk; opaque ids enter as such a table of the caller's."""
    return cells.select(cell, F.explode(disk(F.col(cell), k)).alias("nbr_id"))
