"""Scans with fallbacks, column resolution, subsets, validity filters, sinks and profiles.

Everything is declared on DataFrames: column pruning and filters on plain columns reach the
Parquet scan by themselves.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BBox:
    west: float
    south: float
    east: float
    north: float


SAN_FRANCISCO = BBox(-122.52, 37.71, -122.36, 37.83)
#: Names by which open point data calls its columns, best first.
CANDIDATES = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "lng", "longitude", "x"), "category": ("category", "primary_category", "categories_primary", "type")}
OPTIONAL = ("id", "name", "cell_id", "country")


class MissingInput(FileNotFoundError):
    """A table that an earlier step of the build writes is not there."""


def scan(spark: SparkSession, *paths: str, hint: str = "run the feature build first") -> DataFrame:
    """The first of the paths that can be read (a slim copy, else the raw table)."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise MissingInput(f"none of {', '.join(paths)} found: {hint}")


def resolve_columns(df: DataFrame, candidates: dict[str, Sequence[str]] | None = None, optional: Iterable[str] = OPTIONAL, required: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Canonical column names: for each the first candidate there is; optional extras are kept."""
    found = {}
    for name, names in (candidates or CANDIDATES).items():
        match = next((c for c in names if c in df.columns), None)
        if match is not None:
            found[name] = match
        elif name in required:
            raise ValueError(f"no column for {name}: looked for {', '.join(names)} in {', '.join(df.columns)}")
    extras = [c for c in optional if c in df.columns and c not in found.values()]
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in found.items()], *[F.col(f"`{c}`") for c in extras])


def within(df: DataFrame, box: BBox, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inclusive bounding-box subset; the filters are pushed to the scan."""
    return df.where(F.col(lon).between(box.west, box.east) & F.col(lat).between(box.south, box.north))


def city_subset(cells: DataFrame, pois: DataFrame, box: BBox) -> tuple[DataFrame, DataFrame]:
    """Cells (by center_lat, center_lon) and points of interest inside a box: an error without cells, a warning without points."""
    inside, points = within(cells, box, "center_lat", "center_lon"), within(pois, box)
    if inside.isEmpty():
        raise MissingInput(f"no cell inside {box}: is it the box of this table?")
    if points.isEmpty():
        warnings.warn(f"no point of interest inside {box}: all counts will be 0", stacklevel=2)
    return inside, points


def valid_points(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates that are there, numbers, and strictly inside the range."""
    return df.dropna(subset=[lat, lon]).where((F.abs(F.col(lat)) < 90.0) & (F.abs(F.col(lon)) < 180.0))


def complete(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key columns are neither null nor NaN."""
    return df.dropna(subset=list(keys))


def tagged(df: DataFrame, tags: dict[str, Sequence[str] | None], points_only: str | None = None) -> DataFrame:
    """Features with a listed value under any listed key (``None``: any value); blank for a missing tag.

    ``points_only``: a geometry-type column, of which only points stay.
    """
    keep = F.lit(False)
    for key, values in tags.items():
        if key in df.columns:
            keep = keep | (F.col(key).isNotNull() if values is None else F.coalesce(F.col(key).isin(*values), F.lit(False)))
    out = df.where(keep)
    if points_only:
        out = out.where(F.lower(points_only) == "point")
    return out.withColumns({key: F.coalesce(F.col(key), F.lit("")) if key in df.columns else F.lit("") for key in tags})


def raw_features(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """(id, feature, value): the numbers of each row in long form."""
    return df.select(id_column, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([id_column], list(columns), "feature", "value")


def numeric_features(df: DataFrame, leave_out: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns (booleans are not) that are not left out."""
    out = set(leave_out)
    return [c for c, kind in df.dtypes if c not in out and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Writes a table; sorted files let later scans skip row groups. ``mode="ignore"`` keeps what has landed.

    Rows are dealt by ranges of the partition columns and then of the sort columns (or of a hash), so
    that a value of most rows is spread over tasks and files.
    """
    if partition_by:
        df = df.repartitionByRange(*partition_by, *(sort_by or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]))
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def slim_pois(pois: DataFrame) -> DataFrame:
    """The columns that interactive use needs, of complete rows."""
    names = [c for c in ("id", "name", "category", "lat", "lon", "cell_id") if c in pois.columns]
    return complete(pois.select(*names), "lat", "lon", "category")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, n_positive, mean, most) of each column, in one pass."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.count_if(x > 0).alias("n_positive"), F.avg(x).alias("mean"), F.max(x).alias("most")))
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("one")).select("one.*")

