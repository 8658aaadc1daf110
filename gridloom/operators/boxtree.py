"""A tree of the boxes of blocks of places, which points descend many at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes under one box of the next level; points that descend together.
FANOUT, TOGETHER = 64, 1024


def ordered(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An order of boxes in which neighbours are near: strips of latitude, each by longitude."""
    centre = (low + high) / 2
    n = len(low)
    strips = max(int(np.sqrt(n / FANOUT)), 1)
    strip = np.empty(n, np.int64)
    strip[np.argsort(centre[:, 0], kind="stable")] = np.arange(n) * strips // n
    return np.lexsort((centre[:, 1], strip))


def levels(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of the tree, from the top level down to the boxes given, in their order."""
    out = [(low, high)]
    while len(out[0][0]) > FANOUT:
        first = np.arange(0, len(out[0][0]), FANOUT)
        out.insert(0, (np.minimum.reduceat(out[0][0], first), np.maximum.reduceat(out[0][1], first)))
    return out


def descend(points: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``points``, boxes): the boxes that may hold a point's nearest place.

    Each side of a box has a place on it. So no nearest place is farther than the far end of the side
    that is best in this respect, and boxes that begin beyond the least such distance are left out.
    Differences, squares and sums round monotonically, so that no tie is lost.
    """
    found = []
    for start in range(0, len(points), TOGETHER):
        part = points[start : start + TOGETHER]
        reach = np.full(len(part), np.inf)
        n = len(tree[0][0])
        at, box = np.repeat(np.arange(len(part)), n), np.tile(np.arange(n), len(part))
        for depth, (low, high) in enumerate(tree):
            if depth:
                n = len(low)
                at, box = np.repeat(at, FANOUT), (box[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at, box = at[box < n], box[box < n]
            p, a, b = part[at], low[box], high[box]
            gap = np.maximum(np.maximum(a - p, p - b), 0.0)
            to_low, to_high = (a - p) ** 2, (b - p) ** 2
            near, far = np.minimum(to_low, to_high), np.maximum(to_low, to_high)
            sure = np.minimum(near[:, 0] + far[:, 1], far[:, 0] + near[:, 1])
            np.minimum.at(reach, at, sure)
            stay = (gap * gap).sum(axis=1) <= reach[at]
            at, box = at[stay], box[stay]
        found.append((at + start, box))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def visits(points: DataFrame, placed: DataFrame, together: int = 1 << 14) -> DataFrame:
    """(_s, _p, lat, lon, _b): the blocks of ``placed`` (_s, _b, t_lat, t_lon) in which the nearest place to a point may be.

    The boxes of a scope are one group of one task each; its points (_s, _p, lat, lon) are
    dealt in parts of about ``together``, each of which meets a copy of the scope's boxes.
    """
    box = [f(c).alias(f"{m}_{c}") for m, f in (("low", F.min), ("high", F.max)) for c in ("t_lat", "t_lon")]
    boxes = placed.groupBy("_s", "_b").agg(*box)
    sizes = points.groupBy("_s").agg((F.floor(F.count("*") / together) + 1).cast("int").alias("_parts"))
    dealt = points.join(sizes, "_s").withColumn("_part", F.pmod(F.xxhash64("_p", "lat", "lon"), F.col("_parts")).cast("int")).drop("_parts")
    copies = boxes.join(sizes, "_s").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high = (np.stack([right.column(f"{m}_{c}").to_numpy() for c in ("t_lat", "t_lon")], axis=1) for m in ("low", "high"))
        if not len(low) or not left.num_rows:
            return left.slice(0, 0).drop_columns("_part").append_column("_b", pa.array([], pa.int64()))
        order = ordered(low, high)
        at, box = descend(np.stack([left.column(c).to_numpy() for c in ("lat", "lon")], axis=1), levels(low[order], high[order]))
        return left.drop_columns("_part").take(pa.array(at)).append_column("_b", pa.array(right.column("_b").to_numpy()[order[box]]))

    kinds = dict(points.dtypes)
    return dealt.select("_s", "_p", "lat", "lon", "_part").groupBy("_s", "_part").cogroup(copies.groupBy("_s", "_part")).applyInArrow(meet, f"_s {kinds['_s']}, _p {kinds['_p']}, lat double, lon double, _b long")
