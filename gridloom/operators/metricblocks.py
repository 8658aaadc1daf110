"""Vectors in blocks of near ones, and pairs of blocks that may hold a neighbour.

A block has a centre and a radius. By the triangle inequality no vector of one block is nearer to one of
another than the gap of their centres less both radii, so pairs of blocks farther apart than the
neighbours already known need not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.store import kept

KEYS = ("scope", "table", "bucket", "part")
OTHER = ("b_table", "b_bucket", "b_part")
#: Cuts of a cell by the distance to its pivot; centres that are compared at once.
RINGS, _CENTRES = 256, 1024


def pivots_of(known: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(scope, salts, pivots): a vector for each block of a scope, ``most`` at most, spread by a hash of the rows."""
    dealt = known.join(blocks, "scope").withColumn("_h", F.xxhash64("id", "v"))
    one = dealt.groupBy("scope", F.pmod("_h", F.least("blocks", F.lit(most))).alias("slot")).agg(F.min_by("v", "_h").alias("v"), F.max("blocks").alias("blocks"))
    return kept(one.groupBy("scope").agg((F.floor(F.max("blocks") / 16) + 1).cast("int").alias("salts"), F.sort_array(F.collect_list("v")).alias("pivots")), "pivots")


def in_cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows (scope, id, v) with their nearest pivot (``table``) and its distance (``gap``).

    Rows of a scope are dealt over groups of about 16 blocks, each of which gets the scope's pivots.
    """

    def nearest(one: pa.Table, two: pa.Table) -> pa.Table:
        n = one.num_rows if two.num_rows else 0
        one, at, gap = one.slice(0, n), np.zeros(n, np.int32), np.zeros(n)
        if n:
            x = one.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            centres = np.array(two.column("pivots")[0].as_py())
            for low in range(0, n, 4096):
                part = x[low : low + 4096]
                at[low : low + 4096] = ((centres * centres).sum(axis=1) - 2.0 * part @ centres.T).argmin(axis=1)
                gap[low : low + 4096] = np.nan_to_num(np.sqrt(((part - centres[at[low : low + 4096]]) ** 2).sum(axis=1)))
        return one.select(["scope", "id", "v"]).append_column("table", pa.array(at)).append_column("gap", pa.array(gap))

    dealt = rows.join(pivots.select("scope", "salts"), "scope").withColumn("salt", F.pmod(F.xxhash64("id", "v"), "salts").cast("int")).drop("salts")
    each = pivots.select("scope", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pivots")
    schema = f"scope {rows.schema['scope'].dataType.simpleString()}, id long, v array<double>, table int, gap double"
    return dealt.groupBy("scope", "salt").cogroup(each.groupBy("scope", "salt")).applyInArrow(nearest, schema)


def cuts_of(cells: DataFrame, rows_per_block: int) -> DataFrame:
    """(scope, table, rings, cuts): quantiles of the distances in each cell."""
    at = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    return kept(cells.groupBy("scope", "table").agg(F.least(F.lit(RINGS), F.floor(F.count("*") / rows_per_block) + 1).alias("rings"), F.percentile_approx("gap", at).alias("cuts")), "cuts")


def in_blocks(cells: DataFrame, cuts: DataFrame, rows_per_block: int) -> DataFrame:
    """Rows of cells with their ring (``bucket``) and, where many are as far from the pivot, a ``part`` by a hash."""
    below = F.size(F.filter("cuts", lambda c: c < F.col("gap")))
    rings = cells.join(cuts, ["scope", "table"]).select("scope", "table", F.floor(below * F.col("rings") / RINGS).cast("double").alias("bucket"), "id", "v")
    sizes = rings.groupBy("scope", "table", "bucket").agg((F.floor(F.count("*") / rows_per_block) + 1).cast("int").alias("parts"))
    return rings.join(sizes, ["scope", "table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")


def _grouped(blocks: DataFrame, name: str) -> DataFrame:
    """(scope, ``name``): descriptions of about _CENTRES blocks in each row."""
    groups = blocks.groupBy("scope").agg((F.floor(F.count("*") / _CENTRES) + 1).alias("_groups"))
    dealt = blocks.join(groups, "scope").withColumn("_group", F.pmod(F.xxhash64(*KEYS[1:]), "_groups"))
    return dealt.groupBy("scope", "_group").agg(F.collect_list(F.struct(*[c for c in blocks.columns if c != "scope"])).alias(name)).drop("_group")


def _gaps(a: list[dict], b: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all centres, and the sums of both radii."""
    one, two = (np.stack([np.frombuffer(x["centre"]) for x in side]) for side in (a, b))
    total = np.zeros((len(a), len(b)))
    for d in range(one.shape[1]):
        total += (one[:, d, None] - two[None, :, d]) ** 2
    return np.sqrt(total), np.array([x["radius"] for x in a])[:, None] + np.array([x["radius"] for x in b])


def _keys(blocks: list[dict], which: np.ndarray) -> list[pa.Array]:
    return [pa.array([blocks[i][c] for i in which], kind) for c, kind in zip(KEYS[1:], (pa.int32(), pa.float64(), pa.int32()), strict=True)]


def reach(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(scope, table, bucket, part, most): within this distance every row of the block has k others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (one, two) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                gaps, radii = _gaps(one, two)
                order = np.argsort(gaps + radii, axis=1)
                # a block may hold the row itself, so one of its ids does not count
                held = np.cumsum(np.array([x["n_ids"] - 1 for x in two])[order], axis=1)
                last = np.minimum((held < k).sum(axis=1), len(two) - 1)
                far = np.take_along_axis(gaps + radii, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
                far[held[:, -1] < k] = np.inf
                which = np.arange(len(one))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which * 0 + at)), *_keys(one, which), pa.array(far)], [*KEYS, "most"])

    scope = a.schema["scope"].dataType.simpleString()
    met = _grouped(a, "a").join(_grouped(b, "b"), "scope").select("scope", "a", "b")
    return met.mapInArrow(run, f"scope {scope}, table int, bucket double, part int, most double").groupBy(*KEYS).agg(F.min("most").alias("most"))


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scope, table, bucket, part, b_table, b_bucket, b_part) of the blocks no farther apart than ``most`` of ``a``.

    A group of centres meets another in a task, and only the pairs that stay become rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (one, two) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                gaps, radii = _gaps(one, two)
                most = np.array([x["most"] for x in one])[:, None]
                slack = 1e-9 * (1.0 + gaps + radii)  # for rounding; ties with a k-th neighbour stay
                i, j = np.nonzero(~(gaps - radii - slack > most))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i * 0 + at)), *_keys(one, i), *_keys(two, j)], [*KEYS, *OTHER])

    scope = a.schema["scope"].dataType.simpleString()
    met = _grouped(a, "a").join(_grouped(b, "b"), "scope").select("scope", "a", "b")
    return met.mapInArrow(run, f"scope {scope}, table int, bucket double, part int, b_table int, b_bucket double, b_part int")
