"""Nearest neighbours of feature vectors: exact in blocks, or by locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import coordinates
from gridloom.operators.metricblocks import KEYS, OTHER, cuts_of, in_blocks, in_cells, pairs, pivots_of, reach
from gridloom.sources.store import kept

PACKED = pa.schema([("ids", pa.binary()), ("x", pa.binary()), ("dims", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("n_ids", pa.int64())])


def _rows(vectors: DataFrame, id_column: str, vector: str, scope: str | None = None) -> DataFrame:
    """(scope, id, v) of the rows that have all of them; one scope, 0, where there is none."""
    some = vectors.dropna(subset=[id_column, vector, *([scope] if scope else [])])
    return some.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _dealt(rows: DataFrame, blocks: Column, table: str | Column = "table", bucket: str | Column = "bucket") -> DataFrame:
    """Rows (scope, id, v) with their bucket and, by a hash of the id, their block of it."""
    return rows.select(F.pmod(F.xxhash64("id"), blocks).cast("int").alias("part"), "scope", table, bucket, "id", "v")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of dealt rows as one row each: (scope, table, bucket, part, ids, x, dims, centre, radius, n_ids), from ids on named after ``name``."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        keys = [table.column(key).slice(0, 1).combine_chunks() for key in KEYS]
        # rows with parts that are not finite neither find nor are found
        known = x[np.isfinite(x).all(axis=1)]
        centre = known.mean(axis=0) if len(known) else np.zeros(x.shape[1])
        radius = np.sqrt(((known - centre) ** 2).sum(axis=1)).max(initial=0.0)
        own = [ids[order].tobytes(), x.tobytes(), x.shape[1], centre.tobytes(), radius, len(np.unique(ids))]
        return pa.table([*keys, *[pa.array([value], field.type) for value, field in zip(own, PACKED, strict=True)]], [*KEYS, *PACKED.names])

    packed = rows.groupBy(*KEYS).applyInArrow(pack, f"scope {rows.schema['scope'].dataType.simpleString()}, table int, bucket double, part int, ids binary, x binary, dims int, centre binary, radius double, n_ids long")
    return packed.select(*KEYS, *[F.col(c).alias(f"{name}_{c}") for c in PACKED.names])


class _Nearest:
    """The k nearest found so far to each row of a block, which meets other blocks one after another.

    Differences are rough at first, from one product of matrices in single precision; what could be among
    the k nearest, with a bound for the rounding of the product, is compared again by exact differences.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        known = np.isfinite(x).all(axis=1)  # rows with parts that are not finite find nothing
        self.ids, self.x, self.k = ids[known], x[known], k
        self.norms = (self.x * self.x).sum(axis=1)
        self.dist = np.full((len(self.ids), k), np.inf)
        self.nbrs = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        known = np.isfinite(x).all(axis=1)
        if not known.all():
            ids, x = ids[known], x[known]
        if not len(ids) or not len(self.ids):
            return
        norms = (x * x).sum(axis=1)
        most = norms.max() + self.norms.max()
        kind, unit = (np.float32, 2.0**-23) if most < 1e30 else (np.float64, 2.0**-52)
        two = np.vstack([-2.0 * x.T, norms]).astype(kind)
        slack = 4.0 * (x.shape[1] + 8) * unit * (self.norms + norms.max()) + 1e-30
        shared = np.isin(self.ids, ids)
        for low in range(0, len(self.ids), 512):
            some = slice(low, low + 512)
            part = self.x[some]
            rough = np.hstack([part, np.ones((len(part), 1))]).astype(kind) @ two  # less the norm of the row itself
            if shared[some].any():
                rough[self.ids[some, None] == ids] = np.inf
            limit = self.dist[some, -1]
            if not np.isfinite(limit).all() and len(ids) > self.k:
                limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + self.norms[some] + slack[some])
            limit = np.where(np.isfinite(limit), limit - self.norms[some] + slack[some], np.inf)
            i, j = np.divmod(np.flatnonzero(rough <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None]), len(ids))
            fit = np.isfinite(rough[i, j])
            self._add(i[fit] + low, ids, x, j[fit])

    def _add(self, i: np.ndarray, ids: np.ndarray, x: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), 1 << 20):
            one, two = i[low : low + (1 << 20)], j[low : low + (1 << 20)]
            if not len(one):
                continue
            total = np.zeros(len(one))
            for d in range(x.shape[1]):
                gap = x[two, d] - self.x[one, d]
                total += gap * gap
            rows = np.unique(one)
            at = np.concatenate([np.repeat(rows, self.k), one])
            dist = np.concatenate([self.dist[rows].ravel(), total])
            nbrs = np.concatenate([self.nbrs[rows].ravel(), ids[two]])
            order = np.lexsort((nbrs, dist, at))
            first = np.searchsorted(at[order], rows)
            best = order[first[:, None] + np.arange(self.k)]
            self.dist[rows], self.nbrs[rows] = dist[best], nbrs[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, rank = np.nonzero(np.isfinite(self.dist))
        return self.ids[i], self.nbrs[i, rank], self.dist[i, rank]


#: Blocks of either side that meet in a task at most, on average: each block is sent once to a group of as many.
_TOGETHER = 16


def _met(left: DataFrame, right: DataFrame, meets: DataFrame, k: int) -> DataFrame:
    """(scope, table, bucket, part, id, nbr_id, dist_sq): the k nearest to each row of a block of ``left`` in the blocks of ``right`` that it meets.

    ``meets``: (KEYS, OTHER), the pairs. Blocks are dealt in groups; two groups meet in one task, which holds a copy of
    those of their blocks that have a pair in it, so that a block is sent to as many tasks as there are groups, not pairs.
    A row of ``left`` has k finds in each task, which are ranked after it.
    """
    both = left.select("scope").union(right.select("scope")).groupBy("scope").agg((F.count("*") / 2).alias("_blocks"))
    # few blocks are dealt as well, so that they meet in several tasks
    groups = both.select("scope", F.greatest(F.floor(F.col("_blocks") / _TOGETHER), F.least(F.floor("_blocks"), F.lit(8)), F.lit(1)).alias("_n"))
    group = lambda keys: F.pmod(F.xxhash64(*keys), F.col("_n"))
    dealt = meets.join(groups, "scope").select(*KEYS, *OTHER, group(KEYS[1:]).alias("_i"), group(OTHER).alias("_j"))
    cell = ["scope", "_i", "_j"]
    asked = dealt.groupBy(*cell, *KEYS[1:]).agg(F.collect_list(F.struct(*OTHER)).alias("meets")).join(left, list(KEYS)).select(*cell, *KEYS[1:], "meets", "a_ids", "a_x", "a_dims")
    other = dealt.select(*cell, *OTHER).distinct().join(right.withColumnsRenamed(dict(zip(KEYS[1:], OTHER, strict=True))), ["scope", *OTHER]).select(*[F.col(c).alias(c) for c in cell], *OTHER, "b_ids", "b_x", "b_dims")

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        places = {tuple(r[c] for c in OTHER): i for i, r in enumerate(two.select(OTHER).to_pylist())}
        blocks = [(np.frombuffer(two.column("b_ids")[i].as_py(), np.int64), np.frombuffer(two.column("b_x")[i].as_py()).reshape(-1, two.column("b_dims")[i].as_py())) for i in range(two.num_rows)]
        out = []
        for i, asks in enumerate(one.column("meets").to_pylist()):
            near = _Nearest(np.frombuffer(one.column("a_ids")[i].as_py(), np.int64), np.frombuffer(one.column("a_x")[i].as_py()).reshape(-1, one.column("a_dims")[i].as_py()), k)
            for ask in asks:
                if (at := places.get(tuple(ask[c] for c in OTHER))) is not None:
                    near.meet(*blocks[at])
            found = near.found()
            keys = [one.column(c).slice(i, 1).combine_chunks().take(pa.array(np.zeros(len(found[0]), np.int64))) for c in KEYS]
            out.append(pa.table([*keys, *map(pa.array, found)], names))
        return pa.concat_tables(out) if out else pa.table([*[one.column(c) for c in KEYS], pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)

    names = [*KEYS, "id", "nbr_id", "dist_sq"]
    return asked.groupBy(*cell).cogroup(other.groupBy(*cell)).applyInArrow(meet, f"scope {left.schema['scope'].dataType.simpleString()}, table int, bucket double, part int, id long, nbr_id long, dist_sq double")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("scope", "id").orderBy("dist_sq", "nbr_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("scope", "id", "rank", "nbr_id", "dist_sq")


def _named(ranked: DataFrame, id_column: str, scope: str | None) -> DataFrame:
    return ranked.select(F.col("id").alias(id_column), *([F.col("scope").alias(scope)] if scope else []), "rank", "nbr_id", "dist_sq")


def _sized(rows: DataFrame, rows_per_block: int) -> DataFrame:
    """(scope, blocks): a row for each scope."""
    return kept(rows.groupBy("scope").agg((F.floor(F.count("*") / rows_per_block) + 1).cast("int").alias("blocks")), "blocks")


def exact_knn(vectors: DataFrame, id_column: str, vector: str = "z", k: int = 5, rows_per_block: int = 4096, queries: DataFrame | None = None, scope: str | None = None, pivots: int = 256) -> DataFrame:
    """(id, scope?, rank, nbr_id, dist_sq): the k nearest by squared L2, never the row itself; ties: smaller id.

    Vectors go to the nearest of at most ``pivots`` vectors of their scope and are cut there, by distance,
    in blocks of about ``rows_per_block``. Each block first meets the one of its own place, which says
    how far its rows have to look; then those blocks meet whose centres and radii let them hold a nearer
    row or a tie, and a ranking ends it. A task holds about 16 blocks of either side, and only those with
    a pair that stays; on vectors without clusters that may still be all pairs. Null vectors
    drop out; rows with parts that are not finite find nothing. ``queries``: the rows whose neighbours are
    wanted, if not all; neighbours come from ``vectors``. ``scope``: a column, such as the city, in whose
    limits neighbours are looked for; ids count within it.
    """
    known = _rows(vectors, id_column, vector, scope)
    asked = known if queries is None else _rows(queries, id_column, vector, scope)
    return _named(_exact(known, asked, k, rows_per_block, pivots), id_column, scope)


def _exact(known: DataFrame, asked: DataFrame, k: int, rows_per_block: int, pivots: int = 256) -> DataFrame:
    blocks = _sized(known, rows_per_block)
    if blocks.agg(F.max("blocks")).first()[0] in (None, 1):  # nothing to choose from
        own = blocks if asked is known else _sized(asked, rows_per_block)
        one = (F.lit(0).alias("table"), F.lit(0.0).alias("bucket"))
        left = kept(_packed(_dealt(asked.join(own, "scope"), F.col("blocks"), *one), "a"), "blocks")
        meets = left.select(*KEYS, F.col("table").alias("b_table"), F.col("bucket").alias("b_bucket"), F.lit(0).alias("b_part"))
        return _ranked(_met(left, kept(_packed(_dealt(known, F.lit(1), *one), "b"), "blocks"), meets, k), k)
    a, b, own, first, near = _planned(known, asked, blocks, k, rows_per_block, pivots)
    rest = kept(near.join(own, [*KEYS, *OTHER], "left_anti"), "pairs")
    second = _met(a, b, rest, k)
    return _ranked(first.unionByName(second), k)


def _planned(known: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, rows_per_block: int, pivots: int) -> tuple[DataFrame, ...]:
    """Blocks of both sides, the pairs of a place, what these find, and all pairs that may hold a neighbour."""
    chosen = pivots_of(known, blocks, pivots)
    cells = kept(in_cells(known, chosen), "cells")
    cuts = cuts_of(cells, rows_per_block)
    b = kept(_packed(in_blocks(cells, cuts, rows_per_block), "b"), "blocks")
    if asked is known:
        a = b.withColumnsRenamed({f"b_{c}": f"a_{c}" for c in PACKED.names})
    else:
        a = kept(_packed(in_blocks(kept(in_cells(asked, chosen), "cells"), cuts, rows_per_block), "a"), "blocks")
    places = b.groupBy(*KEYS[:3]).agg(F.count("*").alias("_parts"))
    own = kept(a.join(places, list(KEYS[:3])).select(*KEYS, F.col("table").alias("b_table"), F.col("bucket").alias("b_bucket"), F.pmod("part", "_parts").cast("int").alias("b_part")), "own")
    first = kept(_met(a, b, own, k), "finds")
    about = lambda side, name: side.select(*KEYS, *[F.col(f"{name}_{c}").alias(c) for c in ("centre", "radius", "n_ids")])
    left, right = about(a, "a"), about(b, "b")
    # the farthest k-th neighbour of a block, where all its rows have found k
    each = first.groupBy(*KEYS, "id").agg(F.count("*").alias("n"), F.max("dist_sq").alias("far"))
    found = each.groupBy(*KEYS).agg(F.min("n").alias("least"), F.count("*").alias("ids"), F.sqrt(F.max("far")).alias("far"))
    bounds = left.join(found, list(KEYS), "left").join(reach(left, right, k), list(KEYS), "left")
    sure = F.when((F.col("least") >= k) & (F.col("ids") == F.col("n_ids")), F.col("far"))
    most = F.least(F.coalesce(sure, F.lit(float("inf"))), F.coalesce("most", F.lit(float("inf"))))
    return a, b, own, first, pairs(bounds.select(*left.columns, most.alias("most")), right)


def enrich(neighbours: DataFrame, cells: DataFrame, score: str, scope: str | None = None) -> DataFrame:
    """Neighbours with their centre, score in percent, top category and distance; unknown cells drop out."""
    keys = [scope] if scope else []
    known = cells.select(F.col("cell_id").alias("nbr_id"), *keys, coordinates(F.col("center_lat"), F.col("center_lon")).alias("centre"), (F.rint(F.col(score) * 1000.0) / 10.0).alias("score_pct"), "top_category")
    return neighbours.join(known, ["nbr_id", *keys]).withColumn("distance", F.rint(F.sqrt("dist_sq") * 100.0) / 100.0)


def approximate_knn(vectors: DataFrame, id_column: str, vector: str = "z", k: int = 5, bucket_length: float = 2.0, tables: int = 6, seed: int = 1, rows_per_block: int = 4096, scope: str | None = None) -> DataFrame:
    """As exact_knn, by random-projection hashing from Spark ML: for many vectors, at a recall below 1.

    Buckets are cut in blocks of about ``rows_per_block``; all blocks of a bucket meet, and two of
    them give at most k rows for each vector, however hot the bucket is. A row that finds fewer than
    k others, or whose k-th find is farther than two bucket lengths (hashing misses many of those
    that are far), is compared with all rows, by exact_knn.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = kept(_rows(vectors, id_column, vector, scope), "vectors")
    n = rows.count()
    far = rows
    found = None
    if n > k:
        as_vectors = rows.withColumn("w", array_to_vector("v"))
        model = BucketedRandomProjectionLSH(inputCol="w", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(as_vectors)
        hashed = model.transform(as_vectors).select("scope", "id", "v", F.posexplode("h").alias("table", "h"))
        # adding 0.0 makes -0.0 and 0.0 one bucket
        hashed = hashed.select("scope", "id", "v", "table", (vector_to_array("h")[0] + F.lit(0.0)).alias("bucket"))
        hot = kept(hashed.groupBy("scope", "table", "bucket").count().where(F.col("count") >= rows_per_block).select("scope", "table", "bucket", (F.floor(F.col("count") / rows_per_block) + 1).cast("int").alias("blocks")), "buckets")
        with_blocks = lambda df: df.join(hot, ["scope", "table", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        packed = _dealt(with_blocks(hashed), F.col("blocks"))
        left, right = kept(_packed(packed, "a"), "blocks"), kept(_packed(packed, "b"), "blocks")
        meets = with_blocks(left.select(*KEYS)).withColumns({"b_table": F.col("table"), "b_bucket": F.col("bucket")}).withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = _met(left, right, meets, k)
        found = kept(_ranked(met.select("scope", "id", "nbr_id", "dist_sq").distinct(), k), "finds")
        near = found.where((F.col("rank") == k) & (F.col("dist_sq") <= (2.0 * bucket_length) ** 2)).select("scope", "id")
        far = rows.join(near, ["scope", "id"], "left_anti")
    whole = _exact(rows, far, k, rows_per_block)
    result = whole if found is None else found.join(near, ["scope", "id"], "left_semi").unionByName(whole)
    return _named(result, id_column, scope)
