"""Approximate nearest neighbours by inner product, on randomly rotated one-bit codes in coarse lists.

Every vector belongs to the list of its nearest centre c and is kept, relative to it, as the signs
of a random rotation: D bits, and two numbers: |x - c| and s, the product of the direction o of
x - c with its own code. From these, for a rotated query q',

    <q, x> = <q, c> + |x - c| * <q', o>,   <q', o> ~ <q', code> / s,

with an error of at most ``eps * |q| * |x - c| * sqrt((1 - s**2) / (s**2 * (D - 1)))``, but for a
share of vectors that falls off exponentially in eps**2. D is a multiple of the dimensions
(``expand``): longer codes have tighter bounds.

1. Centres and rotation are fitted to a bounded sample of ``sample_rows`` vectors; every vector is
   indexed. Vectors that are equal are one entry each for their k + 1 smallest ids, which are all
   that a result of k can hold, so a vector of a third of all rows is a few entries.
2. Each query's k best rows of the sample are exact finds, and their least score is a threshold that
   its true neighbours reach. It visits the lists of these rows, and lists in order of <q, c>, as many
   as hold the share ``recall`` of true neighbours (measured on the sample, so clustered data take few
   lists and data without clusters many), of those whose bound <q, c> + |q| * radius reaches the
   threshold.
3. Queries meet lists in tasks of bounded size: long lists and their queries are cut in parts, every
   two of which meet. Codes whose upper bound reaches the threshold are reranked by the exact inner
   product in double precision. A ranking over lists gives the k nearest.

``recall=None`` visits every list that its bound allows, and ``eps=inf`` reranks every code met: both
together are exact. Vectors that are null, of another length than most, zero, or that hold null or
non-finite components take no part, as queries or as neighbours; nor do rows without an id. Rows that
repeat an id and a vector count once. Equal scores are ranked by the smaller id. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.samples import draw
from gridloom.llm.shared import stored

_ROWS = 256  # queries estimated at a time
_PAIRS = 1 << 16  # pairs reranked at a time


@dataclass
class Index:
    """Centres of the lists, the rotation, the sample, and how many lists a query visits."""

    centres: np.ndarray
    rotation: np.ndarray  # bits x dimensions
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray
    probes: int

    @property
    def bits(self) -> int:
        return len(self.rotation)


def _centres(rows: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds, from the first rows of a sample."""
    centres = rows[:lists].copy()
    for _ in range(rounds):
        own = _list_of(centres, rows)
        size = np.bincount(own, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _list_of(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *((x[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), 4096))])


def fit(ids: np.ndarray, rows: np.ndarray, lists: int, k: int, recall: float | None, expand: int = 4, seed: int = 4) -> Index:
    """The index's fixed part, from a sample of rows in random order."""
    dims = rows.shape[1]
    bits = -(-expand * dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dims)))
    lists = max(1, min(lists, len(rows) // 4))
    centres = _centres(rows, lists)
    found = Index(centres, q * np.sign(np.diag(r)), ids, rows, _list_of(centres, rows), lists)
    if recall is not None and len(rows) > k:
        some = rows[:512]
        scores = some @ rows.T
        scores[np.arange(len(some)), np.arange(len(some))] = -np.inf
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(some @ found.centres.T), axis=1), axis=1)
        rank = np.take_along_axis(order, found.sample_lists[near], axis=1)
        found.probes = int(np.quantile(rank, recall, method="higher")) + 1
    return found


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list of each row, packed codes, rows x 2 numbers: distance from the centre, product of direction and code)."""
    own = _list_of(index.centres, x)
    apart = x - index.centres[own]
    length = np.linalg.norm(apart, axis=1)
    turned = (apart / np.where(length > 0, length, 1)[:, None]) @ index.rotation.T
    codes = np.packbits(turned > 0, axis=1, bitorder="little")
    return own, codes, np.stack([length, np.abs(turned).sum(axis=1) / index.bits**0.5], axis=1)


def estimates(index: Index, queries: np.ndarray, centre: np.ndarray, signs: np.ndarray, numbers: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, error bounds), queries x vectors of one list. ``signs``: its codes as -1 and 1."""
    length, own = numbers.T
    safe = np.maximum(own, 1e-12)
    scale = (length / safe / index.bits**0.5).astype(np.float32)
    found = (queries @ index.rotation.T).astype(np.float32) @ signs.T
    found *= scale
    found += (queries @ centre).astype(np.float32)[:, None]
    if np.isinf(eps):
        return found, np.full_like(found, np.inf)
    spread = length * np.sqrt(np.maximum(1 - own**2, 0) / max(index.bits - 1, 1)) / safe
    norm = np.linalg.norm(queries, axis=1)
    # the last part covers single precision
    return found, np.outer(eps * norm, spread).astype(np.float32) + (1e-5 * (norm[:, None] * (length + np.linalg.norm(centre)) + 1e-30)).astype(np.float32)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows (or of one query with rows), summed component by component from the first."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += queries[..., d] * rows[:, d]
    return total


def best_of_sample(index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the sample, exact scores), k for each query, best first; a row that is the query's own has -inf."""
    k = min(k, len(index.sample))
    rows, scores = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
    for a in range(0, len(queries), _ROWS):
        q = queries[a : a + _ROWS]
        rough = q @ index.sample.T
        rough[query_ids[a : a + _ROWS, None] == index.sample_ids] = -np.inf
        near = np.argpartition(-rough, k - 1, axis=1)[:, :k]
        score = exact(np.repeat(q, k, axis=0), index.sample[near.ravel()]).reshape(near.shape)
        score[np.isneginf(np.take_along_axis(rough, near, axis=1))] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")
        rows.append(np.take_along_axis(near, order, axis=1))
        scores.append(np.take_along_axis(score, order, axis=1))
    return np.concatenate(rows), np.concatenate(scores)


def nearest_in_list(index: Index, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, codes: np.ndarray, numbers: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, exact scores) of each query's k nearest of a part of a list, of those that reach ``least``."""
    signs = np.unpackbits(codes, axis=1, bitorder="little", count=index.bits).astype(np.float32) * 2 - 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(queries), _ROWS):
        own, q = query_ids[a : a + _ROWS], queries[a : a + _ROWS]
        low = np.where(np.isfinite(least[a : a + _ROWS]), least[a : a + _ROWS], -np.inf)
        found, bound = estimates(index, q, centre, signs, numbers, eps)
        i, j = np.nonzero(found + bound >= low[:, None])
        part = []
        for b in range(0, len(i), _PAIRS):
            pi, pj = i[b : b + _PAIRS], j[b : b + _PAIRS]
            good = (np.einsum("ij,ij->i", q[pi], x[pj]) >= low[pi]) & (own[pi] != ids[pj])
            pi, pj = pi[good], pj[good]
            part.append((pi, pj, exact(q[pi], x[pj])))
        if part:
            i, j, score = (np.concatenate(c) for c in zip(*part, strict=True))
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((own[i[best]], ids[j[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _rows(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of equal length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def search(vectors: DataFrame, is_query, k: int = 20, recall: float | None = 0.98, eps: float = 3.5, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = 8192, list_rows: int = 2048, chunk_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows, by largest inner product.

    ``is_query``: a condition on the id column. ``sample_rows``: rows that centres, rotation and the
    number of lists to visit are fitted to; a quarter of them is the most lists there are.
    ``list_rows``: rows of a list, while that allows it. ``chunk_rows``, ``query_rows``: the most that
    meet in a task, about.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fit_to_use = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    sizes = rows.where(fit_to_use).groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, n = sizes[0]
    good = rows.where(fit_to_use & (F.size("x") == dims))
    some = draw(good, n, sample_rows, 4, "vec_id").collect()  # sample_rows at most
    fitted = fit(np.array([r.vec_id for r in some]), np.array([r.x for r in some]), n // list_rows + 1, k, recall)
    shared = spark.sparkContext.broadcast(fitted)  # bounded by the sample

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims)
                own, codes, numbers = encode(shared.value, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), _blobs(x), _blobs(codes), _blobs(numbers), pa.array(numbers[:, 0])], ["vec_id", "list", "x", "code", "numbers", "radius"])

    alike = Window.partitionBy("x").orderBy("vec_id")
    entries = good.distinct().withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1).select("vec_id", "x")
    index = stored(entries.mapInArrow(put, "vec_id long, list int, x binary, code binary, numbers binary, radius double"), "codes")
    radius = np.full(len(fitted.centres), -np.inf)
    held = np.zeros(len(fitted.centres), np.int64)
    for r in index.groupBy("list").agg(F.max("radius").alias("radius"), F.count("*").alias("n")).collect():  # a row for each list
        radius[r.list], held[r.list] = r.radius, r.n

    best_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
                some, scores = best_of_sample(of, ids, q, k)
                # sums in another order differ in the last places
                least = scores[:, -1] - 1e-9 * (1 + np.abs(scores[:, -1])) if some.shape[1] == k else np.full(len(q), -np.inf)
                least[np.isnan(least)] = -np.inf
                near = q @ of.centres.T
                reach = near + np.linalg.norm(q, axis=1)[:, None] * radius * (1 + 1e-9)
                first = np.argsort(-near, axis=1, kind="stable")[:, : of.probes]
                lists = [np.union1d(row[reach[i, row] >= least[i]], of.sample_lists[some[i]]).astype(np.int32) for i, row in enumerate(first)]
                best = [[{"vec_id": int(of.sample_ids[j]), "score": float(s)} for j, s in zip(*pair, strict=True) if s > -np.inf] for pair in zip(some, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _blobs(q), pa.array(least), pa.array(lists, pa.list_(pa.int32())), pa.array(best, best_type)], ["query_id", "q", "least", "lists", "best"])

    routed = stored(good.where(is_query).distinct().mapInArrow(route, "query_id long, q binary, least double, lists array<int>, best array<struct<vec_id: long, score: double>>"), "asked")
    asked = routed.select("query_id", "q", "least", F.explode("lists").alias("list"))
    visits = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list
    parts = [(i, int(-(-held[i] // chunk_rows)), -(-m // query_rows)) for i, m in sorted(visits.items()) if held[i]]
    if not parts:
        return spark.createDataFrame([], schema)

    def cut() -> DataFrame:
        return F.broadcast(spark.createDataFrame(parts, "list int, parts int, q_parts int"))  # a row for each list

    left = index.drop("radius").join(cut(), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    right = asked.join(cut(), "list").withColumn("q_part", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("q_parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            of = shared.value
            centre = of.centres[one.column("list")[0].as_py()]
            found = nearest_in_list(of, two.column("query_id").to_numpy(), _rows(two.column("q"), "<f8"), two.column("least").to_numpy(), one.column("vec_id").to_numpy(), _rows(one.column("x"), "<f8"), centre, _rows(one.column("code"), np.uint8), _rows(one.column("numbers"), "<f8"), k, eps)
        return pa.table([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    keys = ["list", "part", "q_part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = routed.select("query_id", F.inline("best"))
    # rows of the sample can be found twice, and an id that repeats with another vector from each
    return met.union(known).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
