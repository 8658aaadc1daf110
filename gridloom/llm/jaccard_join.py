"""N-gram Jaccard join: documents whose shingle sets overlap enough, by multiple-order prefix filtering.

A document's set holds the distinct shingles of k words (ASCII letters lower-cased; words end at
white space). Two documents link when ``100 * |intersection| >= percent * |union|``; components
are the connected components of all links.

How it runs, with every step linear in the input's tokens:

1. One pass gives each document its set's size and a 128-bit signature; equal sets are one class,
   represented by its smallest id.
2. Global token orders. All tokens are counted over all documents, in ranges of their hash, and a
   bitmap of fixed size marks those in more than ``common`` documents. Order i is (marked,
   i-th hash): rare tokens first, and unrelated between orders. The bitmap is approximate only
   towards more marks, and any order is a right one: it steers the work, never the result.
3. Linked documents must share tokens of their prefixes under every order. A rare token has few
   documents by definition: pairs that share one under the first order are counted one by one, and so
   are they under every other order; only pairs that share enough prefix tokens under each of them
   stay candidates. Documents of a common token hang on one hub per run of compatible sizes, first
   within each map task, so that a token of a third of all documents still sends one row per task.
   Connected components of these edges confine all links.
4. The sets of documents in such components meet in tasks of bounded size (large components are
   cut in blocks, every two of which meet, and each of which meets itself once). There pairs must pass
   the prefix filters of all orders at once, before their sets are intersected exactly.
5. Connected components of the verified links.

Words and shingles are told apart by 64-bit hashes, sets by 128 bits.

Null or empty texts have no shingles, and link with nothing. A row whose id is null keeps its
size, and has no component. Each row has its row in the result; rows that repeat an id and its
text agree, and rows that repeat an id with another text each join what their own text links to.
Other columns of the input are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.shared import connected_components, partitions, plain, stored

_U = np.uint64
WORD = ~bt.byte_class((0x20, 0x20), (0x09, 0x0D))
#: Seeds of the token orders; a third or fourth order is a further seed.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BITMAP_BITS = 24
_POSTING = np.dtype([("key", "<u8"), ("low", "<i4"), ("high", "<i4"), ("hub", "<i8")])
_EDGE = np.dtype([("a", "<i8"), ("b", "<i8")])
_END = np.dtype([("doc", "<i8"), ("w", "<i8"), ("rest", "<i4"), ("n", "<i4")])
_FLUSH = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, offsets) of groups of texts; each text's tokens are distinct and ascending."""
    data, offsets = bt.flat(column)
    for a, b in bt.groups(offsets):
        part = bt.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, at = bt.words(part, offsets[a : b + 1] - offsets[a], WORD)
        hashes = bt.span_hashes(part, starts, ends)
        count = np.diff(at)
        grams = np.maximum(count - k + 1, 0)
        tokens = bt.gram_hashes(hashes, k)[bt.ranges(at[:-1], grams)]
        rows = np.repeat(np.arange(b - a), grams)
        for n in range(1, k):  # fewer words: the whole sequence is one token
            if len(short := np.flatnonzero(count == n)):
                whole = bt.mix(bt.gram_hashes(hashes, n)[at[short]] + _U(n))
                tokens, rows = np.concatenate([tokens, whole]), np.concatenate([rows, short])
        order = np.lexsort((tokens, rows))
        tokens, rows = tokens[order], rows[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
        tokens, rows = tokens[new], rows[new]
        yield a, b, tokens, np.searchsorted(rows, np.arange(b - a + 1))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes = ([], []), []
            for _, _, tokens, at in shingle_sets(batch.column(1), k):
                for seed, out in zip(ORDERS, sums, strict=True):
                    total = np.concatenate([np.zeros(1, _U), np.cumsum(bt.mix(tokens ^ _U(seed)))])
                    out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                sizes.append(np.diff(at))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), *(pa.array(np.concatenate(x)) for x in sums)], ["doc_id", "n_shingles", "sig_a", "sig_b"])

    return run


def _blobs(values: np.ndarray, bucket: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows (bucket, kind, blob) of values that are sorted by bucket."""
    ids, first = np.unique(bucket, return_index=True)
    blobs = [values[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(values)), strict=len(first) > 0)]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _bucket_bits(df: DataFrame) -> int:
    """Bits of the bucket number: about four buckets for each shuffle partition."""
    return min(16, max(6, math.ceil(math.log2(4 * partitions(df.sparkSession)))))


def common_tokens(docs: DataFrame, k: int, common: int) -> np.ndarray:
    """Bitmap of 2**BITMAP_BITS bits over the leading bits of the token hashes.

    A bit is set when a token behind it is in more than ``common`` of all documents. Counting takes
    32 bits of a token; tokens that agree there are counted together, which can only add marks.
    """
    bits = _bucket_bits(docs)

    def tokens32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            return _blobs(values, values >> np.uint32(32 - bits))

        for batch in batches:
            for _, _, tokens, _ in shingle_sets(batch.column(0), k):
                held.append((tokens >> _U(32)).astype(np.uint32))
                n += len(tokens)
                if n >= 2 * _FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("blob").to_pylist()]))
        marks = np.zeros(1 << (BITMAP_BITS - bits), dtype=np.uint8)
        if len(values) > common:
            often = values[common:][values[common:] == values[:-common]]
            marks[(often >> np.uint32(32 - BITMAP_BITS)) & np.uint32(len(marks) - 1)] = 1
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    slices = plain(docs, "text").mapInArrow(tokens32, "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(count, "bucket int, marks binary")
    width = 1 << (BITMAP_BITS - bits - 3)
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for row in slices.toLocalIterator():  # 2 MB in all, whatever the input
        bitmap[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(row.marks, np.uint8)
    return bitmap


def _ordered(tokens: np.ndarray, rows: np.ndarray, bitmap: np.ndarray, seed: int) -> np.ndarray:
    """Order keys: the leading bit tells common tokens, the others are a hash."""
    slot = tokens >> _U(64 - BITMAP_BITS)
    marked = (bitmap[(slot >> _U(3)).astype(np.int64)] >> (7 - (slot & _U(7))).astype(np.uint8)) & 1
    return (bt.mix(tokens ^ _U(seed)) >> _U(1)) | (marked.astype(_U) << _U(63))


def prefixes(tokens: np.ndarray, at: np.ndarray, bitmap: np.ndarray, seed: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of each set's prefix: its first size - ceil(percent * size / 100) + 1 tokens in this order."""
    sizes = np.diff(at)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keys = _ordered(tokens, rows, bitmap, seed)
    order = np.lexsort((keys, rows))
    most = sizes - (percent * sizes + 99) // 100 + 1
    kept = (np.arange(len(tokens)) - np.repeat(at[:-1], sizes)) < np.repeat(most, sizes)
    return keys[order][kept], rows[kept]


def _runs(rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges posting rows of one key whose sizes may still link: (runs, edges to the hub of each run)."""
    rows = rows[np.lexsort((rows["low"], rows["key"]))]
    reach = rows["high"].astype(np.int64)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = rows["key"][1:] != rows["key"][:-1]
    # the furthest size so far within a key: keys ascend, so a running maximum over (key rank, high) never leaks
    rank = np.cumsum(new)
    reach = np.maximum.accumulate(rank * (1 << 32) + reach) & 0xFFFFFFFF
    new[1:] |= rows["low"][1:].astype(np.int64) * percent > reach[:-1] * 100
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    out = np.empty(len(first), dtype=_POSTING)
    out["key"], out["low"] = rows["key"][first], rows["low"][first]
    out["high"] = np.maximum.reduceat(rows["high"], first) if len(first) else 0
    out["hub"] = np.minimum.reduceat(rows["hub"], first) if len(first) else 0
    hub = out["hub"][run]
    apart = rows["hub"] != hub
    edges = np.empty(int(apart.sum()), dtype=_EDGE)
    edges["a"], edges["b"] = rows["hub"][apart], hub[apart]
    return out, np.unique(edges)


def _pairs(rows: np.ndarray, common: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents with a rare prefix token in common, and how many; at most ``common`` rows share a key."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    out = []
    for step in range(1, common):
        x, y = rows[:-step], rows[step:]
        low, high = np.minimum(x["low"], y["low"]).astype(np.int64), np.maximum(x["low"], y["low"]).astype(np.int64)
        near = (x["key"] == y["key"]) & (100 * low >= percent * high) & (x["hub"] != y["hub"])
        if not near.any():
            continue
        found = np.empty(int(near.sum()), dtype=_EDGE)
        found["a"], found["b"] = np.maximum(x["hub"], y["hub"])[near], np.minimum(x["hub"], y["hub"])[near]
        out.append(found)
    return np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, _EDGE), np.zeros(0, np.int64))


#: Kinds of rows that postings are dealt in: rare tokens and prefix ends of order i are _RARE + 2 i and _RARE + 2 i + 1.
_OFTEN, _HUB, _RARE = 0, 1, 2


def candidate_edges(docs: DataFrame, bitmap, k: int, percent: int, common: int) -> DataFrame:
    """Edges (a, b) whose connected components confine all links, by the prefixes of all orders.

    A rare token has at most ``common`` documents, whose pairs are looked at one by one. If w is the
    smaller of the ends of two prefixes (among rare tokens), all common tokens up to w are in both
    prefixes; further ones number at most what lies behind w in the set whose prefix ends there.
    A pair whose shared prefix tokens and this rest are too few for a link, under any order, is
    dropped. Documents whose prefixes reach common tokens hang on a hub for each such token and run of
    sizes, under the first order.
    """
    bits = _bucket_bits(docs)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            runs, hubs = _runs(np.concatenate(held.pop(_OFTEN)), percent)
            for kind, rows in [(_OFTEN, runs), (_HUB, hubs), *((kind, np.concatenate(x)) for kind, x in held.items())]:
                if rows.dtype == _POSTING:
                    bucket = (rows["key"] >> _U(63 - bits)) & _U((1 << bits) - 1)
                else:
                    bucket = rows["a" if rows.dtype == _EDGE else "doc"] & ((1 << bits) - 1)
                order = np.argsort(bucket, kind="stable")
                yield _blobs(rows[order], bucket[order], kind)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, tokens, at in shingle_sets(batch.column(1), k):
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                for i, seed in enumerate(ORDERS):
                    keys, rows = prefixes(tokens, at, bitmap.value, seed, percent)
                    marked = keys >> _U(63) == 1
                    wanted = slice(None) if i == 0 else ~marked  # common tokens make hubs under the first order alone
                    part = np.empty(len(keys[wanted]), dtype=_POSTING)
                    part["key"], part["hub"] = keys[wanted], ids[a + rows[wanted]]
                    part["low"] = part["high"] = sizes[rows[wanted]]
                    if i == 0:
                        held.setdefault(_OFTEN, []).append(part[marked])
                        part = part[~marked]
                    held.setdefault(_RARE + 2 * i, []).append(part)
                    stop = np.searchsorted(rows, np.arange(b - a), side="right") - 1
                    end = np.empty(len(some), dtype=_END)
                    end["doc"], end["n"] = ids[a + some], sizes[some]
                    end["rest"] = sizes[some] - np.bincount(rows[~marked], minlength=b - a)[some]
                    end["w"] = np.where(marked[stop[some]], np.int64(0x7FFFFFFFFFFFFFFF), keys[stop[some]].view(np.int64))
                    held.setdefault(_RARE + 2 * i + 1, []).append(end)
                    n += len(part)
                if n >= _FLUSH:
                    yield from flush()
                    held, n = {}, 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()

        def of(kind: int, dtype: np.dtype) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for i, x in zip(kinds, blobs, strict=True) if i == kind)])

        hubs = np.unique(np.concatenate([of(_HUB, _EDGE), _runs(of(_OFTEN, _POSTING), percent)[1]]))
        none = np.zeros(len(hubs), np.int64)
        out = [(np.full(len(hubs), _HUB), hubs["a"], hubs["b"], none, none)]
        for kind in range(_RARE, _RARE + 2 * len(ORDERS), 2):
            pairs, shared = _pairs(of(kind, _POSTING), common, percent)
            ends = of(kind + 1, _END)
            out.append((np.full(len(pairs), kind), pairs["a"], pairs["b"], shared, np.zeros(len(pairs), np.int64)))
            out.append((np.full(len(ends), kind + 1), ends["doc"], ends["w"], ends["rest"].astype(np.int64), ends["n"].astype(np.int64)))
        kind, a, b, shared, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"kind": kind.astype(np.int32), "a": a, "b": b, "shared": shared, "n": n})

    some = plain(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    every = stored(some.mapInArrow(postings, "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, shared long, n long"), "prefixes")
    rare = [F.col("kind") == _RARE + 2 * i for i in range(len(ORDERS))]
    counted = every.where(F.col("kind").isin(*[_RARE + 2 * i for i in range(len(ORDERS))]))
    # a pair without a rare token in common under a further order has a count of 0 there
    pairs = counted.groupBy("a", "b").agg(*[F.coalesce(F.sum(F.when(is_order, F.col("shared"))), F.lit(0)).alias(f"shared{i}") for i, is_order in enumerate(rare)]).where("shared0 > 0")
    ends = every.where(F.col("kind").isin(*[_RARE + 2 * i + 1 for i in range(len(ORDERS))]))
    own = ends.groupBy("a").agg(F.max("n").alias("n"), (F.count_if(F.col("kind") == _RARE + 1) > 1).alias("again"), *[F.max(F.when(F.col("kind") == _RARE + 2 * i + 1, F.struct(F.col("b").alias("w"), F.col("shared").alias("rest")))).alias(f"end{i}") for i in range(len(ORDERS))])
    for side in "ab":
        pairs = pairs.join(own.select(F.col("a").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in own.columns[1:]]), side)
    for i in range(len(ORDERS)):
        a, b = F.col(f"a_end{i}"), F.col(f"b_end{i}")
        rest = F.when(a["w"] < b["w"], a["rest"]).when(a["w"] > b["w"], b["rest"]).otherwise(F.least(a["rest"], b["rest"]))
        enough = (100 + percent) * (F.col(f"shared{i}") + rest) >= percent * (F.col("a_n") + F.col("b_n"))
        pairs = pairs.where(F.col("a_again") | F.col("b_again") | enough)  # ids of several rows have several ends
    return pairs.select("a", "b").union(every.where(F.col("kind") == _HUB).select("a", "b"))


def _lists(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the keys held twice or more: (key of each entry, entries by row; first, rows by key)."""
    _, key, size = np.unique(keys, return_inverse=True, return_counts=True)
    held = size[key] > 1
    key, rows = key[held], rows[held]
    by_key = np.argsort(key, kind="stable")
    first = np.searchsorted(key[by_key], np.arange(len(size) + 1))
    return key, np.searchsorted(rows, np.arange(n + 1)), first, rows[by_key]


def _met(i: int, lists: tuple, n: int) -> np.ndarray:
    """How many keys row i shares with each earlier row."""
    key, of_row, first, rows = lists
    keys = key[of_row[i] : of_row[i + 1]]
    found = rows[bt.ranges(first[keys], first[keys + 1] - first[keys])]
    return np.bincount(found[found < i], minlength=n)


def links_within(ids: np.ndarray, tokens: np.ndarray, at: np.ndarray, bitmap: np.ndarray, percent: int, block: np.ndarray | None = None) -> np.ndarray:
    """Component label (smallest id) of each of the given sets, over all pairs of them that link.

    ``block``: only pairs of two blocks are looked at.
    """
    n = len(ids)
    sizes = np.diff(at)
    orders = [_lists(*prefixes(tokens, at, bitmap, seed, percent), n) for seed in ORDERS]
    full = _lists(tokens, np.repeat(np.arange(n), sizes), n)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        if any(o[1][i] == o[1][i + 1] for o in orders):
            continue
        near = _met(i, orders[0], n) > 0
        for other in orders[1:]:
            near &= _met(i, other, n) > 0
        if block is not None:
            near &= block != block[i]
        near = np.flatnonzero(near)
        near = near[(100 * sizes[near] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[near])]
        if not len(near):
            continue
        if len(near) <= 4:
            mine = tokens[at[i] : at[i + 1]]
            same = np.array([np.isin(tokens[at[j] : at[j + 1]], mine, assume_unique=True).sum() for j in near])
        else:
            same = _met(i, full, n)[near]
        for j in near[100 * same >= percent * (sizes[i] + sizes[near] - same)]:
            a, b = root(i), root(int(j))
            if a != b:
                a, b = (a, b) if ids[a] <= ids[b] else (b, a)
                parent[b] = a
    return np.array([ids[root(i)] for i in range(n)], dtype=np.int64)


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, common: int = 8, task_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    ``common``: a token in more documents than this comes late in every order. ``task_tokens``:
    about so many set elements meet in one verification task (twice as many for a large component).
    """
    spark = docs.sparkSession
    pairs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = stored(pairs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, sig_a long, sig_b long"), "sets")
    same = ["n_shingles", "sig_a", "sig_b"]
    classes = stored(sizes.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("first_id")), "classes")

    bitmap = spark.sparkContext.broadcast(common_tokens(pairs, k, common))
    confined = connected_components(candidate_edges(pairs, bitmap, k, percent, common))
    members = stored(confined.join(classes.groupBy("first_id").agg(F.sum("n_shingles").alias("n")), F.col("node") == F.col("first_id")).select("node", "component", "n"), "members")
    totals = members.groupBy("component").agg(F.sum("n").alias("n_all"), F.count("*").alias("docs")).where("docs > 1")
    small = task_tokens // 8
    n_small = totals.where(F.col("n_all") <= small).agg(F.sum("n_all")).first()[0] or 0
    packs = int(n_small // task_tokens) + 1
    blocks = F.when(F.col("n_all") <= small, 1).otherwise(F.ceil(F.col("n_all") / task_tokens)).cast("int")
    placed = members.join(totals, "component").select(
        F.col("node").alias("doc_id"),
        F.when(F.col("n_all") <= small, -1 - F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component")).alias("task"),
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int").alias("block"),
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, at in shingle_sets(batch.column(1), k):
                blobs = pa.array([tokens[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rest.column(0), *rest.columns[2:], blobs], ["doc_id", "task", "blocks", "block", "tokens"])

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        each = [np.frombuffer(x, _U) for x in table.column("tokens").to_pylist()]
        two = table.column("two")[0].as_py()
        block = table.column("block").to_numpy() if two["low"] < two["high"] else None  # a block meets itself in a task of its own
        labels = links_within(ids, np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), bitmap.value, percent, block)
        apart = labels != ids
        return pa.table({"a": ids[apart], "b": labels[apart]})

    chosen = placed.hint("shuffle_hash").join(pairs.where("text is not null"), "doc_id").select("doc_id", "text", "task", "blocks", "block")
    # each document meets every block of its component once: as the lower or as the upper of two
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("low"), F.greatest(j, "block").alias("high")))
    dealt = chosen.mapInArrow(sets, "doc_id long, task long, blocks int, block int, tokens binary").select("doc_id", "task", "block", F.explode(met).alias("two"), "tokens")
    linked = dealt.groupBy("task", "two").applyInArrow(verify, "a long, b long")
    found = connected_components(linked)

    named = sizes.join(classes, same, "left").join(found, F.col("first_id") == F.col("node"), "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id")).alias("component_id"))
