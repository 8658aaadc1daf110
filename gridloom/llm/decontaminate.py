"""Benchmark decontamination by winnowing.

Words: runs of ASCII letters (lower-cased), digits and characters outside ASCII. A window is
``span`` consecutive words of an item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

Winnowing keeps the smallest hash of each ``span - gram + 1`` consecutive word ``gram``-grams (all
that tie for it). Two texts that share ``span`` words share such a run of grams, hence a kept
fingerprint at the same place. So the documents' fingerprints are joined with the items', and each
hit is extended to the windows around it: those of the document's ``span`` words that hold the
fingerprint are compared with the items' windows, by a 64-bit hash of their words and then word by
word (by 64-bit hashes of the words). Items shorter than a window are looked up whole. Every step is
linear in a text's words, also where a text or an item repeats one word.

Items of at most ``block_bytes`` of text in all (counted first) are an index that every task holds:
one scan of the documents, no shuffle. A larger benchmark is fingerprinted in tasks; a bitmap of
fixed size marks its fingerprints, the documents' windows around marked ones are joined with the
items' windows, salted so that a passage of many documents is spread, and hits are gathered per
document. Items and documents are never gathered anywhere.

Null texts have no words. Each input row has its row in the result, repeated rows too; a null id
stays null. Items without words, or whose id is null, match nothing. Item ids that repeat count
once. Other columns of the input are ignored; empty inputs give no rows, or rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.shared import plain, stored

WORD = bt.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and n + 1 offsets into them."""
    part = bt.LOWER[data]
    starts, ends, at = bt.words(part, offsets, WORD)
    return bt.span_hashes(part, starts, ends), at


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of() over each n consecutive values, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def winnow(words: np.ndarray, at: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept fingerprints of all texts."""
    width = span - gram + 1
    hashes = bt.gram_hashes(words, gram)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    inside = bt.inside_rows(at, gram, len(words))
    whole = bt.inside_rows(at, span, len(words))  # of each window start: its span lies in one text
    if not len(whole):
        return np.zeros(0, np.int64), hashes[:0]
    lows = np.where(whole, _slide(np.where(inside, hashes, _MAX), width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    kept = _slide(np.concatenate([edge, lows, edge]), width, np.maximum) == hashes
    kept &= inside
    at_hit = np.flatnonzero(kept)
    return at_hit, hashes[at_hit]


@dataclass
class Items:
    """Index of some items: fingerprints, and the distinct windows of each length with the items that have them."""

    prints: np.ndarray  # sorted
    windows: dict[int, Windows] = field(default_factory=dict)  # by number of words


@dataclass
class Windows:
    hashes: np.ndarray  # sorted, distinct
    words: np.ndarray  # one row of word hashes for each
    first: np.ndarray  # offsets into ids
    ids: np.ndarray  # item ids


def item_windows(ids: np.ndarray, words: np.ndarray, at: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of a window, hashes, item ids, first words), of all windows, by their length."""
    count = np.diff(at)
    for m in range(1, span + 1):
        rows = np.flatnonzero(count == m if m < span else count >= m)
        if len(rows):
            windows = count[rows] - m + 1
            place = bt.ranges(at[rows], windows)
            yield m, bt.gram_hashes(words, m)[place], np.repeat(ids[rows], windows), place


def index(ids: list[int], texts: list[str], span: int, gram: int) -> Items:
    data, offsets = bt.flat(pa.array(texts, pa.large_string()))
    words, at = word_hashes(data, offsets)
    found = Items(np.unique(winnow(words, at, span, gram)[1]))
    for m, hashes, item, place in item_windows(np.array(ids, dtype=np.int64), words, at, span):
        distinct, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([back, item], axis=1), axis=0)  # an item once for each of its windows
        found.windows[m] = Windows(distinct, words[place[some][:, None] + np.arange(m)], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1])
    return found


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is among the known, which are sorted; its place there)."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def around(positions: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Starts of the windows that hold one of the fingerprints: at most ``reach`` words in front of it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(positions - reach, 0), 1)
    np.add.at(change, positions + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def window_starts(words: np.ndarray, at: np.ndarray, m: int, span: int, gram: int, known) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the documents' windows of m words that may be an item's; ``known``: tells hashes that items may have."""
    if m == span:
        positions, prints = winnow(words, at, span, gram)
        starts = around(positions[known(prints)], len(words), span - gram)
        starts = starts[starts + m <= len(words)]
        grams = bt.gram_hashes(words, m)[starts]
    else:
        grams = bt.gram_hashes(words, m)
        starts = np.flatnonzero(known(grams))
        grams = grams[starts]
    inside = bt.inside_rows(at, m, len(words))[starts]
    return starts[inside], grams[inside]


def find(words: np.ndarray, at: np.ndarray, items: Items, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word is hit; rows and ids of the items that each text has windows of, each once)."""
    change = np.zeros(len(words) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for m, of in items.windows.items():
        starts, grams = window_starts(words, at, m, span, gram, lambda x, known=items.prints if m == span else of.hashes: _among(x, known)[0])
        same, place = _among(grams, of.hashes)
        starts, place = starts[same], place[same]
        for low in range(0, len(starts), 1 << 16):
            some, there = starts[low : low + (1 << 16)], place[low : low + (1 << 16)]
            alike = (words[some[:, None] + np.arange(m)] == of.words[there]).all(axis=1)
            some, there = some[alike], there[alike]
            np.add.at(change, some, 1)
            np.add.at(change, some + m, -1)
            row = np.searchsorted(at, some, side="right") - 1
            row, there = np.unique(np.stack([row, there]), axis=1)  # a window once for each text
            size = of.first[there + 1] - of.first[there]
            pairs.append(np.unique(np.stack([np.repeat(row, size), of.ids[bt.ranges(of.first[there], size)]], axis=1), axis=0))
    rows, ids = np.unique(np.concatenate(pairs), axis=0).T
    return np.cumsum(change[:-1]) > 0, rows, ids


def hit_runs(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of each run of hit words of a text; words are counted within the text."""
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    begin[at[:-1][at[:-1] < len(hit)]] |= hit[at[:-1][at[:-1] < len(hit)]]
    stop = hit.copy()
    stop[:-1] &= ~hit[1:]
    edges = at[1:-1] - 1
    stop[edges[edges >= 0]] |= hit[edges[edges >= 0]]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    return row, starts - at[row], ends - at[row]


def _digests(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order, which tells rows that repeat an id apart."""
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bt.mix(words + place.astype(np.uint64)))])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes, offsets) of groups of texts."""
    for batch in batches:
        data, offsets = bt.flat(batch.column(column))
        for a, b in bt.groups(offsets):
            yield batch.slice(a, b - a), *word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _lists(values: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    """Values sorted by row as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _scan(items, span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, at in _groups(batches):
            n = rows.num_rows
            hit, item_row, ids = find(words, at, items.value, span, gram)
            row, starts, ends = hit_runs(hit, at)
            spans = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"])
            n_hit = np.bincount(row, weights=ends - starts, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(at)), pa.array(n_hit), _lists(pa.array(ids), item_row, n), _lists(spans, row, n), *rows.columns[2:]],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans", *rows.schema.names[2:]],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str, span: int = 13, gram: int = 6, percent: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words, hit words, items and spans of hit words.

    ``contaminated``: some word is hit, and hit words make up ``percent`` of all words or more.
    ``keep``: columns of ``docs``, such as the text, that stay with their rows.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    items = plain(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        held = sorted(items.collect())
        shared = spark.sparkContext.broadcast(index([r.item_id for r in held], [r.text for r in held], span, gram))
        schema = ", ".join([RESULT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema[2:])])
        found = whole.mapInArrow(_scan(shared, span, gram), schema)
    else:
        found = _joined(whole, items, span, gram)
    contaminated = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", "item_ids", "spans", contaminated.alias("contaminated"), *[F.col(f"`kept_{c}`").alias(c) for c in keep])


BITMAP_BITS = 27


def _joined(docs: DataFrame, items: DataFrame, span: int, gram: int, salts: int = 16) -> DataFrame:
    """The result for a benchmark of any size: an equi-join of windows around fingerprints."""
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (m, hash, item_id); m is 0 for a fingerprint."""
        for rows, words, at in _groups(batches):
            prints = np.unique(winnow(words, at, span, gram)[1])
            parts = [(0, prints, np.zeros(len(prints), np.int64)), *((m, h, i) for m, h, i, _ in item_windows(rows.column(0).to_numpy(), words, at, span))]
            for m, hashes, ids in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), m, np.int32)), pa.array(hashes.view(np.int64)), pa.array(ids)], ["m", "hash", "item_id"])

    known = stored(items.mapInArrow(of_items, "m int, hash long, item_id long").distinct(), "windows")
    lengths = sorted(r.m for r in known.select("m").distinct().collect() if r.m)  # span of them at most

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits that these hashes set, by slices of the bitmap."""
        bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        slices = np.packbits(bits).reshape(256, -1)
        some = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([slices[i].tobytes() for i in some], pa.binary())], ["slice", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")])
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    bitmap = np.zeros((256, 1 << (BITMAP_BITS - 11)), dtype=np.uint8)
    looked_up = known.where(F.col("m") < span).select("hash")  # fingerprints and short items
    for r in looked_up.mapInArrow(marks, "slice int, bits binary").groupBy("slice").applyInArrow(either, "slice int, bits binary").toLocalIterator():
        bitmap[r.slice] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.ravel())  # 16 MB, whatever the input

    def marked(hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - BITMAP_BITS)
        return (shared.value[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, at in _groups(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(_digests(words, at)), *rows.columns[2:]], ["doc_id", "n_words", "digest", *rows.schema.names[2:]])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, at in _groups(batches):
            digest = _digests(words, at)
            for m in lengths:
                starts, grams = window_starts(words, at, m, span, gram, marked)
                row = np.searchsorted(at, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(np.diff(at)[row]), pa.array(digest[row]), pa.array(np.full(len(row), m, np.int32)), pa.array((starts - at[row]).astype(np.int32)), pa.array(grams.view(np.int64))], ["doc_id", "n_words", "digest", "m", "start", "hash"])

    key = ["doc_id", "n_words", "digest"]
    of_docs = docs.select("doc_id", "text").mapInArrow(candidates, "doc_id long, n_words long, digest long, m int, start int, hash long").withColumn("salt", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(salts)).cast("int"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    windows = known.where("m > 0")
    hits = stored(of_docs.join(windows.select("m", "hash").distinct().select("m", "hash", every_salt), ["m", "hash", "salt"], "left_semi"), "hits")
    pairs = hits.select(*key, "m", "hash", "salt").distinct().join(windows.select("m", "hash", "item_id", every_salt), ["m", "hash", "salt"]).select(*key, "item_id").distinct()
    same = lambda a, b: (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))) & (F.col(f"{a}.n_words") == F.col(f"{b}.n_words")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    item_ids = pairs.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    starts = hits.groupBy(*key).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))).alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_hit = [], []
            for places, n in zip(batch.column(3), batch.column(1).to_numpy(), strict=True):
                change = np.zeros(int(n) + 1, np.int64)
                ends = places.values.flatten()
                np.add.at(change, ends[0].to_numpy(), 1)
                np.add.at(change, ends[1].to_numpy(), -1)
                hit = np.cumsum(change[:-1]) > 0
                _, low, high = hit_runs(hit, np.array([0, n]))
                spans.append([{"start": s, "end": e} for s, e in zip(low.tolist(), high.tolist(), strict=True)])
                n_hit.append(int(hit.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*key, "n_hit", "spans"])

    merged = starts.select(*key, "places").mapInArrow(merge, "doc_id long, n_words long, digest long, n_hit long, spans array<struct<start:int,end:int>>")
    schema = ", ".join(["doc_id long, n_words long, digest long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[2:])])
    rows = docs.mapInArrow(sizes, schema).alias("r")
    rows = rows.join(merged.alias("m"), same("r", "m"), "left").join(item_ids.alias("i"), same("r", "i"), "left")
    return rows.select(
        "r.doc_id",
        "r.n_words",
        F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("i.item_ids", F.expr("cast(array() as array<bigint>)")).alias("item_ids"),
        F.coalesce("m.spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
        *[f"r.`{c}`" for c in docs.columns[2:]],
    )
