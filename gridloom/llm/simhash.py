"""SimHash near-duplicates: fingerprints of 64 bits, found again through their positional bytes.

Words (ASCII letters lower-cased; they end at white space) make shingles of k words, repeats
included; fewer words are one shingle. Each shingle's XXH64 votes, and a bit of the fingerprint is
set where over half the votes have it. How near fingerprints are found:

1. Equal fingerprints are one class. What follows sees each fingerprint once.
2. Two fingerprints that differ in at most 2 bits share at least 6 of their 8 positional bytes. In an
   inverted index of single bytes each list would hold one in 256 of all fingerprints; so a list is of
   the bytes at four positions, and six such sets of positions (two of four pairs of positions) hold
   every pair that shares six bytes in at least one list.
3. Within lists of at most ``most`` fingerprints the shared positional bytes of each pair are tallied; pairs that
   reach the guaranteed number of matches are verified by counting the bits that differ.
4. A longer list is never looked through pair by pair. There each fingerprint stands under itself and
   the 32 values one bit away in the bytes that the list leaves open. Fingerprints under one value
   differ in at most 2 bits, so each is linked with the smallest, and any two that differ in at most 2
   bits meet under a value. Rows are 33 for a fingerprint, whatever the list's length.
5. Connected components of the links.

Null or empty texts, and texts without words, have the fingerprint zero and link like any other. A
row with a null id has its fingerprint, takes part in no link and has a null component. Repeated rows and
ids each keep their own row. Texts are whole, of any length. Other columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.shared import connected_components, plain, stored

_U = np.uint64
WORD = ~bt.byte_class((0x20, 0x20), (0x09, 0x0D))
DISTANCE = 2
POSITIONS = 8
#: Sets of four byte positions: two of the four pairs of neighbouring positions.
SETS = tuple((2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2))
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_VOTES = 1 << 18


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _round(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turned(lane + word * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one buffer at once."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order].astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    halves = np.lib.stride_tricks.sliding_window_view(padded, 4)
    word = lambda p: words[p].reshape(-1).view("<u8")
    with np.errstate(over="ignore"):
        h = np.full(len(at), _U(seed) + _P5)
        long = int(np.searchsorted(-left, -32, side="right"))
        if long:
            lanes = [np.full(long, _U(seed) + x) for x in (_P1 + _P2, _P2, _U(0), _U(0) - _P1)]
            n = long
            while n:
                for i in range(4):
                    lanes[i][:n] = _round(lanes[i][:n], word(at[:n] + 8 * i))
                at[:n] += 32
                left[:n] -= 32
                n = int(np.searchsorted(-left[:n], -32, side="right"))
            total = sum(_turned(x, bits) for x, bits in zip(lanes, (1, 7, 12, 18), strict=True))
            for x in lanes:
                total = (total ^ _round(np.zeros(long, _U), x)) * _P1 + _P4
            h[:long] = total
        h += lengths[order].astype(_U)
        some = np.flatnonzero(left >= 8)
        while len(some):
            h[some] = _turned(h[some] ^ _round(np.zeros(len(some), _U), word(at[some])), 27) * _P1 + _P4
            at[some] += 8
            left[some] -= 8
            some = some[left[some] >= 8]
        some = np.flatnonzero(left >= 4)
        if len(some):
            h[some] = _turned(h[some] ^ (halves[at[some]].reshape(-1).view("<u4").astype(_U) * _P1), 23) * _P2 + _P3
            at[some] += 4
            left[some] -= 4
        some = np.flatnonzero(left > 0)
        while len(some):
            h[some] = _turned(h[some] ^ (data[at[some]].astype(_U) * _P5), 11) * _P1
            at[some] += 1
            left[some] -= 1
            some = some[left[some] > 0]
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    out = np.empty_like(h)
    out[order] = h
    return out


def _votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes from each start to the next have each of the 64 bits, the highest first.

    Bits are added up eight at a time, one in each byte of a word, over at most 255 hashes.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    runs = (sizes + 254) // 255
    within = bt.ranges(np.zeros(len(starts), np.int64), runs) * 255 + np.repeat(starts, runs)
    ones = _U(0x0101010101010101)
    sums = np.stack([np.add.reduceat((hashes >> _U(bit)) & ones, within) for bit in range(7, -1, -1)], axis=1)
    lanes = sums.astype(">u8").view(np.uint8).reshape(-1, 8, 8).astype(np.int64)  # run, bit within a byte, byte
    return np.add.reduceat(lanes, np.cumsum(runs) - runs, axis=0).transpose(0, 2, 1).reshape(-1, 64)


def fingerprints(column: pa.Array, k: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    data, offsets = bt.flat(column)
    out = [np.zeros(0, _U)]
    for a, b in bt.groups(offsets):
        part = bt.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, at = bt.words(part, offsets[a : b + 1] - offsets[a], WORD)
        sizes = ends - starts
        # one space behind each word
        joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        joined[bt.ranges(first, sizes)] = part[bt.ranges(starts, sizes)]
        count = np.diff(at)
        grams = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
        low = bt.ranges(at[:-1], grams)
        high = np.minimum(low + k, np.repeat(at[1:], grams)) - 1
        set_bits = np.zeros((b - a, 64), np.int64)
        edges = np.concatenate([[0], np.cumsum(grams)])
        for i in range(0, len(low), _VOTES):
            j = min(i + _VOTES, len(low))
            hashes = xxh64(joined, first[low[i:j]], first[high[i:j]] + sizes[high[i:j]] - first[low[i:j]], seed)
            rows = np.flatnonzero((edges[:-1] < j) & (edges[1:] > i) & (grams > 0))
            set_bits[rows] += _votes(hashes, np.maximum(edges[rows], i) - i)
        out.append(np.packbits(2 * set_bits > grams[:, None], axis=1).reshape(-1).view(">u8").astype(_U))
    return np.concatenate(out)


def _prints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), k, seed).view(np.int64))], ["doc_id", "print"])

    return run


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of these byte positions (0: the highest byte), as a signed long."""
    bits = sum(0xFF << (8 * (7 - p)) for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def _signed(bit: int) -> int:
    return -(1 << 63) if bit == 63 else 1 << bit


def shared_bytes(a: Column, b: Column) -> Column:
    """At how many of the eight positions two fingerprints have the same byte."""
    apart = a.bitwiseXOR(b)
    return sum(((F.shiftright(apart, 8 * p).bitwiseAND(F.lit(255))) == 0).cast("int") for p in range(POSITIONS))


def index(prints: DataFrame) -> DataFrame:
    """(part, bytes, print): each distinct fingerprint (a long) in the list of each set of positions."""
    lists = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(SETS)])
    return prints.select(F.explode(lists).alias("list"), "print").select("list.*", "print")


def near_links(prints: DataFrame, most: int = 32) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print long) whose components are those of all pairs at DISTANCE or less."""
    lists = stored(index(prints), "lists")
    sizes = lists.groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    held = lists.join(stored(sizes, "sizes"), ["part", "bytes"])
    few = held.where(F.col("n") <= most).select("part", "bytes", F.col("print").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), ["part", "bytes"]).where("a < b")
    matched = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= POSITIONS - DISTANCE)
    near = matched.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")

    def around(positions: tuple[int, ...]) -> Column:
        free = [8 * (7 - p) + i for p in range(POSITIONS) if p not in positions for i in range(8)]
        return F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(_signed(bit))) for bit in free])

    near_values = F.array(*[around(s) for s in SETS])[F.col("part")]
    many = held.where(F.col("n") > most).select("part", F.explode(near_values).alias("value"), "print")
    # equal leading bytes of a list are in the value; part and value name the group
    hubs = many.groupBy("part", "value").agg(F.min("print").alias("hub"), F.max("print").alias("top")).where("hub < top")
    stars = many.join(hubs, ["part", "value"]).where("print > hub").select(F.col("print").alias("a"), F.col("hub").alias("b"))
    return near.union(stars)


def simhash(docs: DataFrame, k: int = 3, seed: int = 42, most: int = 32) -> DataFrame:
    """(doc_id, print long, component_id) for each row of ``docs`` (doc_id, text)."""
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stored(rows.mapInArrow(_prints(k, seed), "doc_id long, print long"), "prints")
    classes = stored(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first_id")), "classes")
    found = connected_components(near_links(classes.select("print"), most))
    named = classes.join(found, F.col("print") == F.col("node"), "left").withColumn("component", F.coalesce("component", "print")).select("print", "first_id", "component")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.join(least, "component").select("print", "component_id")
    return prints.join(ids, "print", "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
