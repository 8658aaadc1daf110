"""Best-fit packing of token sequences, by exact complements.

Each document is its ids and an end id. Only documents longer than a sequence are cut, into
pieces of full length; the first piece takes the remainder. Pieces are then placed so that
sequences are filled exactly wherever possible:

* The number of pieces of each length is counted over all documents: at most ``size`` counts,
  whatever the input. The plan is made on these counts alone.
* An index holds how often one, two and three lengths that are still available add up to each sum,
  and is kept up as pieces are used. The longest length left opens a sequence, whose gap is looked up
  there; an exact fill closes it. Where there is none, the longest piece that fits is added (best fit)
  and the smaller gap is looked up again.
* A combination is used as often as its lengths last, so that every step exhausts a length and the
  plan has a few thousand combinations at most.
* The plan gives each length's pieces, by rank, to combinations. Ranks are counted in salted groups
  of each length, as many as it needs, so that a length of most pieces is spread over many tasks.

Null text is an empty one: its end id alone. Null ids are kept; rows that repeat are packed each.
Other columns of the input are ignored. An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import plain, stored
from gridloom.llm.wordtokens import encode_groups

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cut(path: str, mode: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, at in encode_groups(batch.column(1), path, mode, end_id):
                count = np.diff(at)
                pieces = (count + size - 1) // size
                head = count - (pieces - 1) * size
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                ends = (4 * (at[:-1][row] + start + length)).astype(np.int32)
                bounds = pa.py_buffer(np.concatenate([np.zeros(1, np.int32), ends]).tobytes())
                blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, bounds, pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs], ["doc_id", "piece", "start", "length", "ids"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, mode: str = "spaces", end_id: int = 0, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids?) of all pieces; ids are little-endian unsigned 32-bit integers.

    Without ids the table that is written stays a small part of the texts.
    """
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(_cut(tokenizer, mode, end_id, size), PIECES)
    return stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])), "pieces")


@dataclass
class Plan:
    """Runs of pieces of one length: ranks from ``rank`` on go, ``each`` to a sequence, to sequences from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class SumIndex:
    """Which sums one, two and three available lengths have, under the counts of what is left of each.

    ``pairs[s]`` and ``triples[s]`` count the sets of two and of three lengths (a length may stand in one
    as often as pieces of it are left) that add up to s. Only the last three pieces of a length matter to
    them: taking one changes the sums with one shifted addition, so nothing is ever searched afresh.
    """

    def __init__(self, counts: np.ndarray):
        self.size = len(counts) - 1
        self.left = np.zeros(len(counts), np.int64)
        self.some = np.zeros(len(counts), np.int64)  # 1 where a length is left
        self.pairs = np.zeros(len(counts), np.int64)
        self.triples = np.zeros(len(counts), np.int64)
        for length in np.flatnonzero(counts):
            self.change(int(length), int(counts[length]))

    def _add(self, sums: np.ndarray, shift: int, of: np.ndarray, sign: int) -> None:
        if shift <= self.size:
            sums[shift:] += sign * of[: self.size + 1 - shift]

    def change(self, length: int, by: int) -> None:
        """``by`` more pieces of a length are available, or fewer if it is negative."""
        before, after = int(min(self.left[length], 3)), int(min(self.left[length] + by, 3))
        self.left[length] += by
        sign = 1 if after > before else -1
        for level in range(before + 1, after + 1) if sign > 0 else range(before, after, -1):
            if level == 1:  # sets that have the length once: with pairs and single lengths free of it
                self.some[length] = 0
                if sign < 0:
                    self._add(self.pairs, length, self.some, -1)
                self._add(self.triples, length, self.pairs, sign)
                if sign > 0:
                    self._add(self.pairs, length, self.some, 1)
                    self.some[length] = 1
            elif level == 2:  # sets that have it twice
                self.some[length] = 0
                self._add(self.triples, 2 * length, self.some, sign)
                self.some[length] = 1
                if 2 * length <= self.size:
                    self.pairs[2 * length] += sign
            elif 3 * length <= self.size:
                self.triples[3 * length] += sign

    def _two(self, total: int) -> list[int]:
        """Two lengths of that sum, of those most often left."""
        low = np.arange(total // 2 + 1)
        each = np.minimum(self.left[low], self.left[total - low])
        if total % 2 == 0:
            each[-1] = self.left[total // 2] // 2
        return [total - int(np.argmax(each)), int(np.argmax(each))]

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths whose sum is the gap."""
        if self.left[gap] > 0:
            return [gap]
        if self.pairs[gap] > 0:
            return self._two(gap)
        if self.triples[gap] > 0:
            longest = np.flatnonzero((self.some[: gap + 1] > 0) & (self.pairs[gap::-1] > 0))  # the other two may need the same piece
            for third in longest[::-1].tolist():
                self.change(third, -1)
                found = self._two(gap - third) if self.pairs[gap - third] > 0 else None
                self.change(third, 1)
                if found:
                    return [third, *found]
        return None


def make_plan(counts: np.ndarray, size: int) -> Plan:
    """``counts``: available pieces of each length 0 .. size."""
    index = SumIndex(counts)
    left = index.left
    used = np.zeros(size + 1, np.int64)
    rows, sequences = [], 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        inside: list[int] = []
        gap = size

        def put(length: int, times: int = 1) -> None:
            nonlocal gap
            inside.extend([length] * times)
            index.change(length, -times)
            gap -= length * times

        put(longest)
        while gap:
            if fill := index.exact(gap):
                for length in fill:
                    put(length)
                break
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            put(best, min(int(left[best]), gap // best) if best * 4 < gap else 1)  # far from full: only the last few are chosen singly
        lengths, each = np.unique(inside, return_counts=True)
        more = int((left[lengths] // each).min())  # the same again, as often as its lengths last
        offset = 0
        for length, n in zip(lengths[::-1].tolist(), each[::-1].tolist(), strict=True):
            rows.append((length, int(used[length]), n, sequences, offset))
            offset += length * n
            used[length] += n * (more + 1)
            index.change(length, -n * more)
        sequences += more + 1
    rows.sort()
    columns = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(5)]
    return Plan(*columns, sequences)


def _assign(plan, ranks_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        most = np.int64(1) << 44
        keys = p.length * most + p.rank
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(ranks_at).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * most + rank, side="right") - 1
            nth = rank - p.rank[at]
            kept = [i for i in range(batch.num_columns) if i != ranks_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(p.sequence[at] + nth // p.each[at]), pa.array(p.offset[at] + (nth % p.each[at]) * length)],
                [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    return run


def place(pieces: DataFrame, size: int = 2048, rows_per_group: int = 2_000) -> DataFrame:
    """Adds (sequence_id, offset) to rows that have doc_id, piece, start and length; other columns stay.

    ``pieces``: a table as cut_pieces() stores it, of narrow rows (reading it again gives the same rows
    in the same order). Pieces of full length are a sequence each, with negative numbers, and are not
    shuffled; the others are shuffled once, by length, in groups of about ``rows_per_group``.
    """
    spark = pieces.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.where(F.col("length") < size).groupBy("length").count().collect():  # fewer than size rows
        counts[row.length] = row["count"]
    plan = spark.sparkContext.broadcast(make_plan(counts, size))
    names = [f"`{c}`" for c in pieces.columns]
    full = pieces.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = F.element_at(F.lit((counts // rows_per_group + 1).tolist()), F.col("length").cast("int") + 1)  # of each length
    salted = pieces.where(F.col("length") < size).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    groups = salted.groupBy("length", "_salt").count()
    before = groups.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[F.col(f"`{c}`") for c in pieces.columns if c not in ("doc_id", "piece")]))
    ranked = salted.withColumn("_nth", nth).join(before, ["length", "_salt"]).select(*names, (F.col("_before") + F.col("_nth") - 1).alias("_rank"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(_assign(plan, len(pieces.columns)), schema).union(full)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, parts): each packed sequence with its pieces (offset, doc_id, piece, ids) in order.

    ``pieces`` as cut_pieces() returns them, ``placed`` from place(); ids of documents must be distinct.
    """
    keyed = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return keyed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
