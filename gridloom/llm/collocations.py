"""Phrase collocation mining by best-first branch-and-bound growth.

Texts (ASCII letters lower-cased) are split at ``.,;:!?`` and line breaks into pieces, and these into
words at spaces and tabs. In each language, phrases of 2 to ``longest`` words with at least ``least``
occurrences are candidates; a phrase's score is the lowest over its cuts in two parts of
floor(1000 * a * n / (l * r)): a, l and r are the counts of the phrase and its parts, n of all words. A
candidate that a longer one contains with the same count is dropped; the ``most`` best others come back.

Bounds. r and l are at least a, so no phrase that starts or ends with word w scores more than
floor(1000 * n / f(w)): the count of the first word bounds all that grows from it, and that of the
last word bounds what ends there. The frontier is opened best bound first:

1. Words are counted. In the first round the words with the highest bounds are opened, up to about
   ``share`` of a language's occurrences (in steps of powers of two of the bound).
2. A round counts the pairs of words that start or end with an open word, and then the longer phrases
   all of whose counted pairs are frequent. From these, phrases with both ends open have exact scores.
3. Whatever is not scored yet has a bound below the threshold of the round. Where ``most`` survivors
   reach the threshold, a language is settled. Otherwise the next round opens all words whose bounds
   reach the score of the best ``most`` survivors so far, ties included, which settles it (or all words, if
   there were too few).

A phrase survives unless a phrase of one word more, before it or behind, has its count: a longer
candidate with the same count goes through such an extension, and as both ends of a scored phrase are
open, all its extensions were counted.

Counts know phrases by their hashes. Their words come from one more pass, in which a phrase is sent only
from texts whose hash ends in the 16 bits that its count kept (the least of those it was met with).

Counting is a pass over the texts in Arrow batches; counts are combined in the task before the
shuffle, so that frequent words and phrases send one row a batch. Sets of words and phrases reach the
tasks as Bloom filters of 32 bits for each member, of at most 2**30 bits (128 MB); beyond that more of the
other phrases are counted too, with the same result. Words and phrases are told apart by 64-bit hashes.

Defined: a null text is empty, a null language is ``und``; ids are not used, so repeated rows count
each; texts are whole; ties in the order are broken by the phrase in byte order; other columns are ignored; an
empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.shared import partitions, plain, stored

_U = np.uint64
_BREAK = bt.byte_class((0x0A, 0x0D), *((x, x) for x in b".,;:!?"))
WORD = ~(_BREAK | bt.byte_class((0x20, 0x20), (0x09, 0x09)))
MOST_BITS = 30
#: Positions counted at once, and distinct words or phrases held in a task before they are sent.
_FLUSH, _HELD = 1 << 22, 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x2545F4914F6CDD1D, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD], dtype=np.uint64)
LONGEST = len(_ODD)


def words_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For groups of texts of (lang, text): hashes of words, how many words follow in the piece, bytes, starts, ends, rows."""
    names, at_name = bt.flat(batch.column(0))
    of_lang = bt.mix(bt.span_hashes(names, at_name[:-1], at_name[1:]) * _ODD[-1])  # a word may be spelt as a language is
    data, offsets = bt.flat(batch.column(1))
    for a, b in bt.groups(offsets, 4 * bt.GROUP_BYTES):
        part = bt.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, at = bt.words(part, offsets[a : b + 1] - offsets[a], WORD)
        rows = np.repeat(np.arange(a, b), np.diff(at))
        hashes = bt.mix(bt.span_hashes(part, starts, ends) ^ of_lang[rows])
        breaks = np.cumsum(_BREAK[part])[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(starts)))
        yield hashes, np.repeat(first + sizes, sizes) - np.arange(len(starts)) - 1, part, starts, ends, rows


def grams(hashes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... words from each word on (whatever piece they lie in)."""
    out, raw = [hashes], hashes * _ODD[0]
    for m in range(2, longest + 1):
        raw = raw[: max(len(hashes) - m + 1, 0)] + hashes[m - 1 :] * _ODD[m - 1]
        out.append(bt.mix(raw + _U(m)))
    return out


def phrase(words: np.ndarray) -> np.ndarray:
    """The hash that grams() gives each row of words."""
    m = words.shape[1]
    return words[:, 0] if m == 1 else bt.mix((words * _ODD[:m]).sum(axis=1, dtype=np.uint64) + _U(m))


class Bitmap:
    """Which 64-bit hashes belong to a set, and about one in a thousand others: a Bloom filter of three probes."""

    SHIFTS = (0, 17, 34)

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        left = np.arange(len(hashes))
        for shift in self.SHIFTS:
            slot = (hashes[left] >> _U(shift)) & _U((1 << self.bits) - 1)
            hit = (self.table[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1
            found[left[~hit]] = False
            left = left[hit]
        return found

    @staticmethod
    def of(hashes: DataFrame, column: str = "hash") -> Bitmap:
        """Of a column of longs; the driver fetches at most 2**MOST_BITS bits."""
        n = hashes.count()
        bits = min(MOST_BITS, max(15, (32 * n).bit_length()))
        probes = F.array(*[F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in Bitmap.SHIFTS])
        slots = hashes.select(F.explode(probes).alias("slot")).select(F.shiftright("slot", 15).alias("part"), F.col("slot").bitwiseAND(F.lit(32767)).alias("at"))
        table = np.zeros(1 << (bits - 3), np.uint8)
        for row in slots.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
            table[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
        return Bitmap(bits, table)


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, hash, word, n) of all words of ``docs`` (lang, text)."""

    def collect(held: list[tuple]) -> tuple:
        ids, n, langs, words = zip(*held, strict=True)
        one, first, of = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        return one, np.bincount(of, weights=np.concatenate(n)).astype(np.int64), pa.concat_arrays(langs).take(pa.array(first)), pa.concat_arrays(words).take(pa.array(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes, _, part, starts, ends, rows in words_of(batch):
                ids, first, n = np.unique(hashes, return_index=True, return_counts=True)
                sizes = ends[first] - starts[first]
                text = part[bt.ranges(starts[first], sizes)].tobytes()
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(text)])
                held.append((ids, n, batch.column(0).take(pa.array(rows[first])), words.cast(pa.binary())))
                size += len(ids)
                if size >= _HELD:
                    held = [collect(held)]
                    if (size := len(held[0][0])) >= _HELD // 2:
                        yield dealt(held.pop())
                        size = 0
        if held:
            yield dealt(collect(held))

    def dealt(found: tuple) -> pa.RecordBatch:
        ids, n, langs, words = found
        return pa.RecordBatch.from_arrays([langs, pa.array(ids.view(np.int64)), words, pa.array(n)], ["lang", "hash", "word", "n"])

    found = docs.mapInArrow(run, "lang string, hash long, word binary, n long")
    return found.groupBy("lang", "hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def places(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word, 16 bits of a hash of the words of its text."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    of_text = bt.mix(np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(rows)))).astype(np.uint64) + _U(1)), first)) >> _U(48)
    return np.repeat(of_text.astype(np.int16), np.diff(np.append(first, len(rows))))


def placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hash of a phrase at a place."""
    return bt.mix(hashes + place.astype(np.uint64) * _ODD[-1])


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    every, place = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, first, n = np.unique(every, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n), pa.array(place[first])], ["hash", "n", "place"])


def _positions(hashes: np.ndarray, follow: np.ndarray, m: int, ends: np.ndarray, known: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """Where phrases of m words may be counted: within a piece, all words frequent, an end open, no pair known to be rare."""
    size = len(hashes) - m + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((follow[:size] >= m - 1) & (ends[:size] | ends[m - 1 :]) & known[:size] & known[m - 1 :])
    for k in range(1, m - 1):
        at = at[known[at + k]]
    if pairs is not None:
        for k in range(m - 1):
            at = at[pairs[at + k]]
    return at


def _common_pairs(two: np.ndarray, opened: np.ndarray, frequent) -> np.ndarray:
    """Of each pair of neighbours, whether it may be frequent; those with no open word were never counted."""
    out = np.ones(len(two), dtype=bool)
    looked = np.flatnonzero(opened[:-1] | opened[1:])
    out[looked] = frequent.has(two[looked])
    return out


def count_phrases(docs: DataFrame, sizes: range, opened, known, pairs=None) -> DataFrame:
    """(hash, n, place) of the phrases of these sizes that start or end with an open word. The sets are broadcast filters.

    place: one of the places of texts that the phrase occurs in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for hashes, follow, _, _, _, rows in words_of(batch):
                if len(hashes) < 2:
                    continue
                ends, common = opened.value.has(hashes), known.value.has(hashes)
                every, place = grams(hashes, sizes[-1]), places(hashes, rows)
                two = None if pairs is None else _common_pairs(every[1], ends, pairs.value)
                for m in sizes:
                    at = _positions(hashes, follow, m, ends, common, two)
                    held.append((every[m - 1][at], place[at]))
                    n += len(at)
                if n >= _FLUSH:
                    yield _counted(held)
                    held, n = [], 0
        if n:
            yield _counted(held)

    return docs.mapInArrow(run, "hash long, n long, place short").groupBy("hash").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def describe(docs: DataFrame, wanted, opened, known, pairs, longest: int) -> DataFrame:
    """(hash, open, cuts array<struct<k, head, tail>>, words) of counted phrases, from the places that were kept of them.

    ``wanted``: phrases at their places. open: whether both ends are open; head and tail: hashes of
    the parts before and behind a cut after k words. A phrase is sent by the tasks that hold texts of its place
    alone, so that there are about as many rows as phrases, however many tasks meet them. Filters let a
    few phrases through that were not asked for.
    """
    names = ["hash", "open", *(f"word{k}" for k in range(1, longest + 1))]

    def one(held: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(held, axis=1)
        return rows[:, np.unique(rows[0], return_index=True)[1]]

    def sent(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in rows], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for hashes, follow, _, _, _, rows in words_of(batch):
                if len(hashes) < 2:
                    continue
                ends, common = opened.value.has(hashes), known.value.has(hashes)
                every, place = grams(hashes, longest), places(hashes, rows)
                two = _common_pairs(every[1], ends, pairs.value)
                for m in range(2, longest + 1):
                    at = _positions(hashes, follow, m, ends, common, two)
                    at = at[wanted.value.has(placed(every[m - 1][at], place[at]))]
                    out = np.zeros((len(names), len(at)), np.uint64)
                    out[0], out[1] = every[m - 1][at], ends[at] & ends[at + m - 1]
                    for k in range(m):
                        out[2 + k] = hashes[at + k]
                    held.append(out)
                    n += len(at)
            if n >= _HELD // 2:
                held = [one(held)]
                if (n := held[0].shape[1]) >= _HELD // 4:
                    yield sent(held.pop())
                    n = 0
        if n:
            yield sent(one(held))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([c.to_numpy(zero_copy_only=False).view(_U) for c in batch.columns[2:]], axis=1)
            sizes = (words != 0).sum(axis=1)
            rows = np.repeat(np.arange(len(words)), sizes - 1)
            k = bt.ranges(np.ones(len(words), np.int64), sizes - 1)
            head, tail = np.zeros(len(k), _U), np.zeros(len(k), _U)
            for m in range(1, longest):
                of = np.flatnonzero(k == m)
                head[of] = phrase(words[rows[of], :m])
            for m in range(1, longest):
                of = np.flatnonzero(sizes[rows] - k == m)
                tail[of] = phrase(words[rows[of][:, None], k[of][:, None] + np.arange(m)])
            at = pa.array(np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32))
            cuts = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(k), pa.array(head.view(np.int64)), pa.array(tail.view(np.int64))], ["k", "head", "tail"]))
            every = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(words[words != 0].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() > 0), cuts, every], ["hash", "open", "cuts", "words"])

    found = docs.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("hash").agg(*[F.max(c).alias(c) for c in names[1:]])
    return found.mapInArrow(cut, "hash long, open boolean, cuts array<struct<k: long, head: long, tail: long>>, words array<long>")


def surviving(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The phrases with both ends open, with ``survives``: whether no phrase of one word more that starts or ends with it has its count.

    All such longer phrases have an open end and were counted, and a longer candidate of any length with the same count goes through one of them.
    """
    longer = found.where(F.size("words") > 2).join(counts, "hash").select("n", F.explode(F.array(F.col("cuts")[0]["tail"], F.element_at("cuts", -1)["head"])).alias("hash"))
    most = longer.groupBy("hash").agg(F.max("n").alias("_longer"))
    met = found.where("open").join(counts, "hash").join(most, "hash", "left")
    return met.select("hash", F.coalesce(F.col("_longer") < F.col("n"), F.lit(True)).alias("survives"), "cuts", "words")


def score(found: DataFrame, counts: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds lang, a, l, r, n and score to phrases. ``counts``: (hash, n) of all phrases and words that may be parts."""
    cuts = found.join(counts.withColumnRenamed("n", "a"), "hash").select("hash", "a", F.col("words")[0].alias("first"), F.explode("cuts").alias("cut")).select("hash", "a", "first", "cut.*")
    cuts = cuts.join(counts.select(F.col("hash").alias("head"), F.col("n").alias("l")), "head").join(counts.select(F.col("hash").alias("tail"), F.col("n").alias("r")), "tail")
    cuts = cuts.join(words.select(F.col("hash").alias("first"), "lang"), "first").join(totals, "lang")
    exact = F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(16,0)) * cast(n as decimal(16,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.withColumn("score", exact).groupBy("hash").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("lang").alias("lang"), F.max("a").alias("a"), F.max("n").alias("n"))
    return found.join(lowest, "hash").select("lang", "hash", "words", "survives", "a", "cut.l", "cut.r", "n", "cut.score")


def best(scored: DataFrame, most: int, salts: int) -> DataFrame:
    """Of each language the phrases that rank among the first ``most`` by score and count, ties at the end too."""
    order = [F.desc("score"), F.desc("a")]
    part = scored.withColumn("salt", F.pmod("hash", F.lit(salts)))
    part = part.withColumn("rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return part.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("salt", "rank")


def first_threshold(frequent: DataFrame, share: float) -> DataFrame:
    """(lang, theta): the power of two whose words of no smaller bound have about ``share`` of all occurrences, or the next higher."""
    steps = frequent.withColumn("step", F.floor(F.log2("bound")).cast("int")).groupBy("lang", "step").agg(F.sum("n").alias("held"), F.max("total").alias("total"))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    so_far = steps.withColumn("so_far", F.sum("held").over(down)).withColumn("nth", F.row_number().over(down))
    return so_far.where((F.col("so_far") <= F.col("total") * share) | (F.col("nth") == 1)).groupBy("lang").agg(F.expr("shiftleft(1L, min(step))").alias("theta"))


def collocations(docs: DataFrame, most: int = 2000, least: int = 100, longest: int = 5, share: float = 1 / 16) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language of ``docs`` (text, lang)."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be from 2 to {LONGEST}")
    spark = docs.sparkSession
    texts = plain(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    words = stored(dictionary(texts), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    bound = F.expr("(cast(1000 as decimal(4,0)) * cast(total as decimal(18,0))) div cast(n as decimal(18,0))")
    frequent = stored(words.where(F.col("n") >= least).join(totals.withColumnRenamed("n", "total"), "lang").withColumn("bound", bound), "frequent")
    theta = stored(first_threshold(frequent, share), "theta")
    done: list[DataFrame] = []
    while theta.limit(1).count():
        scored = stored(_round(spark, texts, frequent, totals, theta, least, longest), "scored")
        found = stored(best(scored.where("survives"), most, partitions(spark)), "best")
        unopened = frequent.join(theta, "lang").where("bound < theta").select("lang").distinct()
        reached = found.join(theta, "lang").groupBy("lang").agg(F.count_if(F.col("score") >= F.col("theta")).alias("above"), F.count("*").alias("held"), F.min("score").alias("lowest"))
        state = theta.join(reached, "lang", "left").join(unopened.withColumn("rest", F.lit(True)), "lang", "left")
        open_still = F.coalesce("rest", F.lit(False)) & (F.coalesce("above", F.lit(0)) < most)
        after = stored(state.select("lang", open_still.alias("again"), F.when(F.col("held") >= most, F.col("lowest")).otherwise(F.lit(0)).cast("long").alias("theta")), "state")
        done.append(found.join(after.where("not again"), "lang", "left_semi"))
        theta = after.where("again").select("lang", "theta")
    return _ranked(_all(done, frequent), frequent, most)


def _all(done: list[DataFrame], frequent: DataFrame) -> DataFrame:
    out = done[0] if done else frequent.where("false").select("lang", "hash", F.array("hash").alias("words"), F.lit(True).alias("survives"), *[F.lit(0).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _round(spark: SparkSession, texts: DataFrame, frequent: DataFrame, totals: DataFrame, theta: DataFrame, least: int, longest: int) -> DataFrame:
    """Exact scores of all candidates whose first and last words have bounds of theta or more."""
    share = spark.sparkContext.broadcast
    here = frequent.join(theta, "lang")
    known, opened = share(Bitmap.of(here)), share(Bitmap.of(here.where("bound >= theta")))
    two = stored(count_phrases(texts, range(2, 3), opened, known).where(F.col("n") >= least), "pairs")
    pairs = share(Bitmap.of(two))
    placed_counts = two
    if longest > 2:
        placed_counts = two.union(stored(count_phrases(texts, range(3, longest + 1), opened, known, pairs).where(F.col("n") >= least), "phrases"))
    wanted = share(Bitmap.of(_placed(placed_counts)))
    counts = placed_counts.select("hash", "n")
    found = stored(describe(texts, wanted, opened, known, pairs, longest), "found")
    return score(surviving(found, counts), counts.union(here.select("hash", "n")), here, totals)


def _placed(counts: DataFrame) -> DataFrame:
    """(hash): of each phrase at its place, as ``placed`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, place = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(placed(hashes, place).view(np.int64))], ["hash"])

    return counts.select("hash", "place").mapInArrow(run, "hash long")


def _ranked(found: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """Spells the phrases out and numbers them."""
    each = found.select("hash", F.posexplode("words").alias("i", "word_hash"))
    spelt = each.join(frequent.select(F.col("hash").alias("word_hash"), F.col("word").cast("string").alias("word")), "word_hash")
    phrases = spelt.groupBy("hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.join(phrases, "hash").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
