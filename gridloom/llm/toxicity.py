"""Toxicity by non-negative positive-unlabelled learning.

A text is the set of its words (runs of ASCII letters, lower-cased, digits and characters outside
ASCII) and of their first 4, 5 and 6 bytes, hashed into ``2**BUCKET_BITS`` weights; a linear numpy
classifier sums them. It is trained
from confirmed toxic texts (P) and from texts whose labels are not looked at (U), with the
class-prior-corrected risk

    prior * mean_P(loss as positive) + max(0, mean_U(loss as negative) - prior * mean_P(loss as negative)),

whose second part, the risk on negatives, is kept from going below zero: while a mini-batch has it
below, steps only undo that. The prior is the toxic share of the labels that may be learned from,
counted over all of them.

Words speak for toxicity or not at all: weights are never negative. Only features have weights that
``least_texts`` texts of the sample or more have, and toxic ones so much oftener than unlabelled ones
that chance would not do it (``least_deviations`` of their difference); so the classifier cannot learn
single texts by heart. The first epochs shrink weights towards zero (``sparsity``), later ones not. Last, the constant is set where the same
corrected risk, of decisions instead of losses, is least on the sample. The sample is bounded: at most
``each_toxic`` toxic and ``each_other`` unlabelled texts, of any length, and ``most_bytes`` of either. Weights, of fixed size, go to
every task and each text is scored whole. A null text is scored as an empty one; null ids are never
learned from; repeated rows are scored each; without any toxic text every score is 0. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.samples import draw, texts_of, within_bytes
from gridloom.llm.shared import plain

WORD = bt.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
BUCKET_BITS = 20
HEADS = (4, 5, 6)  # bytes


@dataclass
class Classifier:
    weights: np.ndarray  # one for each bucket
    bias: float
    prior: float


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature buckets of all words, one row for each kind of feature; word offsets of the texts)."""
    part = bt.LOWER[data]
    starts, ends, at = bt.words(part, offsets, WORD)
    kinds = [bt.span_hashes(part, starts, ends)]
    head = np.zeros(len(starts), np.uint64)
    last = max(len(part) - 1, 0)
    for k in range(1, max(HEADS) + 1):
        head = (head << np.uint64(8)) | part[np.minimum(starts + k - 1, last)]
        if k in HEADS:
            kinds.append(np.where(ends - starts > k, bt.mix(head + np.uint64(k)), np.uint64(0)))
    return (np.stack(kinds) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), at


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows): the distinct feature buckets of each text, without bucket 0."""
    found = [(np.zeros(0, np.int32),) * 2]
    for a, b in bt.groups(offsets):
        buckets, at = _buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rows = np.repeat(np.arange(b - a), np.diff(at))
        pairs = np.unique((rows << BUCKET_BITS | buckets)[buckets > 0])
        found.append(((pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32), (a + (pairs >> BUCKET_BITS)).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scores(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if model.prior == 0:
        return np.zeros(n)
    buckets, at = _buckets(data, offsets)
    kind, word = np.nonzero(model.weights[buckets])  # features that have a weight: few
    rows = np.searchsorted(at, word, side="right") - 1
    pairs = np.unique(rows << BUCKET_BITS | buckets[kind, word])
    total = np.bincount(pairs >> BUCKET_BITS, weights=model.weights[pairs & ((1 << BUCKET_BITS) - 1)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def train(toxic: list[str], other: list[str], prior: float, least_texts: int = 8, least_deviations: float = 4.0, epochs: int = 60, more_epochs: int = 120, rate: float = 0.2, sparsity: float = 1e-4, batch: int = 4000, seed: int = 3) -> Classifier:
    """Non-negative risk, by Adagrad steps on mini-batches of both samples."""
    weights = np.zeros(1 << BUCKET_BITS)
    if not toxic or not other or prior <= 0:
        return Classifier(weights, 0.0, 0.0 if not toxic else 1.0)
    data, offsets = bt.flat(pa.array(toxic + other, pa.large_string()))
    bucket, row = word_sets(data, offsets)
    texts = np.bincount(bucket, minlength=len(weights))
    in_toxic = np.bincount(bucket[row < len(toxic)], minlength=len(weights))
    share = texts / (len(toxic) + len(other))
    gap = in_toxic / len(toxic) - (texts - in_toxic) / len(other)
    often = (texts >= least_texts) & (gap > least_deviations * np.sqrt(share * (1 - share) * (1 / len(toxic) + 1 / len(other))))
    used = np.flatnonzero(often)
    kept = often[bucket]
    column, row = (np.cumsum(often) - 1)[bucket[kept]], row[kept]
    at = np.searchsorted(row, np.arange(len(toxic) + len(other) + 1))
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    seen, seen_bias = np.full(len(used), 1e-4), 1e-2
    parts = max(1, len(other) // batch)
    for epoch in range(epochs + more_epochs):
        if epoch == epochs:
            sparsity, seen = 0.0, np.full(len(used), 1e-2)
        p_order, u_order = np.array_split(rng.permutation(len(toxic)), parts), np.array_split(len(toxic) + rng.permutation(len(other)), parts)
        for p_rows, u_rows in zip(p_order, u_order, strict=True):
            if not len(p_rows):
                p_rows = rng.integers(0, len(toxic), 8)
            rows = np.concatenate([p_rows, u_rows])
            size = at[rows + 1] - at[rows]
            columns = column[bt.ranges(at[rows], size)]
            of = np.repeat(np.arange(len(rows)), size)
            z = np.bincount(of, weights=w[columns], minlength=len(rows)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            n_p, n_u = len(p_rows), len(u_rows)
            as_negative = np.logaddexp(0, z)  # the loss of calling it negative
            risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
            slope = np.zeros(len(rows))
            if risk >= 0:
                slope[:n_p] = prior * (p[:n_p] - 1) / n_p - prior * p[:n_p] / n_p
                slope[n_p:] = p[n_p:] / n_u
            else:
                slope[:n_p] = prior * p[:n_p] / n_p
                slope[n_p:] = -p[n_p:] / n_u
            g = np.bincount(columns, weights=slope[of], minlength=len(used))
            seen += g * g
            step = rate / np.sqrt(seen)
            w -= step * g
            w = np.maximum(w - step * sparsity, 0)
            seen_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / seen_bias**0.5
    weights[used] = w
    z = np.bincount(row, weights=w[column], minlength=len(toxic) + len(other))
    return Classifier(weights, -_boundary(z[: len(toxic)], z[len(toxic) :], prior), prior)


def _boundary(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """Where to cut sums of weights: the least non-negative corrected risk of the decisions themselves.

    Of cuts with the least risk, the highest; halfway down to the next sum below.
    """
    every = np.unique(np.concatenate([p, u]))
    cuts = np.concatenate([every[:1] - 1, (every[1:] + every[:-1]) / 2, every[-1:] + 1])
    caught = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    called = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    risk = prior * (1 - caught) + np.maximum(called - prior * caught, 0)
    return float(cuts[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", each_toxic: int = 1200, each_other: int = 3600, most_bytes: int = 32 << 20, seed: int = 3) -> Classifier:
    """``may_learn`` (on doc_id) limits both the labels and the unlabelled texts that are used.

    An id that has both labels counts as toxic.
    """
    rows = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & may_learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts.get(1):
        return train([], [], 0.0)
    prior = counts[1] / sum(counts.values())
    texts = docs.select("doc_id", "text").where(may_learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    confirmed = texts_of(texts, draw(rows.where("y = 1"), counts[1], each_toxic, seed, "doc_id"), "y")
    unlabelled = draw(texts.withColumn("y", F.lit(0)), docs.where(may_learn).count(), each_other, seed + 1, "doc_id")
    toxic, other = (sorted(r.text for r in within_bytes(some, "y", seed, most_bytes).collect()) for some in (confirmed, unlabelled))
    return train(toxic, other, prior, seed=seed)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.flat(batch.column(1))
            found = [scores(model.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in bt.groups(offsets)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""
    rows = plain(docs, "doc_id", "text")
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
