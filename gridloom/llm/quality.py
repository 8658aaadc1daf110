"""Quality classifier: a byte-level convolutional network in numpy.

A byte is embedded in ``EMBED`` numbers; learned filters span 8 bytes and move by 4. Their outputs
are max-pooled over chunks of 512 bytes that overlap by half and cover the whole text. A document
is the mean, the maximum and the minimum of its chunks' pooled outputs (the minimum tells chunks
that repeat a few patterns), with how far the text fills a chunk; a logistic unit combines them into
one probability. Filters are applied once: a chunk is the maximum of two neighbouring blocks of 256.

The network is trained by back-propagation on a bounded sample: at most ``each`` labelled texts of
either label, of any length, whose rows ``may_learn`` allows, and ``most_bytes`` of text. Its weights,
of fixed size, are sent to every task, and each text is scored whole, in memory that its own bytes
bound. A null text is scored as an empty one. Null ids stay null and are never learned from; rows
that repeat are scored each; without rows of both labels every score is the share of label 1 (one
half without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from gridloom.llm import bytetext as bt
from gridloom.llm.samples import labelled
from gridloom.llm.shared import plain

EMBED, STEP, FILTERS = 4, 4, 32
BLOCK = 256
_PLACES = BLOCK // STEP
_ROWS = 2048  # blocks convolved at a time


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # 2 * STEP * EMBED x FILTERS
    shift: np.ndarray  # FILTERS
    combine: np.ndarray  # 3 * FILTERS + 2
    bias: np.ndarray  # 1
    prior: float | None = None  # the answer where nothing could be learned

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.combine, self.bias]


def start(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    width = 2 * STEP * EMBED
    return Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, (2 / width) ** 0.5, (width, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, 3 * FILTERS + 2).astype(np.float32),
        np.zeros(1, np.float32),
    )


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in whole blocks, first block of each text + total, last block flags); zeros fill up a text."""
    size = np.diff(offsets)
    count = (size + STEP + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(count)])
    padded = np.zeros(int(first[-1]) * BLOCK, dtype=np.uint8)
    padded[bt.ranges(first[:-1] * BLOCK, size)] = data
    last = np.zeros(int(first[-1]), dtype=bool)
    last[first[1:] - 1] = True
    return padded, first, last


def _windows(net: Network, padded: np.ndarray, last: np.ndarray, low: int, high: int) -> np.ndarray:
    """Embedded windows of blocks low .. high - 1: a row of 8 bytes for each place."""
    stop = min(high * BLOCK + STEP, len(padded))
    halves = net.embed[padded[low * BLOCK : stop]].reshape(-1, STEP * EMBED)
    n = (high - low) * _PLACES
    out = np.zeros((n, 2 * STEP * EMBED), dtype=np.float32)
    out[:, : STEP * EMBED] = halves[:n]
    rest = halves[1 : n + 1]
    out[: len(rest), STEP * EMBED :] = rest
    out[(np.flatnonzero(last[low:high]) + 1) * _PLACES - 1, STEP * EMBED :] = 0  # the next text is not seen
    return out


def _pooled(net: Network, padded: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty((len(last), FILTERS), dtype=np.float32)
    for low in range(0, len(last), _ROWS):
        high = min(low + _ROWS, len(last))
        np.max((_windows(net, padded, last, low, high) @ net.filters).reshape(high - low, _PLACES, FILTERS), axis=1, out=out[low:high])
    return out


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each chunk, chunks before each text + total): a chunk is a block and the next one."""
    count = np.maximum(np.diff(first) - 1, 1)
    return bt.ranges(first[:-1], count), np.concatenate([[0], np.cumsum(count)])


def _document(net: Network, pooled: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents' features, chunks' features, block of each chunk feature's maximum)."""
    begin, at = _chunks(first)
    second = np.minimum(begin + 1, np.repeat(first[1:] - 1, np.diff(at)))
    later = pooled[second] > pooled[begin]
    chunk = np.maximum(np.where(later, pooled[second], pooled[begin]) + net.shift, 0)
    mean = np.add.reduceat(chunk, at[:-1], axis=0) / np.diff(at)[:, None]
    most = np.maximum.reduceat(chunk, at[:-1], axis=0)
    least = np.minimum.reduceat(chunk, at[:-1], axis=0)
    fill = np.stack([np.minimum(size, 2 * BLOCK) / (2 * BLOCK), np.minimum(size, BLOCK // 4) / (BLOCK // 4)], axis=1).astype(chunk.dtype)
    return np.concatenate([mean, most, least, fill], axis=1), chunk, np.where(later, second[:, None], begin[:, None])


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text."""
    if net.prior is not None:
        return np.full(len(offsets) - 1, net.prior)
    padded, first, last = _blocks(data, offsets)
    features, _, _ = _document(net, _pooled(net, padded, last), first, np.diff(offsets))
    return 1 / (1 + np.exp(-np.clip((features @ net.combine + net.bias).astype(np.float64), -30, 30)))


def _slopes(net: Network, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss."""
    padded, first, last = _blocks(data, offsets)
    windows = _windows(net, padded, last, 0, len(last))
    outputs = (windows @ net.filters).reshape(len(last), _PLACES, FILTERS)
    place = outputs.argmax(axis=1)
    pooled = np.take_along_axis(outputs, place[:, None, :], axis=1)[:, 0]
    features, chunk, block = _document(net, pooled, first, np.diff(offsets))
    p = 1 / (1 + np.exp(-np.clip(features @ net.combine + net.bias, -30, 30)))
    error = ((p - y) * weight / weight.sum()).astype(np.float32)
    d_features = error[:, None] * net.combine
    _, at = _chunks(first)
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    d_chunk = (d_features[:, :FILTERS] / count[:, None])[text]
    for low in (FILTERS, 2 * FILTERS):  # a maximum or minimum passes its slope to the chunks that have it
        part = slice(low, low + FILTERS)
        there = chunk == features[text, part]
        d_chunk += d_features[text, part] * there / np.maximum(np.add.reduceat(there, at[:-1], axis=0, dtype=np.int64)[text], 1)
    d_chunk *= chunk > 0
    rows = block * _PLACES + np.take_along_axis(place, block, axis=0)  # window of each chunk feature
    d_filters = np.empty_like(net.filters)
    d_bytes = np.zeros((256, EMBED))
    for f in range(FILTERS):
        g, row = d_chunk[:, f], rows[:, f]
        some = g != 0
        g, row = g[some], row[some]
        d_filters[:, f] = windows[row].T @ g
        bytes_at = np.minimum(row[:, None] * STEP + np.arange(2 * STEP), len(padded) - 1)
        held = g[:, None] * np.ones(2 * STEP, np.float32)
        held[:, STEP:][last[row // _PLACES] & (row % _PLACES == _PLACES - 1)] = 0
        for e in range(EMBED):
            d_bytes[:, e] += np.bincount(padded[bytes_at].ravel(), weights=(held * net.filters[e::EMBED, f]).ravel(), minlength=256)
    return [d_bytes.astype(np.float32), d_filters, d_chunk.sum(axis=0), (error @ features).astype(np.float32), np.array([error.sum()], np.float32)]


def train(texts: list[str], y: list[int], epochs: int = 14, rate: float = 0.015, batch: int = 48, seed: int = 2) -> Network:
    """Adam steps on mini-batches; either label weighs the same."""
    net = start(seed)
    target = np.array(y, dtype=np.float32)
    if len(set(y)) < 2:
        net.prior = float(target.mean()) if len(target) else 0.5
        return net
    data, offsets = bt.flat(pa.array(texts, pa.large_string()))
    weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    means = [np.zeros_like(p) for p in net.parameters()]
    squares = [np.zeros_like(p) for p in net.parameters()]
    steps, total = 0, epochs * -(-len(target) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            size = np.diff(offsets)[some]
            part = data[bt.ranges(offsets[some], size)]
            slopes = _slopes(net, part, np.concatenate([[0], np.cumsum(size)]), target[some], weight[some])
            steps += 1
            for p, g, m, s in zip(net.parameters(), slopes, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (1 - steps / (total + 1)) * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", each: int = 1000, most_bytes: int = 16 << 20, seed: int = 2) -> Network:
    rows = labelled(docs, labels, label, may_learn, each, most_bytes, seed)
    return train([r.text for r in rows], [r.y for r in rows], seed=seed)


def _score(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.flat(batch.column(1))
            found = [scores(net.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in bt.groups(offsets)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text)."""
    rows = plain(docs, "doc_id", "text")
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
