"""Language identification with a linear-chain conditional random field over words.

Every word gets a label; a text's language is the one with the largest summed posterior. Words are
runs of ASCII letters (lower-cased), apostrophes and characters outside ASCII. A chain is a whole line
of the text, however long, so that text in several languages is labelled word by word. A word's score for a label sums the weights of its features: the word itself (a
lexicon), its first and last 1, 2 and 3 bytes, and its byte 2- and 3-grams, all hashed into
``2**BUCKET_BITS`` weights. Transition weights are learned too; posteriors come from the
forward-backward algorithm, run over all chains of a group of texts at once. Long chains are worked on
in segments whose products of moves are multiplied out first, which gives the whole chain's posteriors
without walking it word by word.

Training maximises the conditional likelihood on a bounded sample: at most ``each`` texts of every
language, of any length, and ``most_bytes`` of text, from rows that ``may_learn`` allows, for the
``most_languages`` values of lang that most rows have. Half of the
chains it sees are spliced from lines of several languages, so that transitions are learned from
switches as well. Weights are sent to every task (their size is fixed), and all texts are labelled
whole.

A null text, or one without any letter, is ``und`` with score 0. If no row can be learned from,
every text is ``und``. Null ids stay null and are never learned from; rows that repeat are
labelled each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.samples import draw, within_bytes
from gridloom.llm.shared import plain

WORD = bt.byte_class((0x61, 0x7A), (0x27, 0x27), (0x80, 0xFF))
SEGMENT = 128
BUCKET_BITS = 18
_U = np.uint64


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x labels; row 0 stays zero and stands for an absent feature
    moves: np.ndarray  # labels x labels


@dataclass
class Features:
    fixed: np.ndarray  # words x 7
    grams: np.ndarray  # flat
    at: np.ndarray  # words + 1 offsets into grams


def _bucket(values: np.ndarray) -> np.ndarray:
    return np.maximum((bt.mix(values) >> _U(64 - BUCKET_BITS)).astype(np.int64), 1)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Features:
    """Feature buckets of words given by their spans."""
    size = ends - starts
    last = max(len(data) - 1, 0)
    fixed = np.zeros((len(starts), 7), dtype=np.int64)
    fixed[:, 0] = _bucket(hashes)
    head = np.zeros(len(starts), dtype=_U)
    tail = np.zeros(len(starts), dtype=_U)
    for k in range(1, 4):
        head = (head << _U(8)) | data[np.minimum(starts + k - 1, last)].astype(_U)
        tail = tail | (data[np.maximum(ends - k, 0)].astype(_U) << _U(8 * (k - 1)))
        long_enough = size >= k
        fixed[:, k] = np.where(long_enough, _bucket(head | _U(k << 32)), 0)
        fixed[:, 3 + k] = np.where(long_enough, _bucket(tail | _U((k + 8) << 32)), 0)
    counts = np.maximum(size - 1, 0)
    place = bt.ranges(starts, counts)
    two = (data[place].astype(_U) << _U(8)) | data[place + 1] if len(place) else np.zeros(0, _U)
    three = (two << _U(8)) | data[np.minimum(place + 2, last)] if len(place) else two
    inside = place + 2 < np.repeat(ends, counts)
    grams = np.empty(2 * len(place), dtype=np.int64)
    grams[0::2] = _bucket(two | _U(20 << 32))
    grams[1::2] = np.where(inside, _bucket(three | _U(21 << 32)), 0)
    return Features(fixed, grams, 2 * np.concatenate([[0], np.cumsum(counts)]))


def emissions(f: Features, weights: np.ndarray) -> np.ndarray:
    out = weights[f.fixed[:, 0]]
    for k in range(1, f.fixed.shape[1]):
        out = out + weights[f.fixed[:, k]]
    total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[f.grams], axis=0, dtype=np.float64)])
    return out + (total[f.at[1:]] - total[f.at[:-1]]).astype(np.float32)


def chains(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of each chain: the words of one text and line."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = line[1:] != line[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


def _active(size: np.ndarray) -> np.ndarray:
    """Of sizes that descend, how many are larger than t, for each t."""
    return np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")


def _products(local: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each segment (in descending order of size), the product of its moves and scores, up to a factor."""
    out = np.broadcast_to(np.eye(len(step), dtype=local.dtype), (len(first), *step.shape)).copy()
    for t, n in enumerate(_active(size)):
        out[:n] = (out[:n] @ step) * local[first[:n] + t][:, None, :]
        out[:n] /= out[:n].max(axis=(1, 2), keepdims=True)
    return out


def posteriors(scores: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray, want_moves: bool = False, segment: int = SEGMENT):
    """Forward-backward over all chains at once: (posterior of each word, expected moves, log likelihoods).

    Chains are cut in segments of ``segment`` words. Products of the later segments of a chain carry
    its state from segment to segment, forward and backward; within segments, all are walked at once.
    """
    cuts = (size + segment - 1) // segment
    chain = np.repeat(np.arange(len(size)), cuts)
    nth = bt.ranges(np.zeros(len(cuts), np.int64), cuts)
    first = first[chain] + segment * nth
    size = np.minimum(size[chain] - segment * nth, segment)
    order = np.argsort(-size, kind="stable")
    first, size, chain, nth = first[order], size[order], chain[order], nth[order]
    active = _active(size)
    top = scores.max(axis=1, keepdims=True)
    local = np.exp(scores - top)
    step = np.exp(moves)
    entry = np.ones((len(first), len(step)), dtype=local.dtype)  # forward state in front of a segment
    leave = np.ones_like(entry)  # backward state behind it
    begins = nth == 0
    if not begins.all():
        place = np.empty(len(first), np.int64)  # of segment nth of a chain
        place[np.concatenate([[0], np.cumsum(cuts)])[chain] + nth] = np.arange(len(first))
        at = np.cumsum(cuts) - cuts
        own = np.flatnonzero(~begins)
        product = np.empty((len(first), *step.shape), dtype=local.dtype)
        product[own] = _products(local, step, first[own], size[own])
        heads = place[at[cuts > 1]]  # of whose first words there is no move
        head = local[first[heads]]
        rest = _products(local, step, first[heads] + 1, size[heads] - 1)
        state = (head[:, None, :] @ rest)[:, 0]
        state /= state.sum(axis=1, keepdims=True)
        long = np.flatnonzero(cuts > 1)
        reached = dict(forward=state, backward=np.ones_like(state))
        for j in range(1, int(cuts.max())):
            some = np.flatnonzero(cuts[long] > j)
            here = place[at[long[some]] + j]
            entry[here] = reached["forward"][some]
            state = (reached["forward"][some][:, None, :] @ product[here])[:, 0]
            reached["forward"][some] = state / state.sum(axis=1, keepdims=True)
        for j in range(int(cuts.max()) - 1, 0, -1):
            some = np.flatnonzero(cuts[long] > j)
            here = place[at[long[some]] + j]
            state = (product[here] @ reached["backward"][some][:, :, None])[:, :, 0]
            reached["backward"][some] = leave[place[at[long[some]] + j - 1]] = state / state.sum(axis=1, keepdims=True)
    forward, scale = np.empty_like(local), np.empty(len(local), dtype=local.dtype)
    state = None
    for t, n in enumerate(active):
        here = first[:n] + t
        if t == 0:
            state = np.where(begins[:, None], local[here], (entry @ step) * local[here])
        else:
            state = (state[:n] @ step) * local[here]
        total = state.sum(axis=1)
        state = state / total[:, None]
        forward[here], scale[here] = state, total
    backward = np.ones_like(local)
    last = first + size - 1
    backward[last] = leave / (forward[last] * leave).sum(axis=1, keepdims=True)
    gained = np.zeros_like(step)
    for t in range(len(active) - 1, -1, -1):
        here = first[: active[t]] + t
        if t == 0:  # the move into a segment from the one before it
            here = here[~begins]
        later = local[here] * backward[here] / scale[here][:, None]
        if t > 0:
            backward[here - 1] = later @ step.T
        if want_moves and len(here):
            gained += step * (forward[here - 1].T @ later)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both, gained, np.log(scale) + top[:, 0]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = bt.flat(column)
    for a, b in bt.groups(offsets):
        part = bt.LOWER[data[offsets[a] : offsets[b]]]
        yield a, b, part, *bt.words(part, offsets[a : b + 1] - offsets[a], WORD)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.3, seed: int = 9) -> Model:
    """Fits the weights by mini-batches of chains with Adagrad steps."""
    languages = sorted(set(labels))
    n_labels = len(languages)
    model = Model(languages, np.zeros((1 << BUCKET_BITS, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32))
    if n_labels == 0:
        return model
    label_of = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    pieces = []  # (features of a group's words, first, size, label) of each chain
    for a, b, data, starts, ends, at in _words(pa.array(texts, pa.large_string())):
        hashes = bt.span_hashes(data, starts, ends)
        found = features(data, starts, ends, hashes)
        first, size = chains(data, starts, at)
        text = np.searchsorted(at, first, side="right") - 1
        pieces += [(found, int(s), int(n), int(label_of[a + r])) for s, n, r in zip(first, size, text, strict=True)]
    seen = np.full(model.weights.shape, 1e-3, np.float32)
    seen_moves = np.full(model.moves.shape, 1e-1, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for low in range(0, len(order), 256):
            some = [pieces[i] for i in order[low : low + 256]]
            fixed = np.concatenate([f.fixed[s : s + n] for f, s, n, _ in some])
            grams = np.concatenate([f.grams[f.at[s] : f.at[s + n]] for f, s, n, _ in some])
            counts = np.concatenate([np.diff(f.at[s : s + n + 1]) for f, s, n, _ in some])
            size = np.array([n for _, _, n, _ in some])
            gold = np.repeat([y for *_, y in some], size)
            # splice: a chain goes on in the next one with probability one half
            joins = np.concatenate([[True], rng.random(len(size) - 1) < 0.5])
            first = (np.cumsum(size) - size)[joins]
            length = np.diff(np.append(first, int(size.sum())))
            batch = Features(fixed, grams, np.concatenate([[0], np.cumsum(counts)]))
            both, gained, _ = posteriors(emissions(batch, model.weights), first, length, model.moves, want_moves=True)
            slope = -both
            slope[np.arange(len(gold)), gold] += 1
            follows = np.ones(len(gold), dtype=bool)
            follows[first] = False
            later = np.flatnonzero(follows)
            actual = np.bincount(gold[later - 1] * n_labels + gold[later], minlength=n_labels**2).reshape(n_labels, n_labels)
            flat = np.concatenate([fixed.ravel(), grams])
            source = np.concatenate([np.repeat(np.arange(len(gold)), fixed.shape[1]), np.repeat(np.arange(len(gold)), counts)])
            used, back = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(back, weights=slope[source, y], minlength=len(used)) for y in range(n_labels)], axis=1) / len(some)
            seen[used] += step**2
            model.weights[used] += (rate * step / np.sqrt(seen[used])).astype(np.float32) * 0.1
            model.weights[0] = 0
            step = (actual - gained) / len(some)
            seen_moves += step**2
            model.moves += (rate * step / np.sqrt(seen_moves)).astype(np.float32)
    return model


def label_words(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word starts, word ends, offsets, posteriors) of groups of texts."""
    for a, b, data, starts, ends, at in _words(column):
        hashes = bt.span_hashes(data, starts, ends)
        _, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        scores = emissions(features(data, starts[some], ends[some], hashes[some]), model.weights)[back]
        first, size = chains(data, starts, at)
        yield a, b, starts, ends, at, posteriors(scores, first, size, model.moves)[0]


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        names = np.array([*fitted.languages, "und"], dtype=object)
        for batch in batches:
            for a, b, _, _, at, both in label_words(batch.column(0), fitted):
                total = np.concatenate([np.zeros((1, both.shape[1])), np.cumsum(both, axis=0, dtype=np.float64)])
                share = (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)[:, None]
                rows = batch.slice(a, b - a)
                known = rows.column(1).to_numpy(zero_copy_only=False).astype(bool) & (np.diff(at) > 0)
                best = np.where(known, share.argmax(axis=1), len(fitted.languages))
                score = np.where(known, np.clip(share.max(axis=1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns[2:], pa.array(names[best], pa.string()), pa.array(score)], [*rows.schema.names[2:], "lang_pred", "score"])

    return run


def fit(docs: DataFrame, may_learn: Column, each: int = 150, most_bytes: int = 2 << 20, most_languages: int = 200, seed: int = 9) -> Model:
    """A model from at most ``each`` texts (doc_id, text, lang), of ``most_bytes`` in all, of every language."""
    rows = plain(docs, "doc_id", "text", "lang").where(may_learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    sizes = docs.sparkSession.createDataFrame(counts, "lang string, n long")
    chosen = draw(rows.join(F.broadcast(sizes), "lang").select("doc_id", "text", "lang", "n"), "n", each, seed, "doc_id", "lang")
    found = sorted(within_bytes(chosen, "lang", seed, most_bytes).collect())
    return train([r.text for r in found], [r.lang for r in found], seed=seed)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(kept columns, lang_pred, score) for each row of ``docs``; doc_id is kept if none is named."""
    kept = keep or ("doc_id",)
    if not model.languages:
        return plain(docs, *kept).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("text").alias("_text"), letters.alias("_letters"), *[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:]), "lang_pred string", "score double"])
    return rows.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), schema)
