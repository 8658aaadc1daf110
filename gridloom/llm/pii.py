"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Kinds: email, ip, card, phone. Base spans follow fixed rules and always stay:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn sum
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

each leftmost and non-overlapping within its kind; a match that fails its condition is dropped.

Further candidates come from wider patterns (numbers that fail the sum, national phone numbers,
spelt-out addresses, IPv6). On every candidate five labelers vote yes, no or abstain: pattern,
check sum or range, gazetteer, context words before it in its line, and its borders. Over the vote patterns of
all texts, expectation-maximisation estimates each labeler's reliability and how likely each
pattern is personal data. These likelihoods train a logistic classifier on the shape of the spans,
and candidates that it takes for personal data, and that touch no base span, are added.

Counts of vote and shape patterns are gathered over all texts; there are at most a few thousand
patterns, whatever the input. Spans are code points, the end exclusive. A null text has no spans.
Each input row has its row in the result, repeated rows too; null ids stay null; other columns of
the input are ignored unless asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bytetext as bt
from gridloom.llm.shared import plain

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")
ABSTAIN, NO, YES = 0, 1, 2

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NOT_LOCAL = ~bt.byte_class((48, 57), (65, 90), (97, 122), *((ord(c), ord(c)) for c in "._%+-"))
# The two patterns below start only where a run of digits starts: a match from inside a run would
# have matched from its start. With possessive repeats each is linear in the text.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

_AT_WORD = re.compile(rb"[\x20]?[\(\[](?:at|AT|At)[\)\]][\x20]?")
_AT_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:(?:\.|[\x20]?[\(\[](?:dot|DOT|Dot)[\)\]][\x20]?)[A-Za-z0-9-]++)++")
_IPV6_HINT = re.compile(rb":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")
_IPV6 = re.compile(rb"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NATIONAL = re.compile(rb"(?<![0-9+.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk nl eu us ca ch at be pl".split())
CARD_LEADS = (b"34", b"37", b"4", b"51", b"52", b"53", b"54", b"55", b"6011", b"65")
CALLING_CODES = (b"+1", b"+20", b"+27", b"+30", b"+31", b"+32", b"+33", b"+34", b"+39", b"+41", b"+43", b"+44", b"+45", b"+46", b"+47", b"+48", b"+49", b"+52", b"+55", b"+61", b"+81", b"+86", b"+91")
CONTEXT = {
    "email": re.compile(rb"e-?mail|correo|courriel|contact|kontakt", re.I),
    "ip": re.compile(rb"\bip\b|host|server|addr|adress", re.I),
    "card": re.compile(rb"card|visa|credit|carte|karte|tarjeta|account|konto", re.I),
    "phone": re.compile(rb"phone|\btel|call|fax|mobil|handy|appel|llam", re.I),
}


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(x: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", x)


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: int  # base 3, one digit for each labeler
    shape: int


def base_spans(text: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, kept) of every match of the base patterns; kept: its condition holds."""
    if b"@" in text:
        outside = np.flatnonzero(_NOT_LOCAL[np.frombuffer(text, np.uint8)])
        done, at = 0, text.find(b"@")
        while at >= 0:
            i = int(np.searchsorted(outside, at))
            start = max(done, int(outside[i - 1]) + 1 if i else 0)
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                yield 0, start, m.end(), True
                done = m.end()
            at = text.find(b"@", at + 1)
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in m[0].split(b"."))
    for m in _DIGITS.finditer(text):
        digits = _only_digits(m[0])
        yield 2, m.start(), m.end(), 13 <= len(digits) <= 19 and _luhn(digits)
    if b"+" in text:
        for m in _PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= len(_only_digits(m[0])) <= 15


def _wider(text: bytes) -> Iterator[tuple[int, int, int]]:
    if b"at)" in text.lower() or b"at]" in text.lower():
        outside = np.flatnonzero(_NOT_LOCAL[np.frombuffer(text, np.uint8)])
        for m in _AT_WORD.finditer(text):
            i = int(np.searchsorted(outside, m.start()))
            start = int(outside[i - 1]) + 1 if i else 0
            after = _AT_DOMAIN.match(text, m.end())
            if start < m.start() and after:
                yield 0, start, after.end()
    if _IPV6_HINT.search(text):
        for m in _IPV6.finditer(text):
            yield 1, m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        yield 3, m.start(), m.end()


def _judge(text: bytes, kind: int, start: int, end: int, base: bool, wider: bool = False) -> Candidate:
    """The labelers' votes on a span and its shape."""
    span = text[start:end]
    digits = _only_digits(span)
    if kind == 0:
        checks = YES if re.fullmatch(rb"[A-Za-z]{2,24}", re.split(rb"[.\x20)\]]+", span)[-1]) else NO
        known = span.lower().rsplit(b".", 1)[-1].decode("ascii") in TOP_DOMAINS
    elif kind == 1:
        checks = YES if b":" in span or base else NO
        known = span.split(b".")[0] in (b"10", b"127", b"172", b"192")
    elif kind == 2:
        checks = YES if 13 <= len(digits) <= 19 and _luhn(digits) else NO
        known = digits.startswith(CARD_LEADS)
    else:
        checks = YES if 9 <= len(digits) <= 15 else NO
        known = span.startswith(CALLING_CODES)
    glued_left = start > 0 and text[start - 1 : start].isalnum()
    glued_right = text[end : end + 1].isalnum()
    before = text[max(0, start - 40) : start].rpartition(b"\n")[2]
    votes = [
        YES if base else ABSTAIN if wider else NO,
        checks,
        YES if known else ABSTAIN,
        YES if CONTEXT[KINDS[kind]].search(before) else ABSTAIN,
        NO if glued_left or glued_right else ABSTAIN,
    ]
    separators = sum(bit << i for i, bit in enumerate((b" " in span, b"-" in span, b"." in span)))
    shape = kind | separators << 2 | min(len(digits), 31) << 5 | (b"(" in span) << 10 | span.startswith(b"+") << 11 | glued_left << 12 | glued_right << 13 | (checks == YES) << 14
    return Candidate(kind, start, end, base, sum(v * 3**i for i, v in enumerate(votes)), shape)


def candidates(text: bytes) -> list[Candidate]:
    """All candidates of a text, or of several with bytes outside every pattern between them."""
    found = []
    for kind, start, end, kept in base_spans(text):
        if kept or kind != 2 or 13 <= sum(48 <= c <= 57 for c in text[start:end]) <= 19:
            found.append(_judge(text, kind, start, end, kept))
    found += [_judge(text, kind, start, end, False, wider=True) for kind, start, end in _wider(text)]
    return found


def _scan(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[Candidate]]]:
    """(first row, end row, buffer, start of each text in it, candidates with places in it) of groups of texts."""
    data, offsets = bt.flat(column)
    for a, b in bt.groups(offsets):
        at = offsets[a : b + 1] - offsets[a]
        gap = np.arange(b - a)
        buffer = np.full(int(at[-1]) + b - a, 10, dtype=np.uint8)  # a line feed behind each text
        own = np.ones(len(buffer), dtype=bool)
        own[at[1:] + gap] = False
        buffer[own] = data[offsets[a] : offsets[b]]
        first = at[:-1] + gap
        yield a, b, buffer, first, candidates(buffer.tobytes())


@dataclass
class Model:
    """Reliability of each labeler, and the classifier's answer for each shape."""

    reliability: dict[str, tuple[float, float]]  # share of yes among its votes on personal data, on other spans
    weights: np.ndarray
    threshold: float

    def accepts(self, shape: int) -> bool:
        return bool(1 / (1 + np.exp(-_inputs(np.array([shape])) @ self.weights))[0] >= self.threshold)


def _inputs(shapes: np.ndarray) -> np.ndarray:
    """One-hot inputs of the classifier: kind, separators by kind, digits by kind, flags, constant."""
    kind, separators, digits = shapes & 3, (shapes >> 2) & 7, (shapes >> 5) & 31
    parts = [np.eye(4)[kind], np.eye(32)[kind * 8 + separators], np.eye(128)[kind * 32 + digits]]
    flags = (shapes[:, None] >> np.arange(10, 15)) & 1
    return np.concatenate([*parts, flags, np.ones((len(shapes), 1))], axis=1)


def _estimate(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns with counts: (likelihood of each pattern, vote shares).

    Labelers are taken as independent given the truth; shares[y, j, v] is how often labeler j votes v
    on spans whose truth is y. A prior of a few votes keeps shares off zero and says that yes
    speaks for personal data.
    """
    v = (votes[:, None] // 3 ** np.arange(len(LABELERS))) % 3
    prior = np.array([[2.0, 2.0, 1.0], [2.0, 1.0, 2.0]])
    shares = np.broadcast_to(np.array([[0.4, 0.45, 0.15], [0.4, 0.15, 0.45]])[:, None, :], (2, len(LABELERS), 3)).copy()
    rate = np.full(4, 0.5)
    likely = np.full(len(n), 0.5)
    for _ in range(rounds):
        logs = np.log(shares[:, np.arange(len(LABELERS)), v]).sum(axis=2)
        odds = logs[1] - logs[0] + np.log(rate[kinds]) - np.log(1 - rate[kinds])
        likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for y, w in ((1, likely * n), (0, (1 - likely) * n)):
            for j in range(len(LABELERS)):
                held = np.bincount(v[:, j], weights=w, minlength=3) + prior[y]
                shares[y, j] = held / held.sum()
        for k in range(4):
            rate[k] = ((likely * n)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2)
    return likely, shares


def fit_patterns(shapes: np.ndarray, votes: np.ndarray, n: np.ndarray, threshold: float = 0.5) -> Model:
    likely, shares = _estimate(shapes & 3, votes, n.astype(float))
    x = _inputs(shapes)
    weights = np.zeros(x.shape[1])
    size = np.log1p(n)  # common patterns count more, without drowning the others
    for step in range(400):
        p = 1 / (1 + np.exp(-x @ weights))
        weights += (2.0 / (1 + step / 100)) * ((x.T @ (size * (likely - p))) / max(size.sum(), 1.0) - 1e-4 * weights)
    trust = {name: (float(shares[1, j, YES] / (shares[1, j, YES] + shares[1, j, NO])), float(shares[0, j, YES] / (shares[0, j, YES] + shares[0, j, NO]))) for j, name in enumerate(LABELERS)}
    return Model(trust, weights, threshold)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[int, int], int] = {}
        for *_, found in _scan(batch.column(0)):
            for c in found:
                seen[c.shape, c.votes] = seen.get((c.shape, c.votes), 0) + 1
        if seen:
            shapes, votes = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.int32()), pa.array(votes, pa.int32()), pa.array(seen.values(), pa.int64())], ["shape", "votes", "n"])


def fit(docs: DataFrame) -> Model:
    """Estimates the labelers' reliabilities and trains the span classifier on all candidates of all texts."""
    counts = plain(docs, "text").mapInArrow(_patterns, "shape int, votes int, n long").groupBy("shape", "votes").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect())  # bounded: shapes times vote patterns
    shapes, votes, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    return fit_patterns(shapes, votes, n)


def _spans(found: list[Candidate], accept: dict[int, bool], model: Model) -> list[Candidate]:
    base = [c for c in found if c.base]
    starts = sorted((c.start, c.end) for c in base)
    begin = np.array([s for s, _ in starts])
    reach = np.maximum.accumulate(np.array([e for _, e in starts])) if starts else begin
    kept = list(base)
    done: dict[int, int] = {}
    for c in sorted((c for c in found if not c.base), key=lambda c: (c.start, -c.end)):
        if c.shape not in accept:
            accept[c.shape] = model.accepts(c.shape)
        i = int(np.searchsorted(begin, c.end))
        if accept[c.shape] and not (i and reach[i - 1] > c.start) and done.get(c.kind, 0) <= c.start:
            kept.append(c)
            done[c.kind] = c.end
    return sorted(kept, key=lambda c: (c.kind, c.start))


def _detect(model, redact: bool):
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, accept = model.value, {}
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            changed: dict[int, str] = {}
            for a, _, buffer, first, found in _scan(batch.column(1)):
                if not found:
                    continue
                later = np.concatenate([[0], np.cumsum((buffer & 0xC0) == 0x80)])  # continuation bytes before each place
                kept = _spans(found, accept, fitted)
                rows = np.searchsorted(first, [c.start for c in kept], side="right") - 1
                cuts: dict[int, list] = {}
                for row, c in zip(rows.tolist(), kept, strict=True):
                    low = int(first[row])
                    points = [int(x - low - (later[x] - later[low])) for x in (c.start, c.end)]
                    spans[a + row].append({"kind": KINDS[c.kind], "start": points[0], "end": points[1], "base": c.base})
                    cuts.setdefault(row, []).append((c.start, c.end, c.kind))
                if redact:
                    whole = buffer.tobytes()
                    for row, cut in cuts.items():
                        at, out = int(first[row]), []
                        for s, e, kind in sorted(cut):
                            if s >= at:
                                out += [whole[at:s], b"[" + KINDS[kind].upper().encode() + b"]"]
                            at = max(at, e)
                        stop = int(first[row + 1]) - 1 if row + 1 < len(first) else len(whole) - 1
                        changed[a + row] = b"".join([*out, whole[at:stop]]).decode()
            text = batch.column(1)
            if changed:
                values = text.to_pylist()
                for i, x in changed.items():
                    values[i] = x
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *batch.columns[2:], pa.array(spans, span_type)] if redact else [batch.column(0), *batch.columns[2:], pa.array(spans, span_type)], names=["doc_id", *(["text"] if redact else []), *batch.schema.names[2:], "spans"])

    return run


SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect(docs: DataFrame, model: Model, *keep: str, redact: bool = False) -> DataFrame:
    """(doc_id, kept columns, spans) for each row of ``docs`` (doc_id, text).

    ``redact``: also the text, in which ``[KIND]`` stands for each span (overlapping ones as one).
    """
    rows = plain(docs, "doc_id", "text", *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if redact or f.name != "text"), SPANS])
    return rows.mapInArrow(_detect(docs.sparkSession.sparkContext.broadcast(model), redact), schema)
