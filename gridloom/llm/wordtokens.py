"""Token ids of whole texts, each distinct word encoded once.

Texts are cut where the tokenizer never joins anything, so that the ids of a text are those of its
pieces in order. Pieces repeat a lot; each worker process keeps the ids of those it has met, and
hands only new ones to the tokenizers library. ``mode`` says where the cuts are:

* ``"words"``: tokenizers that drop white space. Pieces are runs without ASCII white space.
* ``"spaces"``: byte-level tokenizers whose rule takes one space in front of a word. A cut is
  in front of a single space or line feed with no white space on either side.

Both also cut between a letter and a mark that follows it.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from gridloom.llm import bytetext as bt

_BLANK = bt.byte_class((0x20, 0x20), (0x09, 0x0D))
_LETTER = bt.byte_class((0x41, 0x5A), (0x61, 0x7A))
_MARK = bt.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Lead bytes of the characters outside ASCII that are white space.
_MAYBE_BLANK = bt.byte_class((0xC2, 0xC2), (0xE1, 0xE3))
_SLOT_BITS = 21
_MOST_PIECES = 1_000_000
_AT_ONCE = 4096
_KEPT: dict[tuple[str, str], WordTokens] = {}


class WordTokens:
    """Ids of pieces by their hash, for one tokenizer file; memory is bounded."""

    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mode = mode
        self._forget()

    @classmethod
    def of(cls, path: str, mode: str) -> WordTokens:
        if (path, mode) not in _KEPT:
            _KEPT[path, mode] = cls(path, mode)
        return _KEPT[path, mode]

    def _forget(self) -> None:
        self.slot_hash = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slot_piece = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n, self.used = 0, 0

    def _cuts(self, data: np.ndarray, special: bool) -> np.ndarray:
        """Places between a letter and a mark behind it, where no rule joins the two.

        Not in a group of texts that holds the start of a special token's string.
        """
        cut = np.zeros(len(data), dtype=bool)
        if not special and len(data) > 2:
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin letters of two bytes
            cut[1:] = letter[:-1] & _MARK[data[1:]]
        return cut

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        blank = _BLANK[data]
        if self.mode == "words":
            start = self._cuts(data, special) | first[:-1]
            start[1:] |= blank[:-1]
            start &= ~blank
            starts = np.flatnonzero(start)
            stop = blank | start | first[:-1]  # a piece ends in front of these
            stops = np.append(np.flatnonzero(stop), n)
            ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
            return starts, ends, np.searchsorted(starts, offsets)
        cut = (data == 0x20) | (data == 0x0A)
        cut[:1] = cut[-1:] = False
        if n > 2:
            cut[1:-1] &= ~blank[:-2] & ~blank[2:] & ~_MAYBE_BLANK[data[2:]] & ~first[2:-1]
            cut[2:] &= ~((data[1:-1] >= 0x80) & _MAYBE_BLANK[data[:-2]])
            cut[3:] &= ~((data[2:-1] >= 0x80) & _MAYBE_BLANK[data[:-3]])
        starts = np.flatnonzero(cut | self._cuts(data, special) | first[:-1])
        return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encodes distinct pieces; returns their numbers."""
        whole = data.tobytes()
        texts = [whole[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = []
        for low in range(0, len(texts), _AT_ONCE):  # an encoding takes far more memory than its ids
            found += [x.ids for x in self.tokenizer.encode_batch_fast(texts[low : low + _AT_ONCE], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        if self.n + len(size) > len(self.first):
            more = max(len(self.first), len(size))
            self.first = np.concatenate([self.first, np.zeros(more, np.int64)])
            self.size = np.concatenate([self.size, np.zeros(more, np.int32)])
        numbers = np.arange(self.n, self.n + len(size))
        self.first[numbers] = self.used + np.cumsum(size) - size
        self.size[numbers] = size
        slots = hashes >> np.uint64(64 - _SLOT_BITS)
        slots = np.where(self.slot_piece[slots] < 0, slots, hashes & np.uint64((1 << _SLOT_BITS) - 1))
        self.slot_hash[slots], self.slot_piece[slots] = hashes, numbers
        self.used, self.n = self.used + len(new), self.n + len(size)
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end_id; n + 1 offsets into them)."""
        if self.n > _MOST_PIECES:
            self._forget()
        special = bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())  # <|
        if self.mode == "words" and not special:
            data = bt.LOWER[data]  # as the tokenizer does itself
        starts, ends, at = self._pieces(data, offsets, special)
        hashes = bt.span_hashes(data, starts, ends)
        if special:  # such groups are cut in another way
            hashes = bt.mix(hashes + np.uint64(1))
        slots, others = hashes >> np.uint64(64 - _SLOT_BITS), hashes & np.uint64((1 << _SLOT_BITS) - 1)
        piece = np.where(self.slot_hash[slots] == hashes, self.slot_piece[slots], np.where(self.slot_hash[others] == hashes, self.slot_piece[others], -1)).astype(np.int64)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            some, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            piece[missing] = self._learn(data, starts[first], ends[first], some)[back]
        size = self.size[piece].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids_at = total[at] + np.arange(len(at))
        out = np.full(int(ids_at[-1]), end_id, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[ids_at[1:] - 1] = False
        out[inside] = self.ids[bt.ranges(self.first[piece], size)]
        return out, ids_at


def encode_groups(column: pa.Array, path: str, mode: str, end_id: int):
    """(first row, end row, ids, offsets) of groups of texts; a null text has no ids but end_id."""
    tokens = WordTokens.of(path, mode)
    data, offsets = bt.flat(column)
    for a, b in bt.groups(offsets):
        yield a, b, *tokens.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
