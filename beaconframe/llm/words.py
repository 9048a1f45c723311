"""Words of many texts at once, as 64-bit ids, in numpy.

A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D.  Each
text opens with a START token, which is context only, and closes with an END
token.  A text of more than ``limit`` bytes is cut at separators into parts; a
part's opening token is then the last word of the part before, so neighbours are
the same as in the whole text, and memory is bounded unless one word is longer.

An id is a polynomial of the word's bytes modulo 2**64, mixed with its length;
equal words have equal ids, and different ones share an id about once in 2**64
pairs, in which case they count as one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import SLICE_CHARS, SPACES

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit integers for each salt, all bits of which depend on all bits."""
    x = x + np.uint64(salt * _GOLD & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64), 1)
_SEPARATOR = np.isin(np.arange(256), list(SPACES.encode()))
START, END = mixed(np.array([1, 2], np.uint64), 77)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16) - 1, base, np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def word_ids(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ids of the words that lie end to end in ``data``."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    value = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    return mixed(value ^ (np.diff(offsets).astype(np.uint64) << np.uint64(40)), 2)


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words end to end, their offsets, and where in ``text`` each begins."""
    seen = np.frombuffer(text + b"\n", np.uint8)
    blank = _SEPARATOR[seen]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edge[::2] if blank[0] else np.r_[0, edge[1::2]]
    ends = edge[1::2] if blank[0] else edge[::2]
    return seen[~blank], np.r_[0, np.cumsum(ends - starts)], starts


@dataclass
class Run:
    """Tokens of some texts, or of one part of a long one."""

    ids: np.ndarray  #: of all tokens, opening ones included
    opens: np.ndarray  #: where each part's opening token is
    docs: np.ndarray  #: which text each part belongs to
    word_at: np.ndarray  #: where the words are among the tokens
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> pa.BinaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.word_at), [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.data)])

    def inner(self) -> np.ndarray:
        """Which tokens are not opening ones."""
        out = np.ones(len(self.ids), bool)
        out[self.opens] = False
        return out


def _run(parts: list[tuple[int, bytes, np.uint64, bool]]) -> Run:
    data, offsets, starts = split_words(b"\n".join(p[1] for p in parts))
    bounds = np.cumsum([len(p[1]) + 1 for p in parts])
    upto = np.searchsorted(starts, bounds)
    n = np.diff(upto, prepend=0)
    sizes = 1 + n + np.array([p[3] for p in parts])
    opens = np.cumsum(sizes) - sizes
    word_at = np.arange(len(starts)) + np.repeat(opens + 1 - (upto - n), n)
    ids = np.full(int(sizes.sum()), END, np.uint64)
    ids[opens] = [p[2] for p in parts]
    ids[word_at] = word_ids(data, offsets)
    return Run(ids, opens, np.array([p[0] for p in parts]), word_at, data, offsets)


def _pieces(text: bytes, limit: int) -> Iterator[tuple[bytes, bool]]:
    """The text cut after separators into pieces of ``limit`` bytes, more only where a word is longer; and whether each is the last."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(c, at, at + limit) for c in SPACES.encode())
        if end < 0:
            later = [p for c in SPACES.encode() if (p := text.find(c, at + limit)) >= 0]
            if not later:
                break
            end = min(later)
        yield text[at : end + 1], False
        at = end + 1
    yield text[at:], True


def runs(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[Run]:
    held: list[tuple[int, bytes, np.uint64, bool]] = []
    size = 0
    for doc, text in enumerate(texts):
        low = text.encode().lower()
        if held and size + len(low) > limit:
            yield _run(held)
            held, size = [], 0
        if len(low) <= limit:
            held.append((doc, low, START, True))
            size += len(low)
            continue
        before = START
        for piece, last in _pieces(low, limit):
            run = _run([(doc, piece, before, last)])
            before = run.ids[-1]
            yield run
    if held:
        yield _run(held)


def joined_by_cuts(words: pa.BinaryArray, cuts: np.ndarray) -> pa.BinaryArray:
    """For each span between two cuts: its words, joined by line feeds."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), b"\n")
