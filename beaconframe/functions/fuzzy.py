"""Finding the words of a list among the tokens of many texts at once, with a bounded number of edits.

A token is a run of A-Z or of digits; up to three neighbouring tokens of letters
may be read as one word.  All tokens of an Arrow batch are handled together in
numpy.  The list is a segment index: a word with at most d edits is cut into d + 1
segments, one of which an alike token must hold nearly in place; the pairs that
this leaves are verified by one dynamic program over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .units import FuzzyWord

#: Letters of a segment that are compared; 27**12 fits 64 bits.
_SEGMENT = 12
#: Pairs verified at once.
_PAIRS = 500_000

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


@dataclass
class Tokens:
    """Tokens of some texts: the texts' bytes in upper case, and each token's span, text and kind."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    digits: np.ndarray
    base: np.ndarray  #: where each text begins in ``data``

    def of(self, doc: int) -> slice:
        """The tokens of one text."""
        return slice(*np.searchsorted(self.doc, [doc, doc + 1]).tolist())


def tokens_of(texts: list[bytes]) -> Tokens:
    joined = b"\n".join(texts) + b"\n"
    data = _UPPER[np.frombuffer(joined, np.uint8)]
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    start = change[kind[change] > 0]
    stop = np.append(change, len(data))[np.searchsorted(change, start) + 1]
    base = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return Tokens(data, start, stop, np.searchsorted(base, start, side="right") - 1, kind[start] == 2, base)


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, a padded row each, and their lengths; no word holds a zero byte."""
    packed = np.array(words, f"S{max(map(len, words), default=1) or 1}")
    return packed.view(np.uint8).reshape(len(words), packed.itemsize), np.char.str_len(packed).astype(np.int64)


def edit_distances(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of padded bytes."""
    out = np.zeros(len(a), np.int64)
    row = np.tile(np.arange(b.shape[1] + 1, dtype=np.int16), (len(a), 1))
    every = np.arange(len(a))
    out[a_sizes == 0] = b_sizes[a_sizes == 0]
    for i in range(1, a.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, b.shape[1] + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = new
        ends = a_sizes == i
        out[ends] = row[every[ends], b_sizes[ends]]
    return out


class Index:
    """A list of words: each exact, by an alias, or at most ``distance`` edits away; ties go to the first of the list."""

    def __init__(self, words: tuple[FuzzyWord, ...]):
        self.words = words
        spelled = [w.word.replace(" ", "").encode() for w in words]
        self.exact: dict[bytes, int] = {}
        for i, w in enumerate(spelled):
            self.exact.setdefault(w, i)
        for i, w in enumerate(words):
            for alias in w.aliases:
                self.exact.setdefault(alias.replace(" ", "").encode(), i)  # an exact word comes first
        self.matrix, self.sizes = _matrix(spelled)
        self.most = np.array([w.distance for w in words], np.int64)
        near = [i for i, w in enumerate(words) if w.distance > 0]
        self.least = min([len(w) for w in self.exact] + [len(spelled[i]) - words[i].distance for i in near], default=1)
        self.longest = max([len(w) for w in self.exact] + [len(spelled[i]) + words[i].distance for i in near], default=0)
        # (place, length of the segment, edits) -> codes in order, and their words
        found: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for i in near:
            parts, size = words[i].distance + 1, len(spelled[i])
            cuts = [size * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                n = min(b - a, _SEGMENT)
                found.setdefault((a, n, words[i].distance), []).append((int(self._codes(self.matrix[i : i + 1], a, n)[0]), i))
        self.segments = {key: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for key, rows in found.items()}

    @staticmethod
    def _codes(matrix: np.ndarray, at: int, n: int) -> np.ndarray:
        code = np.zeros(len(matrix), np.int64)
        for k in range(at, at + n):
            code = code * 27 + (matrix[:, k].astype(np.int64) - 64)
        return code

    def match(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each token the number of its word, -1 without one, and the distance."""
        word = np.array([self.exact.get(t, -1) for t in tokens], np.int64)
        distance = np.zeros(len(tokens), np.int64)
        rest = np.flatnonzero(word < 0)
        if not len(rest) or not self.segments:
            return word, distance
        matrix, sizes = _matrix([tokens[i] for i in rest])
        pairs = [np.empty(0, np.int64)]
        for (at, n, edits), (codes, words) in self.segments.items():
            for place in range(max(at - edits, 0), at + edits + 1):
                if place + n > matrix.shape[1]:
                    break
                long_enough = np.flatnonzero(sizes >= place + n)
                here = self._codes(matrix[long_enough], place, n)
                first, last = np.searchsorted(codes, here, "left"), np.searchsorted(codes, here, "right")
                count = last - first
                token = np.repeat(long_enough, count)
                of = words[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                close = np.abs(sizes[token] - self.sizes[of]) <= self.most[of]
                pairs.append(token[close] * len(self.words) + of[close])
        pair = np.unique(np.concatenate(pairs))
        for start in range(0, len(pair), _PAIRS):
            token, of = np.divmod(pair[start : start + _PAIRS], len(self.words))
            far = edit_distances(matrix[token], sizes[token], self.matrix[of], self.sizes[of])
            good = far <= self.most[of]
            token, of, far = token[good], of[good], far[good]
            best = np.lexsort((of, far, token))[::-1]  # the nearest, and the first of those, is written last
            word[rest[token[best]]], distance[rest[token[best]]] = of[best], far[best]
        return word, distance

    def candidates(self, tokens: Tokens, merge: int = 3) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text: (first token, last token, word, distance), in order; a token begins one candidate at most, of as few tokens as match."""
        letters = tokens.data[_CLASS[tokens.data] > 0]  # neighbouring tokens lie end to end
        sizes = tokens.stop - tokens.start
        offset = np.cumsum(sizes) - sizes
        letters = np.append(letters, np.zeros(self.longest, np.uint8))
        first = np.flatnonzero(~tokens.digits)
        last, found = first.copy(), [np.empty((0, 4), np.int64)]
        for m in range(merge):
            if m:
                last = last + 1
                inside = last < len(sizes)
                first, last = first[inside], last[inside]
                same = (tokens.doc[last] == tokens.doc[first]) & ~tokens.digits[last]
                first, last = first[same], last[same]
            size = offset[last] + sizes[last] - offset[first]
            short = size <= self.longest
            first, last, size = first[short], last[short], size[short]
            fits = np.flatnonzero(size >= self.least)
            if not len(fits):
                continue
            place = np.arange(self.longest)
            merged = np.where(place < size[fits, None], letters[offset[first[fits], None] + place], np.uint8(0))
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.longest), len(fits), [None, pa.py_buffer(np.ascontiguousarray(merged))]).dictionary_encode()
            word, distance = self.match([t.rstrip(b"\0") for t in coded.dictionary.to_pylist()])
            which = coded.indices.to_numpy()
            hit = word[which] >= 0
            found.append(np.stack([first[fits[hit]], last[fits[hit]], word[which[hit]], distance[which[hit]]], 1))
            keep = np.ones(len(first), bool)
            keep[fits[hit]] = False
            first, last = first[keep], last[keep]
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for doc, row in zip(tokens.doc[rows[:, 0]].tolist(), rows.tolist()):
            out.setdefault(doc, []).append(tuple(row))
        return out
