"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text (A-Z lower-cased, parted by the bytes 0x20 and
0x09-0x0D), then one end token.  The filter holds, for each n-gram with count c,
the members (n-gram, 1) ... (n-gram, q) with q = 1 + floor(log_b c); a probe asks
for them in turn until one is missing, which gives c up to a factor b, never too
low.  It holds three kinds of n-grams: words, pairs of words and byte n-grams of
spellings (counted once for each distinct word).  A token's probability is a
mixture

    PAIR * p(word | word before) + WORD * p(word) + SPELL * p(spelling),

each part summing to one at most but for false positives, so the scores are
comparable log10 probabilities and unseen words keep one of their own.

**Counting** covers all training documents.  An n-gram's 64-bit key names its
segment (its high bits) and its place there (the low 32 bits).  Tasks add up
their own n-grams and send packed blocks (places, counts) to the segments; each
segment is filled by itself.  Two n-grams of one segment share a place with a
probability of about (n-grams of the segment) / 2**32, under 0.1 % at the usual
segment, and then count as one.  Words are counted exactly, by 64-bit ids.

**Size.**  The filter has ``BITS_PER_TOKEN`` bits for each training token and
``BITS_PER_WORD`` for each distinct word, however large the input, so the rate of
false positives (about 5 % for one level, measured in the tests) does not rise
with it.  Segments number one for ``SEGMENT_BYTES`` of training text, and
``MOST_SEGMENTS`` at most, beyond which they grow; tasks hold several segments
one after another, so their number does not follow from that of the segments.

**Probing.**  A filter of ``SENT_BITS`` (128 MB) or less is broadcast.  A larger
one is never in one place: each group of documents asks for its distinct n-grams,
the questions are dealt to the segments, each of which is filled, answers and is
dropped, and the levels return to their group.  Both ways give the same scores.

The base score needs exact counts.  Those of the ``frequent`` most frequent words
at most are broadcast; each group of documents (``GROUP_CHARS`` characters, or
one longer document) asks the vocabulary's segments for its distinct other words,
so a word's answers grow with groups and not with its occurrences.

Null and empty texts count as the end token alone; repeated rows are scored each,
and count each in training.  An empty table gives no rows; without training
documents (N = V = 0) the base score is 0 and the score that of the even spread
over bytes.  A text of any length is read in parts.  Other columns of ``docs``
are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, slim
from .words import END, START, Run, joined_by_cuts, mixed, runs, split_words, word_ids

BASE = 1.4
PROBES = 3
BITS_PER_TOKEN = 5
BITS_PER_WORD = 40
#: The largest filter that is broadcast; it does not limit the filter's size.
SENT_BITS = 1 << 30
#: Characters of the documents that ask together.
GROUP_CHARS = 16_000_000
FREQUENT = 100_000
PAIR, WORD, SPELL = 0.12, 0.58, 0.30
#: Byte n-grams of a spelling: lengths, and their weights; what is left is spread evenly.
GRAMS = (2, 3, 5)
GRAM_WEIGHTS = (0.20, 0.35, 0.44)
SEGMENT_BYTES = 12_000_000
LEAST_SEGMENTS, MOST_SEGMENTS = 8, 1 << 17
#: Words that a worker remembers, and distinct n-grams that a task adds up before it sends them.
CACHE_WORDS = 600_000
GRAM_CACHE = 1 << 19
HELD_WORDS, HELD_PAIRS = 1_000_000, 4_000_000
BLOCK = 250_000

_32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left, 11) ^ right, 12)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Ascends with the key."""
    return ((keys >> _32) * np.uint64(segments)) >> _32


def by_segment(keys: np.ndarray, segments: int) -> list[tuple[int, int, int]]:
    """(segment, from, to) of ascending keys, in spans of ``BLOCK`` at most."""
    where = segment_of(keys, segments).astype(np.int64)
    at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(keys)]
    return [(s, i, min(i + BLOCK, b)) for s, a, b in zip(where[at].tolist(), at.tolist(), ends.tolist()) for i in range(a, b, BLOCK)]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts (None: one each)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first)


# ---------------------------------------------------------------- the filter


class LogFilter:
    """Quantised counts behind membership probes; ``segments`` segments laid end to end."""

    def __init__(self, segment_bits: int, segments: int, most: int = 1 << 40):
        self.most = int(self.levels(np.array([max(most, 1)]))[0])  # no count has a higher level
        self.segment_bits, self.segments = segment_bits, segments
        self.data = np.zeros(segment_bits // 8 * segments, np.uint8)

    @staticmethod
    def first_place(places: np.ndarray, level: int) -> np.ndarray:
        return mixed(places | np.uint64(level << 32), 21)

    @staticmethod
    def nth_bit(first: np.ndarray, i: int, segment_bits: int) -> np.ndarray:
        return ((first + np.uint64(i) * ((first >> _32) | np.uint64(1)) & _LOW) * np.uint64(segment_bits) >> _32).astype(np.int64)

    @staticmethod
    def levels(counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)

    @classmethod
    def segment(cls, places: np.ndarray, counts: np.ndarray, segment_bits: int) -> np.ndarray:
        """The bytes of a segment that holds these n-grams."""
        bits = np.zeros(segment_bits, bool)
        levels, level, places = cls.levels(counts), 1, places.astype(np.uint64)
        while len(places):
            first = cls.first_place(places, level)
            for i in range(PROBES):
                bits[cls.nth_bit(first, i, segment_bits)] = True
            level += 1
            more = levels >= level
            places, levels = places[more], levels[more]
        return np.packbits(bits, bitorder="little")

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Of each n-gram the number of members found; 0: not in the filter."""
        found = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        base = segment_of(keys, self.segments).astype(np.int64) * self.segment_bits
        places = keys & _LOW
        for level in range(1, self.most + 1):
            first = self.first_place(places, level)
            for i in range(PROBES):
                at = self.nth_bit(first, i, self.segment_bits) + base
                ok = np.flatnonzero(self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                alive, base, places, first = alive[ok], base[ok], places[ok], first[ok]
            if not len(alive):
                break
            found[alive] = level
        return found


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(np.power(BASE, np.maximum(level, 1) - 1) - 1e-6), 0.0)


def most_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, least_count(level + 1) - 1, 0.0)


# ---------------------------------------------------------------- counting

WORDS_SCHEMA = "segment int, words binary, counts binary"


class WordTally:
    """Distinct words with their counts."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, pa.BinaryArray]] = []

    def size(self) -> int:
        return sum(len(h[0]) + h[2].nbytes // 32 for h in self.held)

    def add(self, ids: np.ndarray, counts: np.ndarray, words: pa.BinaryArray) -> None:
        self.held.append((ids, counts, words))

    def merged(self) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
        """Ascending by id."""
        if not self.held:
            return np.empty(0, np.uint64), np.empty(0, np.int64), pa.array([], pa.binary())
        ids, counts = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        ids, first, back = np.unique(ids, return_index=True, return_inverse=True)
        words = pa.concat_arrays([h[2] for h in self.held]).take(pa.array(first))
        totals = np.zeros(len(ids), np.int64)
        np.add.at(totals, back, counts)
        self.held = [(ids, totals, words)]
        return self.held[0]

    def rows(self, segments: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(segment, words joined by line feeds, counts)"""
        ids, counts, words = self.merged()
        spans = by_segment(ids, segments)
        if spans:
            joined = joined_by_cuts(words, np.array([a for _, a, _ in spans] + [len(ids)]))
            for (s, a, b), text in zip(spans, joined):
                yield s, text.as_py(), counts[a:b]


def named_batch(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def word_blocks(train: DataFrame, segments: int) -> DataFrame:
    """Words of ``train`` with their counts, added up within each task, for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = WordTally()

        def flush() -> pa.RecordBatch:
            rows = list(tally.rows(segments))
            tally.held.clear()
            return named_batch(segment=([r[0] for r in rows], pa.int32()), words=([r[1] for r in rows], pa.binary()), counts=([r[2].astype("<i8").tobytes() for r in rows], pa.binary()))

        for batch in slices(batches):
            for part in runs(batch.column("text").to_pylist()):
                ids, first, n = np.unique(part.ids[part.word_at], return_index=True, return_counts=True)
                tally.add(ids, n, part.words().take(pa.array(first)))
            if tally.size() > HELD_WORDS:
                tally.merged()
                if tally.size() > HELD_WORDS // 2:
                    yield flush()
        yield flush()

    return train.mapInArrow(run, WORDS_SCHEMA)


def in_segments(blocks: DataFrame, *order: str) -> DataFrame:
    """Each segment whole within a task, which may hold several."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "segment").sortWithinPartitions("segment", *order)


KIND = 8  # kinds of counts for each doubling


def vocabulary_of(train: DataFrame, segments: int) -> DataFrame:
    """segment, words (joined by line feeds), counts, v, n, mass, kinds, sizes, least: the exact counts of all words, by segment.

    v, n and mass are the number, the sum and the quantised sum of the row's
    counts; kinds, sizes and least say how many of its counts are of each size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, WordTally()

        def done() -> Iterator[pa.RecordBatch]:
            for segment, words, n in tally.rows(segments):
                kind = np.floor(np.log2(n) * KIND).astype(int)
                kinds, back = np.unique(kind, return_inverse=True)
                least = np.full(len(kinds), np.iinfo(np.int64).max)
                np.minimum.at(least, back, n)
                yield named_batch(
                    segment=([segment], pa.int32()), words=([words], pa.binary()), counts=([n.astype("<i8").tobytes()], pa.binary()), v=([len(n)], pa.int64()), n=([int(n.sum())], pa.int64()),
                    mass=([float(least_count(LogFilter.levels(n)).sum())], pa.float64()), kinds=([kinds], pa.list_(pa.int32())), sizes=([np.bincount(back)], pa.list_(pa.int64())), least=([least], pa.list_(pa.int64())),
                )

        for batch in batches:
            for segment, words, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "words", "counts"))):
                if segment != now:
                    yield from done()
                    now, tally = segment, WordTally()
                data, offsets, _ = split_words(words)
                tally.add(word_ids(data, offsets), np.frombuffer(counts, "<i8"), Run(None, None, None, offsets[1:], data, offsets).words())
                if len(tally.held) > 1 and tally.size() > HELD_WORDS + 2 * len(tally.held[0][0]):
                    tally.merged()
        yield from done()

    return in_segments(word_blocks(train, segments)).mapInArrow(run, f"{WORDS_SCHEMA}, v long, n long, mass double, kinds array<int>, sizes array<long>, least array<long>")


BLOCK_SCHEMA = "segment int, places binary, counts binary"


def blocks_of(keys: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Packed rows for each segment, of ascending keys; a count takes one byte, or eight where it needs them."""
    small = counts < 256
    for chosen, kind in ((small, np.uint8), (~small, np.dtype("<i8"))):
        k, n = keys[chosen], counts[chosen]
        spans = by_segment(k, segments)
        places = (k & _LOW).astype("<u4")
        for i in range(0, len(spans), 1_000):
            part = spans[i : i + 1_000]
            yield named_batch(segment=([s for s, _, _ in part], pa.int32()), places=([places[a:b].tobytes() for _, a, b in part], pa.binary()), counts=([n[a:b].astype(kind).tobytes() for _, a, b in part], pa.binary()))


def pairs_within(part: Run) -> np.ndarray:
    """Keys of neighbouring tokens."""
    return pair_keys(part.ids[:-1], part.ids[1:])[part.inner()[1:]]


def pair_blocks(train: DataFrame, segments: int) -> DataFrame:
    """Pairs of neighbouring tokens of ``train``, counted within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches):
            for part in runs(batch.column("text").to_pylist()):
                held.append(pairs_within(part))
            if sum(map(len, held)) > HELD_PAIRS:
                yield from blocks_of(*summed(np.concatenate(held)), segments)
                held = []
        if held:
            yield from blocks_of(*summed(np.concatenate(held)), segments)

    return train.mapInArrow(run, BLOCK_SCHEMA)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with four zero bytes before each and a byte 1, their end, after it; then the places, counted from the fifth byte, of bytes and ends; and each word's first."""
    sizes = np.diff(offsets)
    begins = offsets[:-1] + 5 * np.arange(len(sizes)) + 4
    out = np.zeros(len(data) + 5 * len(sizes), np.uint8)
    out[np.arange(len(data)) + np.repeat(begins - offsets[:-1], sizes)] = data
    out[begins + sizes] = 1
    firsts = offsets[:-1] + np.arange(len(sizes))
    spots = np.arange(len(data) + len(sizes)) + np.repeat(begins - 4 - firsts, sizes + 1)
    return out, spots, firsts


def gram_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each byte from the fifth on, and of its context (all but the last byte)."""
    value = np.zeros(len(data) - 4, np.uint64)
    for i in range(length):
        value |= data[4 - i : len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    return mixed(value, 100 + length), mixed(value >> np.uint64(8), 200 + length)


def spelling_keys(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Keys of all n-grams and contexts of these words' spellings."""
    if len(offsets) < 2:
        return []
    out, spots, _ = padded(data, offsets)
    return [keys[spots] for length in GRAMS for keys in gram_keys(out, length)]


def vocabulary_blocks(vocabulary: DataFrame, segments: int) -> DataFrame:
    """Words with their counts, and the n-grams of spellings, each word counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                data, offsets, _ = split_words(words)
                ids, counts = summed(word_ids(data, offsets), np.frombuffer(counts, "<i8"))
                yield from blocks_of(ids, counts, segments)
                yield from blocks_of(*summed(np.concatenate(spelling_keys(data, offsets))), segments)

    return vocabulary.select("words", "counts").mapInArrow(run, BLOCK_SCHEMA)


class Tally:
    """Places of one segment and their counts, added up block by block."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, places: bytes, counts: bytes) -> None:
        places = np.frombuffer(places, "<u4")
        self.held.append((places, np.frombuffer(counts, np.uint8 if len(counts) == len(places) else "<i8").astype(np.int64)))
        if len(self.held) > 1 and sum(len(p) for p, _ in self.held[1:]) > max(2_000_000, len(self.held[0][0])):
            self.held = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        return summed(*(np.concatenate([h[i] for h in self.held]) for i in (0, 1)))


def segments_for(size: int) -> int:
    """How many segments a filter over ``size`` bytes of training text has."""
    return min(MOST_SEGMENTS, max(LEAST_SEGMENTS, -(-size // SEGMENT_BYTES)))


def bits_of_segment(tokens: int, distinct: int, segments: int) -> int:
    """A multiple of eight; at most 2**32, which is what 100 times the tokens of ``SEGMENT_BYTES`` need."""
    return min(1 << 32, max(1 << 13, -(-(BITS_PER_TOKEN * tokens + BITS_PER_WORD * distinct) // segments) // 8 * 8))


def training_blocks(train: DataFrame, vocabulary: DataFrame, segments: int, documents: int) -> DataFrame:
    """What the filter is to hold; the end tokens are as many as the documents."""
    end = [(row["segment"], row["places"], row["counts"]) for batch in blocks_of(np.array([END]), np.array([documents]), segments) for row in batch.to_pylist()]
    ends = train.sparkSession.createDataFrame(end if documents else [], BLOCK_SCHEMA)
    return pair_blocks(train, segments).unionByName(vocabulary_blocks(vocabulary, segments)).unionByName(ends)


def build_filter(blocks: DataFrame, segment_bits: int, segments: int, tokens: int) -> LogFilter:
    """The whole filter, for broadcasting."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()

        def done() -> pa.RecordBatch:
            data = LogFilter.segment(*tally.summed(), segment_bits)
            return named_batch(segment=([now], pa.int32()), data=([data.tobytes()], pa.binary()))

        for batch in batches:
            for segment, places, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "places", "counts"))):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, tally = segment, Tally()
                tally.add(places, counts)
        if now is not None:
            yield done()

    out, size = LogFilter(segment_bits, segments, tokens), segment_bits // 8
    filled = cut(in_segments(blocks).mapInArrow(fill, "segment int, data binary"))
    for row in filled.toLocalIterator():  # SENT_BITS at most
        out.data[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.data, np.uint8)
    return out


# ---------------------------------------------------------------- scoring


class Scorer:
    """Mixture probabilities of words, worked out once for each word that a worker remembers."""

    def __init__(self, model, mass: float, frequent: tuple[np.ndarray, np.ndarray]):
        self.model = model
        self.mass = max(mass, 1.0)  # sum of the words' quantised counts
        self.exact_ids, self.exact = frequent  # ascending ids
        self.forget()

    def forget(self) -> None:
        self.ids = np.empty(0, np.uint64)
        self.own, self.before, self.count = np.empty(0), np.empty(0), np.empty(0, np.int64)
        # Direct-mapped cache of the n-grams' probabilities; key 0 is free.
        self.gram_key, self.gram_p = np.zeros(GRAM_CACHE, np.uint64), np.zeros(GRAM_CACHE)

    @staticmethod
    def find(among: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(among, ids)
        if not len(among):
            return at, np.zeros(len(ids), bool)
        at = np.minimum(at, len(among) - 1)
        return at, among[at] == ids

    def gram_probability(self, data: np.ndarray, spots: np.ndarray, length: int) -> np.ndarray:
        """p of each spot's byte after the bytes before it, by counts of n-grams of this length."""
        gram, context = (keys[spots] for keys in gram_keys(data, length))
        slot = (gram & np.uint64(GRAM_CACHE - 1)).astype(np.int64)
        p = self.gram_p[slot]
        missing = np.flatnonzero(self.gram_key[slot] != gram)
        if len(missing):
            keys, first, back = np.unique(gram[missing], return_index=True, return_inverse=True)
            n = self.model.level(keys)
            found = np.zeros(len(keys))
            seen = np.flatnonzero(n)
            c = most_count(self.model.level(context[missing[first[seen]]]))
            found[seen] = np.minimum(1.0, least_count(n[seen]) / np.maximum(c, 1.0))
            p[missing] = found[back]
            self.gram_key[slot[missing[first]]], self.gram_p[slot[missing[first]]] = keys, found
        return p

    def spelled(self, words: pa.BinaryArray) -> np.ndarray:
        """log10 p(spelling) of each word: the product over its bytes and its end."""
        if not len(words):
            return np.empty(0)
        data, offsets = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int32).astype(np.int64)
        out, spots, firsts = padded(data[: offsets[-1]], offsets)
        p = np.full(len(spots), (1 - sum(GRAM_WEIGHTS)) / 256)
        for length, weight in zip(GRAMS, GRAM_WEIGHTS):
            p += weight * self.gram_probability(out, spots, length)
        return np.add.reduceat(np.log10(p), firsts)

    def learn(self, ids: np.ndarray, words: pa.BinaryArray, n_words: int) -> tuple[np.ndarray, ...]:
        """own (log10), before and count of these tokens, the first ``n_words`` of which are words with these bytes."""
        level = self.model.level(ids)
        p = np.zeros(len(ids))
        p[:n_words] = SPELL * np.power(10.0, np.maximum(self.spelled(words), -280))
        own = np.log10(np.maximum(WORD * np.minimum(1.0, least_count(level) / self.mass) + p, 1e-290))
        at, known = self.find(self.exact_ids, ids)
        return own, most_count(level), np.where(known, self.exact[at] if len(self.exact) else 0, -1)

    def tokens(self, part: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """own, before and count of all tokens."""
        other = np.ones(len(part.ids), bool)
        other[part.word_at] = False
        order = np.concatenate([part.word_at, np.flatnonzero(other)])
        ids, first, back = np.unique(part.ids[order], return_index=True, return_inverse=True)
        at, known = self.find(self.ids, ids)
        values = [np.empty(len(ids)), np.empty(len(ids)), np.empty(len(ids), np.int64)]
        for value, kept in zip(values, (self.own, self.before, self.count)):
            value[known] = kept[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(first[new] >= len(part.word_at), kind="stable")]  # those with bytes of their own first
            n_words = int((first[new] < len(part.word_at)).sum())
            learned = self.learn(ids[new], part.words().take(pa.array(first[new[:n_words]])), n_words)
            for value, found in zip(values, learned):
                value[new] = found
            self.remember(ids, values, new[:n_words])
        out = [np.empty(len(order), v.dtype) for v in values]
        for o, value in zip(out, values):
            o[order] = value[back]
        return tuple(out)

    def remember(self, ids: np.ndarray, values: list[np.ndarray], new: np.ndarray) -> None:
        keep = slice(None) if len(self.ids) + len(new) <= CACHE_WORDS else np.flatnonzero(self.count >= 0)  # when full, all but the frequent words go
        merged = np.concatenate([self.ids[keep], ids[new]])
        order = np.argsort(merged)
        self.ids = merged[order]
        self.own, self.before, self.count = (np.concatenate([kept[keep], value[new]])[order] for kept, value in zip((self.own, self.before, self.count), values))

    def score(self, part: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part (tokens, known, sum of log10(c + 1) of frequent words, log10 probability); then the other words' ids, and how many of them each part has."""
        own, before, count = self.tokens(part)
        inner = part.inner()
        context = before[:-1]
        worth = np.flatnonzero(inner[1:] & (context > 0))
        n = least_count(self.model.level(pair_keys(part.ids[worth], part.ids[worth + 1])))
        seen = np.flatnonzero(n)
        at = worth[seen] + 1
        own[at] = np.log10(np.power(10.0, own[at]) + PAIR * np.minimum(1.0, n[seen] / context[worth[seen]]))
        usual, rare = inner & (count >= 0), inner & (count < 0)
        columns = (inner, usual & (count > 0), np.where(usual, np.log10(np.maximum(count, 0) + 1.0), 0.0), np.where(inner, own, 0.0), rare)
        sums = np.array([np.add.reduceat(c.astype(float), part.opens) for c in columns])
        return sums[:4], part.ids[rare], sums[4].astype(np.int64)


class Group:
    """Documents scored together, and their words that are not among the frequent ones."""

    def __init__(self) -> None:
        self.doc_ids: list = []
        self.sums: list[np.ndarray] = []
        self.rare: list[np.ndarray] = []
        self.rare_n: list[np.ndarray] = []
        self.chars = 0

    def add(self, scorer: Scorer, doc_ids: list, texts: list[str]) -> None:
        sums, rare_n = np.zeros((4, len(texts))), np.zeros(len(texts), np.int64)
        for part in runs(texts):
            found, rare, n = scorer.score(part)
            np.add.at(sums, (slice(None), part.docs), found)
            np.add.at(rare_n, part.docs, n)
            self.rare.append(rare)
        self.doc_ids += doc_ids
        self.sums.append(sums)
        self.rare_n.append(rare_n)
        self.chars += sum(map(len, texts))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct other words, ascending, and which one each occurrence is."""
        return np.unique(np.concatenate([np.empty(0, np.uint64), *self.rare]), return_inverse=True)


ASK_SCHEMA = "group long, seq int, segment int, ids binary, places binary"
ASK_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
SCORED_SCHEMA = "doc_id long, n_tokens long, n_known long, base double, score double"


def scored_rows(doc_ids: list, sums: np.ndarray, rare_n: np.ndarray, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """The final rows of a group, given the exact counts of its other words."""
    ends = np.cumsum(rare_n)
    total = lambda values: np.r_[0, np.cumsum(values[at])][ends] - np.r_[0, np.cumsum(values[at])][ends - rare_n]
    known = sums[1] + total((counts > 0).astype(np.int64))
    base = sums[2] + total(np.log10(counts + 1.0))
    return named_batch(doc_id=(doc_ids, pa.int64()), n_tokens=(sums[0].astype(np.int64), pa.int64()), n_known=(known.astype(np.int64), pa.int64()), base=(base, pa.float64()), score=(sums[3], pa.float64()))


def asked_rows(group: int, ids: np.ndarray, keys: np.ndarray, segments: int) -> list[tuple]:
    """Rows of ASK_SCHEMA that ask for the exact counts of words and the levels of n-grams; both are ascending, and `seq` keeps that order."""
    rows = [(s, ids[a:b].astype("<u8").tobytes(), None) for s, a, b in by_segment(ids, segments)]
    rows += [(s, None, (keys[a:b] & _LOW).astype("<u4").tobytes()) for s, a, b in by_segment(keys, segments)]
    return [(group, seq, *row) for seq, row in enumerate(rows)]


def batch_of(rows: list[tuple], types: tuple, names: str) -> pa.RecordBatch:
    """A batch of these rows; ``names`` is a schema's text."""
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[n.split()[0] for n in names.split(",")])


_KEPT: dict[str, Scorer] = {}


def kept_scorer(name: str, parts: tuple) -> Scorer:
    """The worker's scorer of this name; what it has learned serves all of the worker's tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Scorer(*parts)
    return _KEPT[name]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(group, whether it ends here, slice): GROUP_CHARS characters of a task's documents form a group."""
    from pyspark import TaskContext

    group, chars, held = TaskContext.get().partitionId() << 32, 0, None
    for batch in slices(batches):
        if held is not None:
            yield group, chars >= GROUP_CHARS, held
            if chars >= GROUP_CHARS:
                group, chars = group + 1, 0
        held = batch
        chars += pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
    if held is not None:
        yield group, True, held


ANSWER_SCHEMA = "group long, seq int, counts binary, levels binary"


def answers(asked: DataFrame, vocabulary: DataFrame, blocks: DataFrame | None, segment_bits: int, tokens: int) -> DataFrame:
    """What the segments answer; ``blocks``: what their filters hold, None where nobody asks for levels."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    number = lambda i, n, t="int": F.lit(i).cast(t).alias(n)
    rows = vocabulary.select("segment", number(-2, "group", "long"), number(-1, "seq"), F.col("words").alias("ids"), none("binary", "places"), "counts")
    if blocks is not None:
        rows = rows.unionByName(blocks.select("segment", number(-1, "group", "long"), number(-1, "seq"), none("binary", "ids"), "places", "counts"))
    rows = rows.unionByName(asked.select("segment", "group", "seq", "ids", "places", none("binary", "counts")))
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, tally, exact, part = None, [], Tally(), None, None
        for batch in batches:
            out = []
            for segment, group, seq, ids, places, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "group", "seq", "ids", "places", "counts"))):
                if segment != now:
                    now, words, tally, exact, part = segment, [], Tally(), None, None
                if group == -2:
                    data, offsets, _ = split_words(ids)
                    words.append((word_ids(data, offsets), np.frombuffer(counts, "<i8")))
                elif group == -1:
                    tally.add(places, counts)
                elif ids is not None:
                    if exact is None:
                        exact = summed(*(np.concatenate([np.empty(0, t), *(w[i] for w in words)]) for i, t in enumerate((np.uint64, np.int64))))
                        words = []
                    at, known = Scorer.find(exact[0], np.frombuffer(ids, "<u8"))
                    found = np.zeros(len(at), np.int64)
                    found[known] = exact[1][at[known]]
                    out.append((group, seq, found.astype("<i8").tobytes(), None))
                else:
                    if part is None:
                        part = LogFilter(segment_bits, 1, tokens)
                        part.data, tally = LogFilter.segment(*tally.summed(), segment_bits), Tally()
                    out.append((group, seq, None, part.level(np.frombuffer(places, "<u4").astype(np.uint64)).astype(np.uint8).tobytes()))
            yield batch_of(out, types, ANSWER_SCHEMA)

    return in_segments(rows, "group").mapInArrow(run, ANSWER_SCHEMA)


class Answers:
    """What a group was told, in place of the filter."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.keys, self.levels = keys, levels

    def level(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        assert (self.keys[at] == keys).all(), "an n-gram that was not asked for"
        return self.levels[at]


def joined_answers(rows: list[tuple[int, bytes | None, bytes | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and levels in the order in which they were asked for."""
    rows = sorted(rows, key=lambda r: r[0])
    return np.frombuffer(b"".join(c for _, c, _ in rows if c is not None), "<i8"), np.frombuffer(b"".join(v for _, _, v in rows if v is not None), np.uint8).astype(np.int64)


def by_group(rows: DataFrame) -> DataFrame:
    """Each group whole within a task, its documents before its answers."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "group").sortWithinPartitions("group", "seq")


DOCS_SCHEMA = "doc_ids array<long>, sums binary, rare_n binary, at binary"
DOCS_TYPES = (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())


def scored_by_broadcast(docs: DataFrame, vocabulary: DataFrame, parts: tuple, segments: int) -> DataFrame:
    sent, name = docs.sparkSession.sparkContext.broadcast(parts), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group (seq -1) with its documents' sums, and rows that ask for exact counts."""
        scorer, held = kept_scorer(name, sent.value), Group()
        for group, ends, batch in groups_of(batches):
            held.add(scorer, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if ends:
                ids, at = held.distinct()
                rows = [(group, -1, None, None, None, held.doc_ids, np.concatenate(held.sums, axis=1).tobytes(), np.concatenate(held.rare_n).tobytes(), at.astype("<u4").tobytes())]
                rows += [(*r, None, None, None, None) for r in asked_rows(group, ids, np.empty(0, np.uint64), segments)]
                yield batch_of(rows, ASK_TYPES + DOCS_TYPES, f"{ASK_SCHEMA}, {DOCS_SCHEMA}")
                held = Group()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, told = None, None, []

        def done() -> pa.RecordBatch:
            doc_ids, sums, rare_n, at = mine
            return scored_rows(doc_ids, np.frombuffer(sums).reshape(4, -1), np.frombuffer(rare_n, np.int64), np.frombuffer(at, "<u4"), joined_answers(told)[0])

        for batch in batches:
            for group, seq, counts, levels, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "seq", "counts", "levels", "doc_ids", "sums", "rare_n", "at"))):
                if group != now:
                    if now is not None:
                        yield done()
                    now, mine, told = group, row, []
                elif seq >= 0:
                    told.append((seq, counts, levels))
        if now is not None:
            yield done()

    written = cut(docs.mapInArrow(score, f"{ASK_SCHEMA}, {DOCS_SCHEMA}"))
    told = answers(written.where("seq >= 0").select("group", "seq", "segment", "ids", "places"), vocabulary, None, 0, 0)
    mine = written.where("seq < 0").select("group", "seq", *(c.split()[0] for c in DOCS_SCHEMA.split(", ")))
    return by_group(mine.unionByName(told, allowMissingColumns=True)).mapInArrow(finish, SCORED_SCHEMA)


def asked_for(texts: list[str], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What scoring these texts may look up: the words that are not among the ``frequent`` ones, and all n-grams; both distinct, ascending."""
    words, keys = [], []
    for part in runs(texts):
        ids, first = np.unique(part.ids[part.word_at], return_index=True)
        words.append(ids[~Scorer.find(frequent, ids)[1]])
        taken = part.words().take(pa.array(first))
        data, offsets = np.frombuffer(taken.buffers()[2] or b"", np.uint8), np.frombuffer(taken.buffers()[1], np.int32).astype(np.int64)
        keys += [np.unique(k) for k in (part.ids, pairs_within(part), *spelling_keys(data[: offsets[-1]], offsets))]
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(keys))


def scored_by_segments(docs: DataFrame, vocabulary: DataFrame, blocks: DataFrame, segment_bits: int, segments: int, tokens: int, mass: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """As by broadcast, but each group is told the levels that it needs."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents (seq -1) with their group, and rows that ask for exact counts and levels."""
        texts: list[str] = []
        types = (*ASK_TYPES, pa.int64(), pa.string())
        for group, ends, batch in groups_of(batches):
            more = batch.column("text").to_pylist()
            texts += more
            yield batch_of([(group, -1, None, None, None, i, t) for i, t in zip(batch.column("doc_id").to_pylist(), more)], types, f"{ASK_SCHEMA}, doc_id, text")
            if ends:
                for row in asked_rows(group, *asked_for(texts, sent.value[0]), segments):
                    yield batch_of([(*row, None, None)], types, f"{ASK_SCHEMA}, doc_id, text")
                texts = []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(None, mass, sent.value)
        now, doc_ids, texts, told = None, [], [], []

        def done() -> pa.RecordBatch:
            words, keys = asked_for(texts, sent.value[0])
            counts, levels = joined_answers(told)
            scorer.model, held = Answers(keys, levels), Group()
            held.add(scorer, doc_ids, texts)
            ids, at = held.distinct()
            return scored_rows(doc_ids, np.concatenate(held.sums, axis=1), np.concatenate(held.rare_n), at, counts[np.searchsorted(words, ids)])

        for batch in batches:
            for group, seq, doc_id, text, counts, levels in zip(*(batch.column(c).to_pylist() for c in ("group", "seq", "doc_id", "text", "counts", "levels"))):
                if group != now:
                    if now is not None:
                        yield done()
                    now, doc_ids, texts, told = group, [], [], []
                if seq < 0:
                    doc_ids.append(doc_id)
                    texts.append(text)
                else:
                    told.append((seq, counts, levels))
        if now is not None:
            yield done()

    written = cut(docs.mapInArrow(ask, f"{ASK_SCHEMA}, doc_id long, text string"))
    told = answers(written.where("seq >= 0").drop("doc_id", "text"), vocabulary, blocks, segment_bits, tokens)
    mine = written.where("seq < 0").select("group", "seq", "doc_id", "text")
    return by_group(mine.unionByName(told, allowMissingColumns=True)).mapInArrow(finish, SCORED_SCHEMA)


def frequent_words(vocabulary: DataFrame, documents: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and counts of the words of at least a certain count, ``most`` at most; the end token is always among them."""
    kinds = vocabulary.select(F.explode(F.arrays_zip("kinds", "sizes", "least")).alias("x")).groupBy("x.kinds").agg(F.sum("x.sizes").alias("words"), F.min("x.least").alias("n")).collect()  # KIND rows for each doubling of the count
    total, least = 0, 1 << 62
    for row in sorted(kinds, key=lambda r: -r.kinds):
        total += row.words
        if total > most:
            break
        least = row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(counts, "<i8")
                data, offsets, _ = split_words(words)
                ids, kept = word_ids(data, offsets), n >= least
                yield named_batch(ids=([ids[kept].tobytes()], pa.binary()), counts=([n[kept].tobytes()], pa.binary()))

    found = vocabulary.where(F.array_max("least") >= least).select("words", "counts").mapInArrow(run, "ids binary, counts binary").collect()
    ids = np.concatenate([[END], *(np.frombuffer(r.ids, np.uint64) for r in found)]).astype(np.uint64)
    counts = np.concatenate([[documents], *(np.frombuffer(r.counts, np.int64) for r in found)]).astype(np.int64)
    order = np.argsort(ids)
    return ids[order], counts[order]


def lm_scores(docs: DataFrame, train: Column, frequent: int = FREQUENT, sent_bits: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``; it learns from the rows where ``train`` holds.

    Scores are log10 probabilities.  The base score is that of add-one smoothed
    single tokens, from exact counts.
    """
    whole = slim(docs)
    learned = slim(docs.where(train)).select("text")
    size = learned.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()[0]
    segments = segments_for(size.bytes)
    vocabulary = cut(vocabulary_of(learned, segments))
    sums = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "mass"))).collect()[0]
    total, distinct = sums.n + size.documents, sums.v + (size.documents > 0)
    mass = float(sums.mass) + float(least_count(LogFilter.levels(np.array([size.documents])))[0] if size.documents else 0)
    common = frequent_words(vocabulary, size.documents, frequent)
    segment_bits = bits_of_segment(total, distinct, segments)
    blocks = training_blocks(learned, vocabulary, segments, size.documents)
    if segment_bits * segments <= (SENT_BITS if sent_bits is None else sent_bits):
        scored = scored_by_broadcast(whole, vocabulary, (build_filter(blocks, segment_bits, segments, total), mass, common), segments)
    else:
        scored = scored_by_segments(whole, vocabulary, blocks, segment_bits, segments, total, mass, common)
    spread = math.log10(total + distinct + 1) if total else 0.0
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        "score",
    )
