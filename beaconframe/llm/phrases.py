"""Collocations: phrases of two to four words by counts from suffix arrays of word ids.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and
those into words at spaces and tabs.  A shard is some texts of one task, of
bounded size; its words get ids (one for each language and word), its suffix
array comes from prefix doubling in numpy, and the intervals of its LCP array
give the counts of its n-grams, one row each.  Rows are merged by key over the
cluster, and only phrases found ``LEAST`` times or more are kept.

There are three passes over the texts, since no phrase is more frequent than its
parts: words; pairs of frequent words; phrases of three and four words all of
whose pairs are frequent.  Each pass hands the next its frequent phrases as a
Bloom filter of bounded size (``FILTER_BITS``).  A filter only spares rows: what it
lets through wrongly is counted and then found infrequent, so counts stay exact
at any fill.

Null texts count as empty, a null lang as `und`.  A text longer than a shard is cut
between words, and phrases across the cut are counted from their first word.
Ties are broken by the phrase's bytes; repeated rows count as often as they
occur.  An empty table gives no rows.  Columns other than text and lang are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .words import mixed, word_ids

LONGEST = 4
LEAST = 30
COVERED = 80
TOP = 2_000
SCALE = 2_000_000
#: Bytes of text in a shard.
SHARD = 3_000_000
#: Bits a frequent phrase has in the filter, and the filter's largest size (64 MB).
BITS_EACH, PROBES, FILTER_BITS = 16, 4, 1 << 29
#: Bits of a filter that are put together in one task.
SEGMENT = 1 << 18
#: Rows of one output batch.
ROWS = 20_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_CUT = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")


@dataclass
class Shard:
    """Words of some texts; word i+1 follows word i in its piece where ``follows[i]``."""

    words: pa.BinaryArray  #: different words
    langs: list[str]
    ids: np.ndarray  #: of each word: its place among ``keys``
    keys: np.ndarray  #: (language, word) as one number, in order
    follows: np.ndarray
    owned: np.ndarray  #: words that phrases are counted from; the others are context

    def word_of(self, ids: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.keys[ids] % len(self.words)))

    def lang_of(self, ids: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.keys[ids] // len(self.words)))

    def hashes(self) -> np.ndarray:
        """64 bits for each language and word."""
        return mixed(_hashed(self.words)[self.keys % len(self.words)], 3) ^ mixed(_hashed(pa.array([x.encode() for x in self.langs], pa.binary()))[self.keys // len(self.words)], 5)


def _hashed(words: pa.BinaryArray) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return word_ids(data, offsets - offsets[0])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first ^ mixed(second, 7), 11)


def pieces_of(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """The text in parts of about ``limit`` bytes, each with a few words more as context; and how many bytes are its own."""
    at = 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit)
        if not found:
            break
        end = stop = found.end()
        for _ in range(LONGEST - 1):  # the context: as many words as a phrase can reach
            word = re.compile(rb"[^ \t.,;:!?\x0A-\x0D]").search(text, stop)
            after = _CUT.search(text, word.start()) if word else None
            stop = after.end() if after else len(text)
        yield text[at:stop], end - at
        at = end
    yield text[at:], len(text) - at


def _shard(parts: list[tuple[bytes, int, str]]) -> Shard:
    joined = b"\n".join(p[0] for p in parts) + b"\n"
    seen = np.frombuffer(joined, np.uint8)
    kind = _KIND[seen]
    apart = kind > 0
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    starts = edge[::2] if apart[0] else np.r_[0, edge[1::2]]
    ends = edge[1::2] if apart[0] else edge[::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(seen[~apart])]).dictionary_encode()
    sizes = np.array([len(p[0]) + 1 for p in parts])
    begins = np.cumsum(sizes) - sizes
    part = np.searchsorted(begins, starts, side="right") - 1
    langs = sorted({p[2] for p in parts})
    lang = np.array([langs.index(p[2]) for p in parts] if len(langs) < 100 else np.searchsorted(np.array(langs, object), np.array([p[2] for p in parts], object)))
    keys, ids = np.unique(lang[part] * np.int64(max(len(coded.dictionary), 1)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    owned = starts - begins[part] < np.array([p[1] for p in parts])[part]
    return Shard(coded.dictionary, langs, ids, keys, np.append(piece[1:] == piece[:-1], False)[: len(starts)], owned)


def shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD) -> Iterator[Shard]:
    """The texts of a task, in shards of about ``limit`` bytes."""
    held: list[tuple[bytes, int, str]] = []
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            for part, own in pieces_of((text.as_py() or "").encode().lower(), limit):
                if held and size + len(part) > limit:
                    yield _shard(held)
                    held, size = [], 0
                held.append((part, own, lang.as_py()))
                size += len(part)
    if held:
        yield _shard(held)


def suffix_order(words: np.ndarray, follows: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes from ``starts`` in the order of their first ``depth`` (2 or 4) words; and the LCP of each with the one before it (0 for the first).

    ``words``: ids; ``follows[i]``: whether word i + 1 belongs to what begins at i.
    Prefix doubling: ranks of two words come from pairs of one-word ranks, ranks
    of four from pairs of those; a missing word ranks before all others.
    """
    n = len(words)
    rank, span, reaches = words.astype(np.int64) + 1, 1, follows
    while True:
        later = np.zeros(n, np.int64)
        later[: n - span] = np.where(reaches[: n - span], rank[span:], 0)
        pair = rank * (int(rank.max(initial=0)) + 1) + later
        if 2 * span >= depth:
            break
        _, rank = np.unique(pair, return_inverse=True)
        rank, span = rank + 1, 2 * span
        reaches = np.append(follows[:-1] & follows[1:], False)
    order = starts[np.argsort(pair[starts], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    same, at, there = np.ones(max(len(order) - 1, 0), bool), order.copy(), np.ones(len(order), bool)
    for k in range(depth):
        if k:
            there &= follows[at]
            at = np.where(there, at + 1, at)
        same &= there[1:] & there[:-1] & (words[at[1:]] == words[at[:-1]])
        lcp[1:] += same
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, lengths: np.ndarray, owned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each different n-gram of the suffixes one place where it is, and how often it begins at an owned word; ``lengths`` of the suffixes, in words."""
    begins = np.flatnonzero(lcp < n)
    if not len(begins):
        return begins, begins
    counts = np.add.reduceat(owned[order].astype(np.int64), begins)
    good = (lengths[order[begins]] >= n) & (counts > 0)
    return order[begins[good]], counts[good]


def _reach(follows: np.ndarray, depth: int) -> np.ndarray:
    """How many words, ``depth`` at most, can be read from each place."""
    length, on = np.ones(len(follows), np.int64), np.ones(len(follows), bool)
    for k in range(1, depth):
        on[: len(on) - k + 1] &= follows[k - 1 :]
        on[len(on) - k + 1 :] = False
        length += on
    return length


def _rows(shard: Shard, ids: np.ndarray, at: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(at), ROWS):
        here = at[start : start + ROWS]
        phrase = pa.compute.binary_join_element_wise(*[shard.word_of(ids[here + k]) for k in range(n)], b" ") if n > 1 else shard.word_of(ids[here])
        yield pa.record_batch([shard.lang_of(ids[here]), phrase.cast(pa.string()), pa.array(counts[start : start + ROWS])], names=["lang", "phrase", "f"])


def _passed(texts: DataFrame, lengths: tuple[int, ...], bits: list[bytes] | None, limit: int) -> DataFrame:
    """lang, phrase, f of the phrases of these lengths found LEAST times; ``bits``: the filter of the words (for pairs) or pairs (for longer ones)."""
    longest = max(lengths)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        asked = shared.value and Filter(shared.value)
        for shard in shards(batches, limit):
            if not len(shard.ids):
                continue
            if longest == 1:
                counts = np.bincount(shard.ids[shard.owned], minlength=len(shard.keys))
                found = np.flatnonzero(counts)
                yield from _rows(shard, np.arange(len(shard.keys)), found, counts[found], 1)
                continue
            follows, hashes = shard.follows.copy(), shard.hashes()
            if longest == 2:
                known = asked.holds(hashes)[shard.ids]
                follows[:-1] &= known[:-1] & known[1:]
            else:
                at = np.flatnonzero(follows)
                follows[at] = asked.holds(pair_hash(hashes[shard.ids[at]], hashes[shard.ids[at + 1]]))
            part = follows.copy()  # words that belong to some phrase
            part[1:] |= follows[:-1]
            ids, follows, owned = shard.ids[part], follows[part], shard.owned[part]
            length = _reach(follows, longest)
            order, lcp = suffix_order(ids, follows, np.flatnonzero(length >= min(lengths)), longest)
            for n in lengths:
                yield from _rows(shard, ids, *intervals(order, lcp, length, owned, n), n)

    counted = texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted if longest == 1 else counted.where(F.col("f") >= LEAST)


class Filter:
    """A Bloom filter in segments of equal size."""

    def __init__(self, segments: list[bytes]):
        self.bits = np.frombuffer(b"".join(segments), np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in places(hashes, len(self.bits) * 8):
            found &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of a filter that each hash sets."""
    for k in range(PROBES):
        yield mixed(hashes, 20 + k) & np.uint64(bits - 1)


def build_filter(frequent: DataFrame, n: int, most: int = FILTER_BITS) -> list[bytes]:
    """The filter of the frequent words (n = 1) or pairs of words (n = 2), as segments in order; ``most`` bits at most."""
    wanted = max(SEGMENT, frequent.count() * BITS_EACH)
    bits = min(most, 1 << (wanted - 1).bit_length())

    def probe(batches):
        for batch in batches:
            words = pa.compute.split_pattern(batch.column("phrase").cast(pa.binary()), b" ")
            flat = mixed(_hashed(words.flatten()), 3).reshape(-1, n)
            lang = mixed(_hashed(batch.column("lang").cast(pa.binary())), 5)
            hashes = flat[:, 0] ^ lang
            if n == 2:
                hashes = pair_hash(hashes, flat[:, 1] ^ lang)
            place = np.unique(np.concatenate(list(places(hashes, bits))).astype(np.int64))
            yield pa.record_batch([pa.array((place // SEGMENT).astype(np.int32)), pa.array((place % SEGMENT).astype(np.int32))], names=["segment", "bit"])

    def pack(batches):
        for batch in batches:
            packed = []
            for found in batch.column("found"):
                on = np.zeros(SEGMENT, bool)
                on[found.values.to_numpy()] = True
                packed.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.record_batch([batch.column("segment"), pa.array(packed, pa.binary())], names=["segment", "bytes"])

    set_bits = frequent.select("lang", "phrase").mapInArrow(probe, "segment int, bit int").groupBy("segment").agg(F.collect_set("bit").alias("found"))
    known = {r[0]: bytes(r[1]) for r in set_bits.mapInArrow(pack, "segment int, bytes binary").collect()}
    return [known.get(s, bytes(SEGMENT // 8)) for s in range(bits // SEGMENT)]


def phrase_counts(docs: DataFrame, limit: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all words and phrases found LEAST times; and lang, n (its words)."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    all_words = cut(_passed(texts, (1,), None, limit))
    sizes = cut(all_words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = all_words.where(F.col("f") >= LEAST)
    pairs = cut(_passed(texts, (2,), build_filter(words, 1), limit))
    longer = cut(_passed(texts, (3, 4), build_filter(pairs, 2), limit))
    return words.unionByName(pairs).unionByName(longer), sizes


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, top: int = TOP, limit: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score."""
    counts, sizes = phrase_counts(docs, limit)
    words = F.split("phrase", " ", -1)
    longer = counts.withColumn("words", words).withColumn("k", F.size("words")).where("k > 1")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # The most frequent longer phrase around each phrase: two to three of its words in a row.
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: _joined(F.col("words"), s, n)))),
        lambda p: p != "",
    )
    around = longer.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = longer.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * COVERED))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), _joined(F.col("words"), F.lit(1), i).alias("left"), _joined(F.col("words"), i + 1, F.col("k") - i).alias("right")))).alias("c"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.select("lang", "phrase", "a", "c.*").join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.withColumn("a20", wide("a")).withColumn("both", wide("l") + wide("r")).withColumn("score", F.expr("(a20 * 2000000BD) div both"))
    best = cut(scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    # The first of each of some groups, then the first of those.
    groups = max(1, round((best.count() / top) ** 0.5))
    some = best.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(groups))).selectExpr("*", "row_number() OVER (PARTITION BY lang, g ORDER BY score DESC, a DESC, phrase) AS place").where(F.col("place") <= top).drop("g", "place")
    ranked = some.selectExpr("*", "cast(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS long) AS rank").where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
