"""Similarity digests of improbable features, compared by the overlap of Bloom filters.

A document's features are windows of ``WINDOW`` bytes.  Each window is ranked by
how rare its entropy is (windows that are nearly uniform or nearly random say
little; a fixed table orders the entropy classes).  Within each run of ``SPAN``
consecutive windows (shorter ones at a text's edges) the rarest, leftmost one
gets a point; windows with
``POINTS`` points or more are the improbable features.  Each distinct feature is
hashed to ``HASHES`` bits of a Bloom filter of ``BITS`` bits; when ``CAPACITY``
features are in a filter, the next one of the chain begins.  Two digests are
compared filter by filter: the overlap of set bits beyond what chance gives,
divided by the most possible beyond chance; each filter of the shorter digest
counts with its best match in the other, weighted by its number of features.

Entropies are sums of fixed-point table values, so equal texts have equal
digests on any machine.  A null or empty text has an empty digest; two empty
digests are alike (1.0), an empty and another one are not (0.0).  A text shorter
than a window is taken with zero bytes after it, as one window.  Repeated rows each
have their own row, next to each other.  An empty table gives no rows, and a single
row is its own next.  Texts of any length are read whole.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, slim

WINDOW = 64
SPAN = 64
POINTS = 16
BITS = 2048
CAPACITY = 160
HASHES = 5
BLOCK = 1 << 16
CLASSES = 1000

_C = np.arange(WINDOW + 1, dtype=np.float64)
#: c * log2(c) in fixed point, and its steps.
_F = np.round(_C * np.log2(np.maximum(_C, 1)) * (1 << 20)).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_F)])
_FULL = int(_F[WINDOW])


def rank_table() -> np.ndarray:
    """Rank of each entropy class: the lower, the less probable, so the better as a feature.

    Text's windows crowd around 4.2 bits of the 6 that a window can have; the
    further a class is from there, the rarer.  Classes of fewer than 1.5 bits
    (padding, rules, repeats) are never features: they get the worst rank.
    """
    bits = np.arange(CLASSES + 1) * 6.0 / CLASSES
    order = np.round(1000 - 400 * np.abs(bits - 4.2)).astype(np.int64)
    return np.where(bits < 1.5, 2000, np.maximum(order, 1))


RANKS = rank_table()
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], np.uint64)


def _entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class of the window at each position of ``data`` (WINDOW bytes at least)."""
    n = len(data)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        back[lag:] += same
        ahead[:-lag] += same
    first = int(_F[np.bincount(data[:WINDOW], minlength=1)].sum())
    step = _STEP[back[WINDOW:] + 1] - _STEP[ahead[: n - WINDOW] + 1]
    sums = np.concatenate([[first], first + np.cumsum(step)])
    return (_FULL - sums) * CLASSES // _FULL


def _points(ranks: np.ndarray) -> np.ndarray:
    """How often each window is the leftmost of the lowest rank among SPAN consecutive ones."""
    n = len(ranks)
    keys = (ranks << np.int64(32)) | np.arange(n, dtype=np.int64)
    width, least = 1, keys
    while width < SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.bincount(least & np.int64(0xFFFFFFFF), minlength=n)


def features(raws: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its distinct improbable features, in order of first appearance.

    The texts lie end to end in one array, a gap of 2 * SPAN bytes between them.
    Windows that reach into a gap have the worst rank, so a text's features do
    not depend on its neighbours, nor on the blocks the array is worked on in.
    """
    sizes = np.array([max(len(r), WINDOW) if r else 0 for r in raws], np.int64)
    starts = SPAN + np.concatenate([[0], np.cumsum(sizes + 2 * SPAN)])
    data = np.zeros(int(starts[-1]) + SPAN + WINDOW, np.uint8)
    valid = np.zeros(len(data), bool)
    for raw, at, n in zip(raws, starts.tolist(), sizes.tolist()):
        if n:
            data[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
            valid[at : at + n - WINDOW + 1] = True
    windows = len(data) - WINDOW + 1
    spots, hashes = [], []
    for start in range(0, windows, BLOCK):
        # SPAN more windows on either side, so each window's points come from all runs that hold it.
        a, b = max(0, start - SPAN), min(windows, start + BLOCK + SPAN)
        part = data[a : b + WINDOW - 1]
        ranks = np.where(valid[a:b], RANKS[_entropy_classes(part)], 4000)
        own = slice(start - a, min(windows, start + BLOCK) - a)
        chosen = np.flatnonzero((_points(ranks)[own] >= POINTS) & (ranks[own] < 2000)) + (start - a)
        spots.append(chosen + a)
        for i in range(0, len(chosen), 4096):
            at = chosen[i : i + 4096]
            hashes.append((part[at[:, None] + np.arange(WINDOW)] * _WEIGHTS).sum(axis=1, dtype=np.uint64))
    spot = np.concatenate(spots) if spots else np.empty(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    cuts = np.searchsorted(spot, starts)
    out = []
    for i, raw in enumerate(raws):
        own = hashed[cuts[i] : cuts[i + 1]]
        if not len(own):  # no window stands out: the whole text is the one feature
            own = np.frombuffer(hashlib.sha256(raw).digest()[:8], np.uint64) if raw else own
        elif len(own) > 1:
            _, first = np.unique(own, return_index=True)
            own = own[np.sort(first)]
        out.append(own)
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(raws: list[bytes]) -> list[bytes]:
    """Of each text the chain of filters, each preceded by its number of features in two bytes."""
    out = []
    for hashes in features(raws):
        if not len(hashes):
            out.append(b"")
            continue
        chain = -(-len(hashes) // CAPACITY)
        base = np.arange(len(hashes)) // CAPACITY * BITS
        bits = np.zeros(chain * BITS, np.uint8)
        mixed = _mixed(hashes, 1)
        for k in range(HASHES):
            bits[base + ((mixed >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        counts = np.bincount(base // BITS, minlength=chain).astype(">u2").view(np.uint8).reshape(chain, 2)
        out.append(np.concatenate([counts, np.packbits(bits).reshape(chain, BITS // 8)], axis=1).tobytes())
    return out


def digest(raw: bytes) -> bytes:
    return digests([raw])[0]


def _filters(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(found, np.uint8).reshape(-1, 2 + BITS // 8)
    return rows[:, 0].astype(np.int64) * 256 + rows[:, 1], np.unpackbits(rows[:, 2:], axis=1).astype(np.float32)


def likeness(a: bytes, b: bytes) -> float:
    """0 (nothing in common beyond chance) to 1 (equal, or the shorter within the longer)."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    (na, fa), (nb, fb) = _filters(a), _filters(b)
    if (len(na), int(na.sum())) > (len(nb), int(nb.sum())):
        na, fa, nb, fb = nb, fb, na, fa
    sa, sb = fa.sum(axis=1), fb.sum(axis=1)
    best = np.zeros(len(na))
    step = 512  # filters compared at once
    for i in range(0, len(na), step):
        for j in range(0, len(nb), step):
            common = fa[i : i + step] @ fb[j : j + step].T
            chance = np.outer(sa[i : i + step], sb[j : j + step]) / BITS
            most = np.minimum(sa[i : i + step, None], sb[None, j : j + step])
            score = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), 0)
            best[i : i + step] = np.maximum(best[i : i + step], score.max(axis=1))
    return float(np.round(np.clip((best * na).sum() / na.sum(), 0, 1), 6))


def printable(found: bytes) -> str:
    return base64.b64encode(found).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and digest (binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(digests([t.encode() for t in batch.column("text").to_pylist()]), pa.binary())], names=["doc_id", "digest"])

    return slim(docs).mapInArrow(run, "doc_id long, digest binary")


def task_numbers(spark: SparkSession, tasks: int) -> list[int]:
    """For each partition of ``repartition(tasks, number)`` an int that goes there."""
    dealt = spark.range(24 * tasks + 200).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("task"))
    found = {r.task: r.x for r in dealt.groupBy("task").agg(F.min("x").alias("x")).collect()}  # `tasks` rows
    return [found.get(t, t) for t in range(tasks)]


def smaller(cuts: list[float], place: Column) -> Column:
    """How many of the descending ``cuts`` are above ``place``, in about the root of their number of comparisons."""
    step = max(1, math.isqrt(len(cuts)))
    above = lambda array: F.size(F.filter(array, lambda c: c > place))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    whole = cuts[step - 1 :: step]
    full = above(literal(whole)) * step if whole else F.lit(0)
    return full + above(F.slice(literal(cuts), full + 1, F.lit(step)))


def with_next(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, text and next_text: that of the next row by descending doc_id; the last row's is the first's.

    Null ids come last, and rows of one id by xxhash64 of their text, the largest first.  One shuffle of the texts, by ranges, one a task.  A range's last row
    needs the first row of the range below, so that row is sent to both; there are
    only as many of those as ranges.  Rows of a range are streamed in order.
    """
    spark = docs.sparkSession
    whole = slim(docs)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text_hash = F.xxhash64("text")
    # Rows without an id are spread over places of their own, below all ids.
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-2e19) + text_hash.cast("double"))
    placed = whole.withColumn("hash", text_hash).withColumn("place", place)
    cuts = sorted(set(placed.approxQuantile("place", [i / tasks for i in range(1, tasks)], 0.2 / tasks)), reverse=True) if tasks > 1 else []
    # Range r holds places below cuts[r - 1] and not below cuts[r]; equal places share a range.
    ranged = placed.withColumn("range", smaller(cuts, F.col("place")).cast("int") if cuts else F.lit(0))
    order = F.struct("place", F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")
    heads = {r.range: r.head for r in ranged.groupBy("range").agg(F.max(order).alias("head")).collect()}  # a row for each range
    if not heads:
        return whole.withColumn("next_text", F.col("text"))
    firsts = sorted(heads)
    above = {r: firsts[i - 1] for i, r in enumerate(firsts)}  # the range before; the first's is the last
    names = task_numbers(spark, tasks)
    by_range = lambda values, r: F.element_at(F.array(*[F.lit(values[k]) if k in values else F.lit(None) for k in range(firsts[-1] + 1)]), r + 1)
    head = F.struct(*[by_range({r: h[i] for r, h in heads.items()}, F.col("range")).cast(t) for i, t in enumerate(("double", "long", "long"))])
    is_head = order == head
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(by_range(above, F.col("range")).alias("range"), F.lit(1).alias("guest"))
    copies = ranged.withColumn("to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    named = by_range(dict(enumerate(names)), F.col("to.range"))
    dealt = copies.select(F.col("to.range").alias("range"), F.col("to.guest").alias("guest"), named.alias("task"), "place", "hash", "doc_id", "text").repartition(tasks, "task").sortWithinPartitions("range", "guest", F.desc("place"), F.desc("doc_id"), F.desc("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("next_text", pa.string())])
        held = None  # (range, doc_id, text)
        closed = None
        out, size = [], 0
        for batch in slices(batches):
            for r, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))):
                if held is not None and held[0] == r and closed != r:
                    out.append({"doc_id": held[1], "text": held[2], "next_text": text})
                    size += len(text) + len(held[2])
                if guest:
                    closed, held = r, None
                else:
                    held = (r, doc_id, text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run, "doc_id long, text string, next_text string")


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_neighbours(pairs: DataFrame) -> DataFrame:
    """For rows of ``with_next``: digests of the text, its edited form and the next text, and their likeness."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, others = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
            raws = [edited(t, o).encode() for t, o in zip(texts, others)]
            distinct = list(dict.fromkeys([*texts, *others]))  # a row's next text is mostly the next row's text
            known = dict(zip(distinct, digests([t.encode() for t in distinct])))
            rows = []
            for doc_id, text, other, raw, new in zip(ids, texts, others, raws, digests(raws)):
                own, following = known[text], known[other]
                rows.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), printable(own), printable(new), likeness(own, new), likeness(own, following)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return pairs.mapInArrow(run, schema)
