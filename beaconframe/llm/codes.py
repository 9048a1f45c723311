"""Compressing vectors to short codes: one codebook for each of eight parts, searched by partial distances.

Components become integers, floor(4096 * x).  Each part's codebook starts as the
first vectors of the table; in each round every part goes to its nearest entry
and every entry to the floor of its parts' mean.  All arithmetic is on integers
and exact: where 64 bits could overflow, Python's integers take over, and sums
travel as 32-bit limbs, which Spark adds up.

The search takes dimensions in the order of the codebook's variance, largest
first.  The entry nearest in the first dimensions gives a complete distance; an
entry is dropped once what it has summed up strictly exceeds that, so entries at
the same distance stay and the lowest index wins.

A round is one pass over the table: a task adds up its own rows, so what is
shuffled, and what the driver reads, is one codebook's worth of numbers a task.

Rows whose vector is null, empty, or holds null or non-finite components are
dropped, and so are vectors of another length than the most common one that
divides into eight parts (the shortest of equally common ones).  Null ids come
last in the choice of first entries; equal ids are taken in the order of their
vectors; repeated rows are rows like any other.  With fewer than 16 rows the
codebook has as many entries as there are rows.  An empty table gives no rows.
Errors beyond 64 bits are given as the largest long.  Columns other than vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, ship

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Dimensions that are summed up for all entries before any is dropped.
FIRST = 2
#: Rows searched at once.
BLOCK = 8_192
LIMB = 32
LARGEST = (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Whether a vector has components, and only finite ones."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Sound vectors of one length as doubles, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers where all fit, else as Python's."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _wide(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers if no squared distance between their rows can overflow, else as Python's."""
    if any(a.dtype == object for a in arrays) or arrays[0].shape[1] * (2 * max(int(np.abs(a).max(initial=0)) for a in arrays)) ** 2 > LARGEST:
        return [a.astype(object) for a in arrays]
    return list(arrays)


def by_variance(book: np.ndarray) -> np.ndarray:
    """The book's dimensions by the variance of its entries, largest first, then by place."""
    exact = book.astype(object)
    spread = len(exact) * (exact * exact).sum(0) - exact.sum(0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of the nearest entry, the lowest of equally near ones, and its squared distance."""
    order = by_variance(book)
    points, book = _wide(points[:, order], book[:, order])
    every = np.arange(len(points))
    part = ((points[:, None, :FIRST] - book[None, :, :FIRST]) ** 2).sum(2)
    guess = part.argmin(1)
    best = part[every, guess] + ((points[:, FIRST:] - book[guess, FIRST:]) ** 2).sum(1)
    row, entry = np.nonzero((part <= best[:, None]).astype(bool))
    so_far = part[row, entry]
    for j in range(FIRST, points.shape[1]):
        so_far = so_far + (points[row, j] - book[entry, j]) ** 2
        alive = (so_far <= best[row]).astype(bool)
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    least = np.minimum.reduceat(so_far, np.searchsorted(row, every)) if len(every) else best
    winners = np.flatnonzero((so_far == least[row]).astype(bool))[::-1]
    code = np.zeros(len(points), np.int64)
    code[row[winners]] = entry[winners]
    return code, least


def _parts(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of the batch's rows and their integers, (row, part, position)."""
    for start in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(start, BLOCK)
        yield rows, integers(matrix(rows.column("embedding"), dim)).reshape(rows.num_rows, PARTS, dim // PARTS)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value in digits to the base 2**32, the last of which has the sign."""
    at = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield at, value & (1 << LIMB) - 1
        at, value = at + 1, value >> LIMB
    yield at, value


def _moved(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    schema = "part int, entry int, pos int, limb int, value long"

    def sums(batches):
        shape = (PARTS, len(books[0]), dim // PARTS + 1)  # the last place counts
        total = np.zeros(shape, object)
        for batch in batches:
            for _, points in _parts(batch, dim):
                small = points.dtype != object and int(np.abs(points).max(initial=0)) * len(points) <= LARGEST
                here = np.zeros(shape, np.int64 if small else object)
                for p in range(PARTS):
                    code, _ = nearest(points[:, p], books[p])
                    np.add.at(here[p, :, :-1], code, points[:, p])
                    here[p, :, -1] = np.bincount(code, minlength=shape[1])
                total = total + here
        found = [(*where, *limb) for where, value in np.ndenumerate(total) if value for limb in _limbs(int(value))]
        if found:
            yield pa.record_batch([pa.array(c, pa.int32() if i < 4 else pa.int64()) for i, c in enumerate(zip(*found))], names=["part", "entry", "pos", "limb", "value"])

    sums_by_place: dict[tuple[int, int, int], int] = {}
    for p, e, pos, limb, value in rows.select("embedding").mapInArrow(sums, schema).groupBy("part", "entry", "pos", "limb").agg(F.sum("value")).collect():
        sums_by_place[p, e, pos] = sums_by_place.get((p, e, pos), 0) + (value << LIMB * limb)
    new = []
    for p, book in enumerate(books):
        moved = book.astype(object)
        for e in range(len(book)):
            if n := sums_by_place.get((p, e, dim // PARTS), 0):
                moved[e] = [sums_by_place.get((p, e, j), 0) // n for j in range(dim // PARTS)]
        new.append(_narrow(moved))
    return new


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) <= LARGEST for v in book.ravel().tolist()) else book


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray], int]:
    """The rows that are kept, the codebooks (entry, position) of the parts, and the vectors' length (0 without any)."""
    ship(vectors.sparkSession)
    size = F.size("embedding")
    whole = vectors.select("vec_id", "embedding", "label").where(sound(F.col("embedding")) & (size % PARTS == 0))
    common = whole.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common:
        return whole.limit(0), [], 0
    dim = common[0]["dim"]
    kept = whole.where(size == dim)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    start = integers(np.array([r[0] for r in first], np.float64)).reshape(len(first), PARTS, dim // PARTS)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds):
        books = _moved(kept, books, dim)
    return kept, books, dim


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encoded(kept: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error for each kept row."""
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    digits = np.array([f"{i:02x}" for i in range(len(books[0]) if books else 0)])

    def run(batches):
        for batch in batches:
            for rows, points in _parts(batch, dim):
                text, error = np.full(len(points), "", "U2"), np.zeros(len(points), object)
                for p in range(PARTS):
                    code, far = nearest(points[:, p], books[p])
                    text = np.char.add(text, digits[code])
                    error = error + far
                yield pa.record_batch([rows.column("vec_id"), rows.column("label"), pa.array(text.tolist(), pa.string()), pa.array([min(int(e), LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, schema)


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row of ``vectors`` (vec_id, embedding, label).

    ``vectors`` is read once a round: hand over a table rather than a long computation.
    """
    kept, books, dim = fit(vectors)
    name = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("none"))
    rows = cut(encoded(kept, books, dim).select("vec_id", "code", "error", name.alias("group")))
    groups = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error")))
    total = groups.agg(F.sum("n")).collect()[0][0] or 0
    return hot_join(rows, groups, "group", "n", total).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
