"""Near copies among vectors: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

Equal vectors form a class, and only one of each class is compared.  In each
table a vector's bucket is the signs of its products with that table's
hyperplanes.  A bucket holds about ``FILL`` unlike vectors, whatever the number
of rows; the number of tables follows from the recall wanted at the threshold.
Within a bucket every pair is compared in double precision; sums that come close
to the threshold are added up again without rounding.  A pair counts in the first
table whose bucket it shares, which both hash codes tell, so links are counted
where they are found and no pair is ever written out.  What leaves a bucket is,
for each vector with links, their number and one edge that keeps the bucket's
components together.

A bucket of more than ``BLOCK`` vectors is compared as pairs of blocks, so a
large group of near copies is spread over many tasks; it costs comparisons in
proportion to its square, since each of its vectors has that many links.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do vectors of different lengths.  Repeated rows and equal
vectors link with each other.  component_id is the least id of a component, null
if none of its vectors has one; a null id is kept only there.  An empty table
gives no rows.  Columns other than vec_id and embedding are not read.  Vectors
are known as equal by 128 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import sound
from .common import cut, hot_join, ship
from .graph import components

COSINE = 0.95
#: Chance that a pair at the threshold shares a bucket.
RECALL = 0.9999
FILL = 16
BLOCK = 1_000
#: Sums this close to the threshold are added up exactly.
CLOSE = 1e-9
SEED = 20
#: Large buckets are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Pairs looked at together.
PAIRS = 200_000


def shape(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes a table, and tables, for so many different vectors."""
    bits = min(max(round(math.log2(max(vectors, 1) / FILL)), 6), 40)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine with each of its three sums rounded once."""
    a, b = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (a, b))
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def _kind(classes: DataFrame) -> str:
    """Vectors of floats travel as floats, all others as doubles."""
    return "f4" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"


def coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, copies, dim, codes (one long a table), vector (its components as bytes)."""
    kind = _kind(classes)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                sizes = pa.compute.list_value_length(rows.column("embedding")).to_numpy()
                for dim in np.unique(sizes).tolist():
                    own = rows.filter(pa.array(sizes == dim))
                    x = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    if dim not in planes:
                        planes[dim] = np.random.default_rng(SEED).standard_normal((dim, bits * tables))
                    signs = (unit(x) @ planes[dim] > 0).reshape(len(x), tables, bits)
                    codes = signs @ (1 << np.arange(bits, dtype=np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
                    yield pa.record_batch([own.column("node"), own.column("copies"), pa.array(np.full(len(x), dim), pa.int32()), lists, pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["node", "copies", "dim", "codes", "vector"])

    return classes.select("node", "copies", "embedding").mapInArrow(run, "node long, copies long, dim int, codes array<long>, vector binary")


def _linked(a: np.ndarray, b: np.ndarray, codes_a: np.ndarray, codes_b: np.ndarray, table: int, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` that are alike and share no bucket of an earlier table; each pair once where both are the same rows."""
    ua, ub = unit(a), unit(b)
    step = max(1, PAIRS // len(b))
    for start in range(0, len(a), step):
        cos = ua[start : start + step] @ ub.T
        i, j = np.nonzero(cos >= cosine - CLOSE)
        value, i = cos[i, j], i + start
        sure = value >= cosine + CLOSE
        for k in np.flatnonzero(~sure).tolist():
            sure[k] = exact_cosine(a[i[k]], b[j[k]]) >= cosine
        if same:
            sure &= i < j
        i, j = i[sure], j[sure]
        new = ~(codes_a[i, :table] == codes_b[j, :table]).any(1)
        yield i[new], j[new]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is connected with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(dealt: DataFrame, kind: str, cosine: float) -> DataFrame:
    """node, other (a node of its component, itself if none is smaller), links, for nodes with links in a task's bucket or block pair."""

    def close(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        table, dim = rows.column("t")[0].as_py(), rows.column("dim")[0].as_py()
        node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).astype(np.float64).reshape(-1, dim)
        codes = rows.column("codes").flatten().to_numpy().reshape(len(node), -1)
        left, right = (np.arange(len(node)),) * 2 if side[0] == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if len(left) < 1 or len(right) < 1 or len(node) < 2:
            return None
        found = [(left[i], right[j]) for i, j in _linked(x[left], x[right], codes[left], codes[right], table, side[0] == 2, cosine)]
        i, j = (np.concatenate(c) for c in zip(*found))
        if not len(i):
            return None
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        with_links = np.flatnonzero(links)
        return pa.record_batch([pa.array(node[with_links]), pa.array(node[_labels(len(node), i, j)[with_links]]), pa.array(links[with_links])], names=["node", "other", "links"])

    def run(batches):
        group: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("task", "t", "dim")])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(bounds, bounds[1:]):
                key = tuple(keys[:, start].tolist())
                if key != now and group:
                    if (found := close(group)) is not None:
                        yield found
                    group = []
                now = key
                group.append(batch.slice(start, end - start))
        if group and (found := close(group)) is not None:
            yield found

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "task").sortWithinPartitions("task", "t", "dim").mapInArrow(run, "node long, other long, links long")


def links(classes: DataFrame, vectors: int, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """node, other, links: see `_compared`; for classes (node, copies, embedding) of different vectors."""
    codes = cut(coded(classes, *shape(vectors, cosine, recall)))
    placed = codes.select("node", "copies", "dim", "codes", "vector", F.posexplode("codes").alias("t", "code")).withColumn("bucket", F.xxhash64("dim", "t", "code")).drop("code")
    large = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    few = large.count() <= BROADCAST_BUCKETS
    known = placed.join(F.broadcast(large) if few else large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j"), F.when(b == F.col("own"), 2).when(F.col("own") < b, 0).otherwise(1).alias("side")),
    )
    dealt = known.withColumn("own", own).withColumn("p", F.explode(pairs)).select(F.xxhash64("bucket", "p.i", "p.j").alias("task"), "t", "dim", F.col("p.side").alias("side"), "node", "copies", "codes", "vector")
    return _compared(dealt, _kind(classes), cosine)


def near_copies(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    usable = sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    keys = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(SEED), "embedding").alias("h2")]
    rows = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where("embedding is not null").select("vec_id", "embedding", *keys)
    grouped = good.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    n, total = classes.agg(F.count(F.lit(1)), F.sum("copies")).collect()[0]
    found = cut(links(classes, n, cosine, recall))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("node", "h1", "h2", "copies", "least").join(counted, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed)
    tops = cut(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    named = hot_join(placed, tops, "component", "nodes", n)
    about = cut(named.select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    done = hot_join(good.drop("embedding"), about, ["h1", "h2"], "copies", total or 0).select("vec_id", "n_links", "component_id")
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
