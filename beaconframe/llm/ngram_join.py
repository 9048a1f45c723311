"""Similarity join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

A document's set holds the hashes of its runs of ``WORDS`` lower-cased words; a
text with fewer words has one, of all of them; one without words has the empty
set, which only equals other empty ones (their similarity counts as 1).
Documents with equal sets form a class, and only one of each class is joined.

Candidates come from a recursion on minhash tokens (position, value): in each
run a node splits its sets on positions sampled for it, 1 / SIMILARITY of them in
expectation, so that a pair at the threshold keeps one common child in
expectation at each level.  Which positions a node samples depends on the run
and on the positions above it, so each record can work out its own paths.  Nodes
are counted at the ``LEVELS``.  One with ``SMALL`` records or fewer is compared by
brute force, on sketches with a margin; a larger one is split down to the next of
the levels; at the last of them all of a large node's records become candidates
of one another.  The number of runs follows from the recall wanted at the last
level, so pairs that meet earlier only add to it.

Candidates are linked to clusters, and within each cluster *every* pair is
compared exactly on the full sets, once: small clusters in one task, large ones
as pairs of blocks of bounded size, so no task and no row holds an unbounded
group, and pairs of documents are counted where they are compared, never written
out.  A large cluster of documents that are all alike still costs comparisons in
proportion to its square, since each has that many links to count.

Null texts count as empty.  Null ids are kept; a class's id is the least id in
it, null if it has none.  Repeated rows are copies of each other.  An empty table
gives no rows.  A text of any length is one set.  Other columns are kept as they are
by `one_of_each`, whatever their names, and not read.  Sets are known by 128 bits,
records in the graph by 64: two of n different sets share a record's number with a
chance of n**2 / 2**65 (one in 4 at 3 billion sets), and would then count as linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, packed, slices, slim, unpacked
from .graph import components

WORDS = 5
SIMILARITY = 0.8
HASHES = 128
RECALL = 0.997
LEVELS = (1, 3)
SMALL = 128
#: Candidates' sketches may fall short of the similarity by this much: four standard deviations.
MARGIN = 0.14
BLOCK_SETS = 1_000
BLOCK_SHINGLES = 2_000_000
CACHE_WORDS = 400_000
NO_ID = -(1 << 63)

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * _GOLD & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        split = [t.lower().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in {w for s in split for w in s} - self.known.keys():
            self.known[w] = xxh3_64_intdigest(w.encode())
        out = []
        for s in split:
            ids = np.fromiter(map(self.known.__getitem__, s), np.uint64, len(s))
            if len(ids):
                n = min(self.words, len(ids))
                h = np.zeros(len(ids) - n + 1, np.uint64)
                for i in range(n):
                    h = mixed(h ^ ids[i : len(ids) - n + 1 + i], i + 1)
                ids = np.unique(h)
            out.append(ids)
        return out


_A = np.array([int.from_bytes(hashlib.sha256(b"a%d" % i).digest()[:8], "little") | 1 for i in range(HASHES)], np.uint64)
_B = np.array([int.from_bytes(hashlib.sha256(b"b%d" % i).digest()[:8], "little") for i in range(HASHES)], np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima."""
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, set_key (16 bytes), size and minima of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            found = shingler(batch.column("text").to_pylist())
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in found], pa.binary()),
                    pa.array([len(s) for s in found], pa.int64()), pa.array([minhashes(s).tobytes() if len(s) else b"" for s in found], pa.binary()),
                ],
                names=["doc_id", "text_key", "set_key", "size", "minima"],
            )

    keyed = slim(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, set_key binary, size long, minima binary")


def survival(depth: int) -> float:
    """Chance that a pair at the threshold shares a node at ``depth`` in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int = LEVELS[-1]) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def sampled(run: int, above: tuple[int, ...], similarity: float = SIMILARITY) -> list[int]:
    """The positions that a node splits on: each with chance 1 / (similarity * HASHES), one at least for a run's root."""
    for attempt in range(100):
        seed = hashlib.sha256(repr((run, above, attempt)).encode()).digest()
        draw = np.random.default_rng(int.from_bytes(seed[:8], "little")).random(HASHES)
        found = [int(i) for i in np.flatnonzero(draw < 1 / (similarity * HASHES)) if i not in above]
        if found or above:
            return found
    return [run % HASHES]


def paths(depth: int, runs: int, similarity: float = SIMILARITY) -> list[tuple[int, tuple[int, ...]]]:
    """All (run, positions) of this depth."""
    now: list[tuple[int, tuple[int, ...]]] = [(r, ()) for r in range(runs)]
    for _ in range(depth):
        now = [(r, (*above, i)) for r, above in now for i in sampled(r, above, similarity)]
    return now


def node_keys(minima: np.ndarray, path: tuple[int, tuple[int, ...]]) -> np.ndarray:
    run, positions = path
    key = np.full(len(minima), run + 1, np.uint64)
    for i in positions:
        key = mixed(key ^ minima[:, i].astype(np.uint64), i + 1)
    return key.view(np.int64)


def nodes_at(records: DataFrame, depth: int, split_at: int, runs: int, similarity: float) -> DataFrame:
    """rid, path (its number among those of this depth) and key of each record's nodes.

    With ``split_at`` 0 the records are all split from the root on; else
    ``records`` has a row for each node of that depth to split: rid, path, minima.
    """
    here = paths(depth, runs, similarity)
    above = {p: i for i, p in enumerate(paths(split_at, runs, similarity))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy()
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), "<u4").reshape(-1, HASHES)
            parent = batch.column("path").to_numpy() if split_at else None
            for j, path in enumerate(here):
                if parent is None:
                    rows = slice(None)
                else:
                    rows = np.flatnonzero(parent == above[path[0], path[1][:split_at]])
                ids = rid[rows]
                if len(ids):
                    yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), j, np.int32)), pa.array(node_keys(minima[rows], path))], names=["rid", "path", "key"])

    return records.mapInArrow(run, "rid long, path int, key long")


def sketch_matches(rids: np.ndarray, sketches: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Pairs of rids that connect all records which are alike, directly or through others; not all pairs."""
    edges, label = [], list(range(len(rids)))
    for j in range(1, len(rids)):
        alike = np.flatnonzero((sketches[:j] == sketches[j]).sum(axis=1) >= need).tolist()
        for i in alike:
            if label[i] != label[j]:
                edges.append((int(rids[i]), int(rids[j])))
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
    return edges


def bucket_edges(members: DataFrame, similarity: float) -> DataFrame:
    """Edges within each key of ``members`` (key, rid, minima), which has SMALL rows of a key at most."""
    need = math.floor((similarity - MARGIN) * HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rids, rows = None, [], []
        out: list[tuple[int, int]] = []
        pairs: list[tuple[int, int]] = []
        seen: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if len(rids) == 2:  # the most frequent case, compared in one go below
                pairs.append((rids[0], rids[1]))
                seen.append((rows[0], rows[1]))
            elif len(rids) > 2:
                out.extend(sketch_matches(np.array(rids), np.frombuffer(b"".join(rows), "<u4").reshape(-1, HASHES), need))

        def flush() -> pa.RecordBatch:
            if pairs:
                a, b = (np.frombuffer(b"".join(s[i] for s in seen), "<u4").reshape(-1, HASHES) for i in (0, 1))
                out.extend(pairs[i] for i in np.flatnonzero((a == b).sum(axis=1) >= need).tolist())
            found = set(out)
            batch = pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
            out.clear(), pairs.clear(), seen.clear()
            return batch

        for batch in batches:
            for k, rid, row in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "minima"))):
                if k != key:
                    close()
                    key, rids, rows = k, [], []
                rids.append(rid)
                rows.append(row)
            if len(out) + len(pairs) > 20_000:
                yield flush()
        close()
        yield flush()

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def candidate_edges(records: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Edges a, b between records (rid, minima) that may be alike; they connect all that are."""
    runs = runs_for(recall, levels[-1])
    split, found = records, []
    for above, level in zip((0, *levels), levels):
        nodes = nodes_at(split, level, above, runs, similarity)
        counts = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first")).where("n > 1")
        shared = cut(nodes.join(counts, "key"))
        small = shared.where(F.col("n") <= SMALL).select("key", "rid").join(records.select("rid", "minima"), "rid")
        found.append(bucket_edges(small.select("key", "rid", "minima"), similarity))
        large = shared.where(F.col("n") > SMALL)
        if level == levels[-1]:
            found.append(large.where("rid <> first").select(F.col("rid").alias("a"), F.col("first").alias("b")))
        elif large.isEmpty():
            break
        else:
            split = large.select("rid", "path").join(records.select("rid", "minima"), "rid").select("rid", "path", "minima")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


# ---------------------------------------------------------------- exact comparison


def alike(a: int, b: int, common, similarity: float = SIMILARITY):
    """Whether common / (a + b - common) reaches the similarity, in whole numbers of ten-thousandths."""
    s = round(similarity * 10_000)
    return common * 10_000 >= s * (a + b - common)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    every, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, 16_000_000 // (len(left) + len(right)))  # columns held at once
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for start in range(0, len(every), step):
        a, b = np.searchsorted(at, [start, start + step])
        block = np.zeros((len(sizes), min(step, len(every) - start)), np.float32)
        block[row[a:b], at[a:b] - start] = 1
        out += np.rint(block[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return out


def exact_links(members: DataFrame, similarity: float, words: int) -> DataFrame:
    """For each record of a task: how many records and documents it is alike with there; and pairs that connect them.

    ``members``: task (a cluster's or a pair of blocks' number), side (0 or 1 of
    a pair of different blocks, 2 where all pairs of the task count), set_key,
    copies, text.
    """
    schema = "set_key binary, other binary, links long, documents long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        task, group = None, []

        def close() -> pa.RecordBatch | None:
            held: dict[tuple[int, bytes], dict] = {(r["side"], r["set_key"]): r for r in group}  # equal rows once
            rows = sorted(held.values(), key=lambda r: (r["side"], r["set_key"]))
            left = [r for r in rows if r["side"] != 1]
            right = [r for r in rows if r["side"] == 1] or left
            if len(rows) < 2 or left is not right and not left:
                return None
            a = shingler([r["text"] for r in left])
            b = a if right is left else shingler([r["text"] for r in right])
            na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
            yes = alike(na[:, None], nb[None, :], common_counts(a, b), similarity)
            if right is left:
                np.fill_diagonal(yes, False)
            copies = [np.array([r["copies"] for r in x], np.int64) for x in (left, right)]
            out = [(r["set_key"], None, int(n), int(d)) for r, n, d in zip(left, yes.sum(axis=1), yes @ copies[1]) if n]
            if right is not left:
                out += [(r["set_key"], None, int(n), int(d)) for r, n, d in zip(right, yes.sum(axis=0), copies[0] @ yes) if n]
            everyone = left if right is left else left + right
            offset = 0 if right is left else len(left)
            label = list(range(len(everyone)))
            for i in range(len(left)):
                for j in np.flatnonzero(yes[i]).tolist():
                    j += offset
                    if label[i] != label[j]:
                        out.append((everyone[i]["set_key"], everyone[j]["set_key"], 0, 0))
                        old, new = label[j], label[i]
                        label = [new if x == old else x for x in label]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["set_key", "other", "links", "documents"]) if out else None

        for batch in slices(batches):
            for r in batch.to_pylist():
                if r["task"] != task:
                    if group and (found := close()) is not None:
                        yield found
                    task, group = r["task"], []
                group.append(r)
        if group and (found := close()) is not None:
            yield found

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(run, schema)


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, class_id, n_links, n_copies, size for each row of ``docs``.

    class_id: the least id among all documents linked to it directly or through
    others; n_links: how many other documents are alike, copies included;
    n_copies: how many documents have its very set, itself included.
    """
    found = cut(sets(docs, words))
    ids = F.coalesce("doc_id", F.lit(NO_ID))
    rid = F.xxhash64("set_key")
    classes = cut(
        found.groupBy("set_key", "size")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(ids.alias("id"), "text_key", "minima")).alias("m"), F.min("doc_id").alias("least"))
        .select("set_key", rid.alias("rid"), "size", "copies", "least", F.col("m.id").alias("id"), F.col("m.text_key").alias("text_key"), F.col("m.minima").alias("minima"))
    )
    clusters = components(candidate_edges(classes.where("size > 0").select("rid", "minima"), similarity, recall))
    placed = classes.drop("minima").join(clusters, classes.rid == clusters.node).drop("node")
    shape = placed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = cut(placed.join(shape, "component"))
    # The text of one document of each class; only its own row has both the id and the text's key.
    texts = slim(docs).select(ids.alias("id"), F.xxhash64("text").alias("text_key"), "text")
    members = texts.join(placed.select("component", "blocks", "set_key", "copies", "id", "text_key").hint("shuffle_hash"), ["id", "text_key"])
    own = F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("blocks")).cast("int")
    member = members.withColumn("own", own)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j"), F.when(b == F.col("own"), 2).when(F.col("own") < b, 0).otherwise(1).alias("side")),
    )
    dealt = member.withColumn("p", F.explode(pairs)).select(F.xxhash64("component", "p.i", "p.j").alias("task"), F.col("p.side").alias("side"), "set_key", "copies", "text")
    links = cut(exact_links(dealt, similarity, words))
    joined = components(links.where("other is not null").select(F.xxhash64("set_key").alias("a"), F.xxhash64("other").alias("b")))
    counted = links.where("other is null").groupBy("set_key").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    linked = classes.select("set_key", "rid", "least").join(joined, F.col("rid") == F.col("node")).select("set_key", "component", "least")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("set_key", "class_id").join(counted, "set_key")
    about = classes.select("set_key", "copies", "least").join(named, "set_key", "left").select("set_key", "copies", F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return hot_join(found.drop("minima"), cut(about), "set_key", "copies", found.count()).select("doc_id", "text_key", "class_id", "n_links", F.col("copies").alias("n_copies"), "size", "set_key")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each class the row with the least id stays; columns as in ``docs``.

    Rows without any id are told apart by text; of equal rows one stays.
    """
    ids = F.coalesce("doc_id", F.lit(NO_ID))
    groups = similar_documents(docs, similarity, words, recall)
    # Classes without an id have none in common but their set.
    name = F.when(F.col("class_id").isNull(), F.col("set_key"))
    best = F.min(F.struct(F.when(F.col("doc_id") == F.col("class_id"), 0).otherwise(1).alias("other"), ids.alias("id"), "text_key"))
    kept = groups.groupBy("class_id", name.alias("name")).agg(best.alias("m")).select("m.id", "m.text_key")
    rows = packed(docs, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_key=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return rows.join(kept, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select(*unpacked(docs.columns))
