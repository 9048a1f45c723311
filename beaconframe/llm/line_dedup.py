"""Line deduplication by pairwise alignment of documents that share rare runs of lines.

A passage counts if it has ``MIN_WORDS`` words: it is the shortest run of lines
(blank ones left out) from a line on, or up to a line, with that many words; most
often that is one line.  Passages are hashed.  A passage's *first* holder is the
earliest document with it (least id, rows without an id last, ties by text).  Each
run of lines that a later document shares with any earlier one, and that has
``MIN_WORDS`` words or more, consists of such passages, and each of these has a
first holder; so pairing a document with the first holders of its passages finds
all of them, pairs grow with lines, and never with the square of the number of
documents that hold a line.

A document's partners are taken in the order of the rarest passage that they
share with it.  Each pair is aligned by patience: the rarest passages that occur
once in what is to be aligned are anchors, the longest chain of them that ascends
on both sides is kept, and the gaps between are aligned alike.  Aligned passages
are deleted from the later document.  What stays unaligned, such as passages
in another order or said twice, is aligned again with the rest, ``PASSES`` times;
after that each passage that is left is a block by itself.  A common passage that
a rarer partner's block has already deleted is not aligned again.

So a line goes if and only if it lies in a run of lines of ``MIN_WORDS`` words or
more that an earlier document has too.  The first holder of a passage keeps it, but for
what it shares with documents before it.

Line ends are line feeds; lines are compared without blanks at their ends.  Blank
lines stay.  Null texts stay null, and count as empty.  Rows with equal id and
text are one document: they lose the same lines.  A row is never dropped, even if
all of its lines go.  Repeats within one document stay.  An empty table gives no
rows.  A line of any length is one line; a worker holds one text and its lines at
a time.  Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, packed, slices, slim, unpacked, word_count

MIN_WORDS = 5
NO_ID = (1 << 63) - 1
PASSES = 6


def passages(words: list[int], least: int) -> set[tuple[int, int]]:
    """(from, to) of the shortest runs of ``least`` words from each line on, and up to each line."""
    out = set()
    end, total = 0, 0
    for start in range(len(words)):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        out.add((start, end))
        total -= words[start]
    start, total = 0, 0
    for end in range(len(words)):
        total += words[end]
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            out.add((start, end + 1))
    return out


def passage_keys(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_key, rank (of its first line among those that are not blank), places (of its lines in the text), key: a row for each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches):
            rows, ranks, places, keys = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                lines = [(place, found) for place, line in enumerate(text.split("\n")) if (found := line.strip())]
                for start, end in passages([len(line.split()) for _, line in lines], min_words):
                    rows.append(row)
                    ranks.append(start)
                    places.append([place for place, _ in lines[start:end]])
                    keys.append(xxh3_64_intdigest("\n".join(line for _, line in lines[start:end]).encode()))
            at = pa.array(rows, pa.int32())
            yield pa.record_batch(
                [batch.column("id").take(at), batch.column("text_key").take(at), pa.array(ranks, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(np.array(keys, np.uint64).view(np.int64))],
                names=["id", "text_key", "rank", "places", "key"],
            )

    keyed = slim(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "id long, text_key long, rank int, places array<int>, key long")


Pair = tuple[int, int, int]  # rank in the later document, rank in the earlier one, how common


def ascending(pairs: list[Pair]) -> list[Pair]:
    """The longest chain of ``pairs``, which ascend on the left, that ascends on the right too."""
    tops: list[int] = []
    cards: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, right, _) in enumerate(pairs):
        pile = bisect_left(tops, right)
        back[i] = cards[pile - 1] if pile else -1
        tops[pile : pile + 1], cards[pile : pile + 1] = [right], [i]
    chain, at = [], cards[-1] if cards else -1
    while at >= 0:
        chain.append(pairs[at])
        at = back[at]
    return chain[::-1]


def patience(pairs: list[Pair]) -> list[Pair]:
    """Pairs that ascend on both sides, anchored on the rarest that occur once, then on the rarest of each gap."""
    found, todo = [], [pairs]
    while todo:
        part = todo.pop()
        rarest, times = min(p[2] for p in part), Counter(p[1] for p in part)
        anchors = ascending([p for p in part if times[p[1]] == 1 and p[2] <= 2 * rarest] or part)
        found += anchors
        gaps = defaultdict(list)
        lefts = [a[0] for a in anchors]
        for p in part:
            gap = bisect_left(lefts, p[0])
            if (gap == len(lefts) or lefts[gap] != p[0] and p[1] < anchors[gap][1]) and (not gap or anchors[gap - 1][1] < p[1]):
                gaps[gap].append(p)
        todo += gaps.values()
    return sorted(found)


def removed_lines(shared: dict[tuple, list[tuple[int, int, int, list[int]]]]) -> tuple[list[int], int]:
    """Places of the lines that a document loses, and to how many partners; ``shared``: by partner, (rank, partner's rank, how common, places)."""
    gone: set[int] = set()
    partners = 0
    for _, pairs in sorted(shared.items(), key=lambda x: (min(p[2] for p in x[1]), x[0])):
        places = {}
        for rank, other, common, at in sorted(pairs):
            places.setdefault((rank, other, common), set()).update(at)  # passages from one line on, of two lengths, align alike
        left = [p for p in places if not places[p] <= gone]
        partners += bool(left)
        for _ in range(PASSES):
            if not left:
                break
            for p in patience(left):
                gone |= places[p]
            left = [p for p in left if not places[p] <= gone]
        for p in left:
            gone |= places[p]
    return sorted(gone), partners


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_key, rank, places, first_id, first_key, first_rank, common: each passage that an earlier document has too, with its first holder."""
    rows = cut(passage_keys(docs, min_words))
    holders = rows.groupBy("key").agg(F.min(F.struct("id", "text_key", "rank")).alias("first"), F.max(F.struct("id", "text_key")).alias("last"), F.count(F.lit(1)).alias("common"))
    several = (F.col("first.id") != F.col("last.id")) | (F.col("first.text_key") != F.col("last.text_key"))
    shared = cut(holders.where(several).select("key", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"), F.col("first.rank").alias("first_rank"), "common"))
    joined = hot_join(rows, shared, "key", "common", rows.count())
    return joined.where((F.col("id") != F.col("first_id")) | (F.col("text_key") != F.col("first_key"))).drop("key")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_key, removed (places of lines), partners: a row for each document that loses lines."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_passages(docs, min_words).repartition(tasks, "id", "text_key").sortWithinPartitions("id", "text_key")
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("removed", pa.list_(pa.int32())), ("partners", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        document, shared = None, defaultdict(list)

        def close() -> None:
            if document:
                removed, partners = removed_lines(shared)
                out.append({"id": document[0], "text_key": document[1], "removed": removed, "partners": partners})

        for batch in batches:
            for a, b, c, d, rank, first_rank, common, places in zip(*(batch.column(n).to_pylist() for n in ("id", "text_key", "first_id", "first_key", "rank", "first_rank", "common", "places"))):
                if (a, b) != document:
                    close()
                    document, shared = (a, b), defaultdict(list)
                shared[c, d].append((rank, first_rank, common, places))
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run, "id long, text_key long, removed array<int>, partners int")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (the columns of ``docs``, as they were), text (without repeated blocks of lines), removed_lines, removed_words, partners."""
    gone = deletions(docs, min_words)
    rows = packed(docs, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_key=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(gone.hint("shuffle_hash"), ["id", "text_key"], "left").withColumn("lines", F.when(F.col("removed").isNotNull(), F.split("row.text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    words = F.when(F.col("removed").isNull(), F.lit(0)).otherwise(word_count(F.col("row.text")) - word_count(text))
    return joined.select("row", text.alias("text"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed_lines"), words.cast("long").alias("removed_words"), F.coalesce("partners", F.lit(0)).alias("partners"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without repeated blocks of lines; columns as in ``docs``."""
    return without_repeats(docs, min_words).select(*unpacked(docs.columns, text=F.col("text")))
