"""Exact token counts by a two-tier, map-side lookup of pre-token lengths.

A text, as the sentencepiece library sees it, is a sequence of *pre-tokens* that
no merge can cross: it is cut before each run of blanks and around line feeds
and tabs, which no vocabulary piece contains.  The number of tokens of a text is
then the sum of the lengths of its pre-tokens, and a length depends only on the
pre-token's own string.

Tier one is a compact table of the lengths of the most frequent pre-tokens.  It
has ``TABLE_ROWS`` rows at most, of ``MAX_KEY`` characters at most, whatever the
input's size, so broadcasting it is safe.  Which ones it holds is settled on about
``SAMPLE_ROWS`` documents (a hash of the id chooses them; all, where there are no
more), of which each task reports ``PER_TASK`` candidates at most: the table is only a
cache, so this bounds the work and changes no count.  Tier two is each
worker's own bounded cache: misses are encoded by the library itself, once per
worker while the cache holds them.  No pre-token of the corpus is moved.

Null and empty texts have 0 tokens.  Long texts are handled whole.  Repeated rows
are counted each; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, slim

TABLE_ROWS = 50_000
PER_TASK = 4_000
SAMPLE_ROWS = 20_000
MAX_KEY = 32
CACHE_ROWS = 300_000
#: A task trims its running counts to this many whenever they exceed twice as many.
RUNNING = 100_000

# A pre-token: blanks (spaces or U+2581, which the library takes as one) and the rest
# of the word, or a single line feed or tab.
PRETOKEN = re.compile("[ ▁]+[^ ▁\n\t]*|[^ ▁\n\t]+|[\n\t]")


def load_processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def supports(processor) -> bool:
    """Whether the cuts of PRETOKEN are safe for this model: no piece crosses one."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return not any("▁" in p.lstrip("▁") or "\n" in p or "\t" in p for p in pieces)


class Lengths(dict):
    """Pre-token to number of tokens; misses are encoded and, up to a bound, kept."""

    def __init__(self, model_file: str, known: dict[str, int]):
        super().__init__(known)
        self.processor = load_processor(model_file)
        self.known = known

    def __missing__(self, piece: str) -> int:
        # "\n" keeps the library's leading blank apart from the pre-token: it adds a blank and a line feed, two tokens.
        n = 1 if piece in ("\n", "\t") else len(self.processor.encode("\n" + piece)) - 2
        if len(piece) <= 4 * MAX_KEY:
            if len(self) > CACHE_ROWS + len(self.known):
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PRETOKEN.findall(" " + text)))


def heavy_hitters(docs: DataFrame, rows: int = TABLE_ROWS, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Frequent pre-tokens of about ``sample_rows`` documents, at most ``rows``, most frequent first."""
    share = sample_rows / max(1, docs.count())
    sample = docs if share >= 1 else docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.hash("text").cast("long")), F.lit(10)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(PRETOKEN.findall(" " + text))
            if len(seen) > 2 * RUNNING:
                seen = Counter(dict(seen.most_common(RUNNING)))
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if len(k) <= MAX_KEY and n > 1]
        yield pa.record_batch([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    found = slim(sample).select("text").mapInArrow(summarise, "piece string, n long")
    top = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(rows)
    return [r.piece for r in top.collect()]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    spark = docs.sparkSession
    processor = load_processor(model_file)
    if not supports(processor):
        raise ValueError("a piece of this model crosses a blank, a tab or a line feed")
    empty = Lengths(model_file, {})
    known: Broadcast = spark.sparkContext.broadcast({p: empty[p] for p in heavy_hitters(docs, table_rows)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model_file, known.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([lengths.count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = slim(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
