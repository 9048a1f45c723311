"""Quality scores from histogram gradient-boosted trees over document statistics.

Each text is turned into ``FEATURES`` statistics of its bytes, words and lines.
The trees are grown on the driver from a bounded sample of labelled rows
(``SAMPLE_ROWS`` at most, the first by a hash of the id, so the same at any
partitioning): values are binned at the sample's quantiles, and each split is
found from histograms of gradients and curvatures.  The grown forest is flattened
into arrays (feature, threshold, left child, leaf value), a few kilobytes that
every worker gets, and scoring walks all rows of a batch through a tree at once.

Scores are probabilities that the label is 1.  Empty and null texts are scored
like any other: all their statistics are 0.  Without usable labels every score
is the prior 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, slim

SAMPLE_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.12
MIN_CURVATURE = 4.0
RIDGE = 2.0
THRESHOLD = 0.7
# Statistics, in the order of `statistics`.
FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "top_three", "repeated_pairs",
    "upper", "lower", "digits", "blanks", "stops_commas", "exclaims", "bars", "marks", "other_ascii", "high_bytes",
    "log_lines", "mean_line", "distinct_lines", "repeated_line_bytes", "caps_words", "capital_words", "byte_entropy", "run_words",
    "marked_words", "single_bytes", "digit_words",
)

_KIND = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:", 5), (b"!?", 6), (b"|/\\<>{}[]", 7), (b"#$%&*@^~=+_", 8)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 9


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=histogram, minlength=10) / n
    p = histogram[histogram > 0] / n
    words = raw.split()
    w = len(words) or 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    pairs = len(set(zip(words, words[1:])))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    lines = raw.split(b"\n")
    seen = Counter(lines)
    again = sum((c - 1) * len(x) for x, c in seen.items() if c > 1)
    caps = sum(map(bytes.isupper, words))
    titles = sum(map(bytes.istitle, words))
    marked = sum(1 for x in words if not 47 < x[-1] < 58 and not 64 < x[-1] < 91 and not 96 < x[-1] < 123 and x[-1] < 128 and x[-1] not in b".,;:")
    digit = sum(map(bytes.isdigit, words))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()), float((sizes > 12).mean()), float((sizes <= 3).mean()),
        len(counts) / w, (top[0] if top else 0) / w, sum(top) / w, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        *kinds[[1, 2, 3, 4, 5, 6, 7, 8, 0, 9]].tolist(),
        float(np.log1p(len(lines))), n / len(lines) / 100, len(seen) / len(lines), again / n, caps / w, titles / w, float(-(p * np.log2(p)).sum()), runs / w,
        marked / w, float((sizes == 1).mean()), digit / w,
    ]


@dataclass
class Forest:
    """Trees laid end to end; a leaf's feature is -1, a node's right child follows its left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Fit a forest of logistic loss to rows ``x`` and labels ``y``."""
    none = Forest(*(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.float64, np.int64)), prior=0.0)
    if not len(y):
        return none
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offsets = np.arange(x.shape[1]) * bins
    slots = binned + offsets
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, -1)
                if d < depth and total_h >= 2 * MIN_CURVATURE:
                    at = slots[rows].ravel()
                    repeat = x.shape[1]
                    hg = np.bincount(at, weights=np.repeat(g[rows], repeat), minlength=bins * repeat).reshape(repeat, bins).cumsum(axis=1)
                    hh = np.bincount(at, weights=np.repeat(h[rows], repeat), minlength=bins * repeat).reshape(repeat, bins).cumsum(axis=1)
                    rg, rh = total_g - hg, total_h - hh
                    gain = hg**2 / (hh + RIDGE) + rg**2 / (rh + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain[(hh < MIN_CURVATURE) | (rh < MIN_CURVATURE)] = 0
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = max(best, (float(gain[f, b]), int(f), int(b)))
                if best[1] < 0:
                    value[node] = float(-rate * total_g / (total_h + RIDGE))
                    margin[rows] += value[node]
                    continue
                _, f, b = best
                feature[node], threshold[node], left[node] = f, float(edges[f][b]), len(feature)
                for _side in range(2):
                    feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                right = binned[rows, f] > b
                following += [(left[node], rows[~right]), (left[node] + 1, rows[right])]
            level = following
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and y of the labelled documents, of at most ``rows`` ids: the first by a hash of the id.

    An id with several labels has their mean; labels that are null are left out.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    chosen = usable.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return slim(docs).join(F.broadcast(chosen), "doc_id")  # `rows` rows of 16 bytes


def describe(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ``more`` and x, the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *more)), x], names=["doc_id", *more, "x"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", *more, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more)) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, **growth) -> Forest:
    """Learn from ``labels`` (doc_id and ``label``, already limited to those that may be used)."""
    found = describe(labelled_sample(docs, labels, label, rows), "y").select("doc_id", "x", "y").collect()
    found.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.y for r in found]), **growth)


def quality_scores(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if the score is ``threshold`` or more) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(sent.value.probability(x))], names=["doc_id", "score"])

    return slim(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
