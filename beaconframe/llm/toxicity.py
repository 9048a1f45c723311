"""Toxicity scores of deobfuscated text.

Words that look written around a filter are restored by a noisy-channel model
before they are scored.  Each character of a suspicious token opens arcs of a
lattice:

- leetspeak: a digit or sign, or a letter of another script, may stand for the Latin letters it resembles;
- repetition: a letter that repeats the one before may be dropped;
- spacing: a sign between letters may be dropped or part two words.  Runs of
  single characters become one token, in which two words may be parted before any
  letter; of two neighbouring short words the blank may be dropped.

The Viterbi path with the least cost under the channel and a character trigram
model of all documents is the restored text.  A token of any length is decoded in
one go: there is a state for each pair of last symbols, and the ``STATES``
cheapest ones go on from each character; paths share what they have in common.

Features are restored words and their beginnings (``PREFIXES`` characters).
Which of them tell toxic from other documents is counted over a bounded sample
of labelled rows (``SAMPLE_ROWS`` at most, the first by a hash of the id); the
``KEEP`` most telling ones get weights by ridge logistic regression, and a
document's score is the probability from how many of its distinct tokens carry
each feature.  The trigram counts cover all documents; they and the weights are
small tables of a fixed size, which every worker gets.

Null and empty texts, and any without a telling feature, get the score of a text
without evidence, which is low.  Without usable labels every score is 0.  Repeated
rows are scored each; equal texts have equal scores.  Labels without a document,
null labels and several labels of one document are the sample's business (see
``quality.labelled_sample``).  An empty table gives no rows.  Long texts are read
whole, a slice of a batch at a time.  Other columns are not read; `kept` keeps
them, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, slim
from .quality import labelled_sample

SAMPLE_ROWS = 20_000
KEEP = 400
PREFIXES = (3, 4, 5, 6, 7, 8)
MIN_TOXIC = 3
RIDGE = 1.0
THRESHOLD = 0.5
CACHE_TOKENS = 400_000
#: The beam: how many states go on from each character, the cheapest ones.
STATES = 48
#: Longer tokens are decoded anew each time.
CACHED_CHARS = 96
#: Neighbouring words of which one has SHORT letters at most and the other one more at most are also read without the blank.
SHORT = 3

# The letters that digits and signs resemble.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "[": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "*": "aeiou", "#": "h", "%": "o", "&": "a",
}
# Letters of other scripts and the Latin ones that they look like.
ALIKE = {"а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
#: Costs of the channel, in nats.
ALIKE_COST, BREAK_LETTER, BREAK_FIRST, JOIN = 0.5, 0.0, 9.0, 2.5
SUBSTITUTE, STAR, DROP_SIGN, DROP_DIGIT, REPEAT, REPEAT_MORE, BREAK_SIGN, BREAK_DIGIT = 0.7, 2.5, 1.0, 9.0, 1.5, 0.1, 3.0, 3.5

SYMBOLS = 28  # 0: no letter, 1-26: a-z without accents, 27: another letter
# Accented letters and the plain ones they count as.
ACCENTS = {"àáâãäå": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ñ": "n", "òóôõöø": "o", "ùúûü": "u", "ýÿ": "y", "ß": "s"}


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[[ord(c), ord(c.upper())]] = i + 1
    for accented, plain in ACCENTS.items():
        for c in accented:
            table[ord(c)] = ord(plain) - 96
            if len(c.upper()) == 1 and ord(c.upper()) < 256:
                table[ord(c.upper())] = ord(plain) - 96
    for c in map(chr, range(192, 256)):
        if c.isalpha() and not table[ord(c)]:
            table[ord(c)] = 27
    return table


TABLE = _symbol_table()


def symbol(c: str) -> int:
    return int(TABLE[ord(c)]) if ord(c) < 256 else 27 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the SYMBOLS**3 character trigrams over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            text = "  ".join(batch.column("text").to_pylist())
            codes = TABLE[np.frombuffer(f"  {text}  ".encode("latin-1", "replace"), np.uint8)]
            total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["code", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in slim(docs).select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SYMBOLS**3 rows at most
        counts[row.code] = row.n
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Cost in nats of a symbol after two others, smoothed by the shorter contexts."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 0.5) / (c1 + 0.5).sum()
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


SPACED = re.compile(r"(?<![^\s(\[{\"'])\S(?:[ .\-_*]\S){2,}(?=[.,;:!?)\]}\"']*(?!\S))")
SPLIT = re.compile(r"[/:?=,;\"<>{}()\[\]]+")
RUN = re.compile(r"(.)\1\1")
OUTER = ".,;:!?\"'()[]{}<>#%&*$-_~^=+|/\\`´“”„‘’…"
#: Marks a token that was a run of single characters: words may be parted before any letter.
RUN_MARK = "\n"
LATIN = frozenset("abcdefghijklmnopqrstuvwxyz")


def of_two_scripts(word: str) -> bool:
    return not word.isascii() and not ALIKE.keys().isdisjoint(word) and not LATIN.isdisjoint(word)


def _cost(state: tuple) -> float:
    return state[1][0]


class Restorer:
    """Decodes tokens by Viterbi over their lattices."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    def arcs(token: str, i: int, latin: bool) -> tuple[list[tuple[float, str]], float | None, bool]:
        """What the character at ``i`` may stand for, with costs; what dropping it costs (None: it can't be); whether that needs the letter to be the last one kept."""
        c = token[i]
        run = i > 0 and token[i - 1] == c
        more = run and i > 1 and token[i - 2] == c
        if c == " ":
            return [(0.0, " ")], JOIN, False
        if c.isalpha():
            arcs = [(3.0 if more else 0.0, c)]
            if latin and c in ALIKE:
                arcs.append((ALIKE_COST, ALIKE[c]))
            return arcs, (REPEAT_MORE if more else REPEAT) if run else None, True
        looks = LOOKS.get(c, "")
        digit = c.isdigit()
        arcs = [((STAR if len(looks) > 2 else SUBSTITUTE) + (0.3 if run else 0), letter) for letter in looks]
        arcs.append((BREAK_FIRST if digit and not i else BREAK_DIGIT if digit else BREAK_SIGN, " "))
        return arcs, min(DROP_SIGN, 0.5) if run and not digit else DROP_DIGIT if digit else DROP_SIGN, False

    def decode(self, token: str, parted: bool = False) -> str:
        """The likeliest text behind ``token`` (lower case); ``parted``: words may also be parted before any letter.

        A state is the last two symbols and the last letter kept; its value the
        least cost and the path, as (path before, character).
        """
        costs = self.costs
        latin = of_two_scripts(token)
        states: dict = {(0, 0, ""): (0.0, None)}
        for i in range(len(token)):
            arcs, drop, same = self.arcs(token, i, latin)
            if parted and i and token[i].isalpha():
                for (a, b, last), (cost, path) in list(states.items()):
                    if b:
                        key, total = (b, 0, " "), cost + BREAK_LETTER + costs[a][b][0]
                        if key not in states or total < states[key][0]:
                            states[key] = (total, (path, " "))
            following: dict = {}
            for (a, b, last), (cost, path) in states.items():
                row = costs[a][b]
                for extra, t in arcs:
                    if t == " ":
                        if b == 0:
                            key, total, now = (a, b, last), cost + extra, path
                        else:
                            key, total, now = (b, 0, " "), cost + extra + row[0], (path, " ")
                    else:
                        s = symbol(t)
                        key, total, now = (b, s, t), cost + extra + row[s], (path, t)
                    if key not in following or total < following[key][0]:
                        following[key] = (total, now)
                if drop is not None and (not same or last == token[i]):
                    key, total = (a, b, last), cost + drop
                    if key not in following or total < following[key][0]:
                        following[key] = (total, path)
            if len(following) > STATES:
                following = dict(nsmallest(STATES, following.items(), key=_cost))
            states = following
        _, path = min(((cost + costs[a][b][0], path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, c = path
            out.append(c)
        return "".join(reversed(out)).strip()

    def words(self, token: str) -> list[str]:
        """The words behind one token, behind a run of single characters (after RUN_MARK), or behind two short words with a blank between."""
        low = token.lower()
        if low[0] == RUN_MARK:
            return [*self.decode(low[1:]).split(), *self.decode(low[1:], True).split()]
        if " " in low:  # of words that stay apart there is nothing new to say
            found = self.decode(low)
            return [] if " " in found else [found]
        core = low.strip(OUTER)
        odd = "$" in low or "@" in low
        clear = lambda word: word.isalpha() and not RUN.search(word) and not of_two_scripts(word)
        if not odd and (not core or clear(core)):
            return [core] if core else []
        out = []
        for part in SPLIT.split(low):
            if part:
                plain = part.strip(OUTER)
                fine = clear(plain)
                if fine:
                    out.append(plain)
                if not fine or part != plain and ("$" in part or "@" in part):
                    if any(map(str.isalpha, part)):
                        out += self.decode(part).split()
        return out


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text; runs of single characters and pairs of short words count as one more token each."""
    tokens = text.split()
    found = set(tokens)
    sizes = list(map(len, tokens))
    found.update(f"{a} {b}" for a, b, m, n in zip(tokens, tokens[1:], sizes, sizes[1:]) if m + n > SHORT and min(m, n) <= SHORT and max(m, n) <= SHORT + 1 and a.isalpha() and b.isalpha())
    if any(len(t) == 1 for t in found) or "." in text or "-" in text:
        found.update(RUN_MARK + joined for m in SPACED.finditer(text) if (joined := re.sub(r"[ .\-_*]", "", m.group())))
    return found


def features_of(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        if len(w) > 2:
            out.add("=" + w)
            out.update(w[:n] for n in PREFIXES if n < len(w))
    return out


class Cache(dict):
    """Token to what ``make`` gives for it; begun anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        found = self.make(token)
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[token] = found
        return found


_KEPT: dict[str, Cache] = {}


@dataclass
class ToxicityModel:
    costs: np.ndarray
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -30.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scorer(self):
        """What gives the features of a text and how many of its tokens carry each; what it has decoded serves all of a worker's tasks."""
        restorer, index = Restorer(self.costs), {f: i for i, f in enumerate(self.features)}
        heads = {f.removeprefix("=")[: PREFIXES[0]] for f in self.features}  # every feature of a word begins as the word does

        def telling(token: str) -> tuple[int, ...]:
            likely = [w for w in restorer.words(token) if w[: PREFIXES[0]] in heads]
            return tuple(index[f] for f in features_of(likely) if f in index) if likely else ()

        if self.name not in _KEPT:
            _KEPT.clear()
            _KEPT[self.name] = Cache(telling)
        carried = _KEPT[self.name]

        def counts(text: str) -> Counter:
            out: Counter = Counter()
            for found in filter(None, map(carried.__getitem__, tokens_of(text))):
                out.update(found)
            return out

        return counts

    def scores(self, counts, texts) -> np.ndarray:
        """The probability of each text; ``counts``: what `scorer` gave."""
        margins = np.array([self.bias + sum(self.weights[i] * np.log1p(n) for i, n in counts(t).items()) for t in texts])
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def count_features(sample: DataFrame, costs: np.ndarray) -> DataFrame:
    """feature, toxic, n: in how many sampled documents it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        made = Cache(lambda token: tuple(features_of(restorer.words(token))))
        toxic: Counter = Counter()
        every: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(every), pa.string()), pa.array([toxic[f] for f in every], pa.float64()), pa.array(list(every.values()), pa.int64())], names=["feature", "toxic", "n"])

        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found = set()
                for t in tokens_of(text):
                    found.update(made[t])
                every.update(found)
                if y > 0:
                    for f in found:
                        toxic[f] += y
            if len(every) > 400_000:
                yield flush()
                toxic.clear(), every.clear()
        yield flush()

    return sample.select("text", "y").mapInArrow(run, "feature string, toxic double, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the last coefficient is the bias."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, keep: int = KEEP) -> ToxicityModel:
    """Learn the character model from ``docs`` and the weights from ``labels``, already limited to those that may be used."""
    costs = trigram_costs(trigram_counts(docs))
    sample = labelled_sample(docs, labels, label, rows)
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).collect()[0]
    if not totals.toxic or totals.toxic >= totals.n:
        return ToxicityModel(costs)
    share = totals.toxic / totals.n
    expected = F.col("n") * F.lit(share)
    telling = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share) + 1)
    odds = (F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)
    top = count_features(sample, costs).where((F.col("toxic") >= MIN_TOXIC) & (odds > 3 * share / (1 - share))).orderBy(F.desc(telling), "feature").limit(keep)
    model = ToxicityModel(costs, [r.feature for r in top.collect()])  # `keep` rows
    if not model.features:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.scorer()
        for batch in slices(batches):
            found = [sorted(counts(t).items()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], names=["doc_id", "y", "at", "n"])

    found = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, at array<int>, n array<int>").collect()  # `rows` ids
    found.sort(key=lambda r: (r.doc_id, r.at, r.n))
    x, y = np.zeros((len(found), len(model.features)), np.float32), np.array([r.y for r in found])
    for i, r in enumerate(found):
        x[i, r.at] = np.log1p(r.n)
    model.weights, model.bias = logistic(x, y)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if the score is ``threshold`` or more) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value.scorer()
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(sent.value.scores(counts, batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return slim(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``; columns as in ``docs``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = sent.value.scorer()
        for part in texts:
            yield pd.Series(sent.value.scores(counts, part), dtype=float)

    return docs.where(score(F.coalesce("text", F.lit(""))) < threshold)
