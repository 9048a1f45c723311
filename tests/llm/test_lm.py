"""Language-model scores against exact counts in plain Python."""

import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("beaconframe.llm")

from pyspark.sql import functions as F  # noqa: E402

from beaconframe.llm import lm, words  # noqa: E402
from beaconframe.llm.common import fold  # noqa: E402

rng = np.random.default_rng(5)
NOUNS = [f"noun{chr(97 + i % 26)}{i}" for i in range(300)]
ROWS = [
    (1, "alpha beta gamma delta\nalpha beta gamma delta alpha beta"),
    (2, "ALPHA beta\tgamma  é 字 😀\x0bend"),
    (3, None),
    (4, ""),
    (5, " \n\n "),
    (6, " ".join(f"w{i}" for i in range(3_000))),
    (7, "x" * 5_000),
    (8, "same row twice"),
    (8, "same row twice"),
    (None, "no id here but some text"),
    (None, "no id here either"),
] + [(100 + i, " ".join(rng.choice(NOUNS, 40))) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id bigint, text string, words string, segment int").repartition(3)


def plain(text):
    return (text or "").encode().lower().split()


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def quantised(c):
    level = 1 + math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) if c else 0
    least = lambda q: math.ceil(lm.BASE ** (q - 1) - 1e-6) if q else 0
    return least(level), least(level + 1) - 1 if level else 0


class Exact:
    """The same model without a filter."""

    def __init__(self, texts):
        self.words, self.pairs, self.grams = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            tokens = ["<", *plain(t), ">"]
            self.words.update(tokens[1:])
            self.pairs.update(zip(tokens, tokens[1:]))
        for w in self.words:
            if w != ">":
                self.grams.update(self.spelling(w))
        self.mass = sum(quantised(c)[0] for c in self.words.values())

    @staticmethod
    def spelling(word):
        padded = b"\0\0\0\0" + word + b"\1"
        return [(n, padded[i - n + 1 : i + 1]) for i in range(4, len(padded)) for n in lm.GRAMS] + [(-n, padded[i - n + 1 : i]) for i in range(4, len(padded)) for n in lm.GRAMS]

    def probability(self, before, token):
        p = lm.WORD * min(1, quantised(self.words[token])[0] / self.mass) if self.mass else 0
        if before in self.words:
            p += lm.PAIR * min(1, quantised(self.pairs[before, token])[0] / quantised(self.words[before])[1])
        if token != ">":
            padded, spelled = b"\0\0\0\0" + token + b"\1", 0.0
            for i in range(4, len(padded)):
                q = (1 - sum(lm.GRAM_WEIGHTS)) / 256
                for n, weight in zip(lm.GRAMS, lm.GRAM_WEIGHTS):
                    if c := self.grams[n, padded[i - n + 1 : i + 1]]:
                        q += weight * min(1, quantised(c)[0] / quantised(self.grams[-n, padded[i - n + 1 : i]])[1])
                spelled += math.log10(q)
            p += lm.SPELL * 10 ** max(spelled, -280)
        return p

    def score(self, text):
        tokens = ["<", *plain(text), ">"]
        return sum(math.log10(max(self.probability(a, b), 1e-290)) for a, b in zip(tokens, tokens[1:]))


def bases(rows, train):
    c = collections.Counter()
    for i, t in rows:
        if train(i):
            c.update([*plain(t), None])
    total, distinct = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = [*plain(t), None]
        out.append((i, len(tokens), sum(c[w] > 0 for w in tokens), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens), 4)))
    return collections.Counter(out)


@pytest.mark.parametrize("sent_bits, frequent", [(None, 100_000), (None, 3), (0, 3), (0, 0)])
def test_scores(docs, monkeypatch, sent_bits, frequent):
    monkeypatch.setattr(lm, "GROUP_CHARS", 5_000)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 2_000)
    got = lm.lm_scores(docs, fold("doc_id", 7) != 2, frequent, sent_bits).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == bases(ROWS, trained)
    exact = Exact([t for i, t in ROWS if trained(i)])
    want = sorted((i or 0, len(plain(t)) + 1, exact.score(t)) for i, t in ROWS)
    off = [abs(a - b.score) / -a for (_, _, a), b in zip(want, sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens, r.score)))]
    assert max(off) < 0.05 and np.median(off) < 0.005


def test_probabilities_sum_to_one_at_most():
    exact = Exact([t for _, t in ROWS])
    for before in ("<", b"alpha", b"beta", b"unseen", NOUNS[0].encode()):
        total = sum(exact.probability(before, w) for w in exact.words)
        assert 0.3 < total <= 1


def test_no_rows_and_no_training(docs):
    assert lm.lm_scores(docs.limit(0), fold("doc_id", 7) != 2).count() == 0
    assert lm.lm_scores(docs.limit(0), fold("doc_id", 7) != 2, 3, 0).count() == 0
    for sent_bits in (None, 0):
        got = lm.lm_scores(docs, F.lit(False), 3, sent_bits).collect()
        assert len(got) == len(ROWS) and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in got)


@pytest.mark.parametrize("tokens", [50_000, 2_000_000])
def test_false_positives_do_not_grow(tokens):
    """At the full load of a segment (every pair new, a tenth of the tokens new words), whatever the number of tokens."""
    segments = lm.segments_for(tokens * 6)
    bits = lm.bits_of_segment(tokens, tokens // 10, segments)
    keys = rng.integers(0, 2**64, tokens, dtype=np.uint64, endpoint=False)
    keys = np.unique(np.concatenate([keys, rng.integers(0, 2**64, tokens // 5, dtype=np.uint64)]))
    model = lm.LogFilter(bits, segments, tokens)
    size = bits // 8
    where = lm.segment_of(keys, segments)
    for s in range(segments):
        mine = keys[where == s] & np.uint64(0xFFFFFFFF)
        model.data[s * size : (s + 1) * size] = lm.LogFilter.segment(mine, np.ones(len(mine), np.int64), bits)
    assert (model.level(keys) >= 1).all()
    others = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert (model.level(others) > 0).mean() < 0.07


def test_size_follows_the_input_at_any_scale():
    for tokens in (10**6, 10**9, 10**12, 10**13):
        segments = lm.segments_for(tokens * 6)
        assert segments <= lm.MOST_SEGMENTS
        assert lm.bits_of_segment(tokens, tokens // 100, segments) * segments >= 0.999 * lm.BITS_PER_TOKEN * tokens


def test_log_filter_counts():
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    model = lm.LogFilter(1 << 20, 4)
    where = lm.segment_of(keys, 4)
    for s in range(4):
        part = lm.LogFilter.segment(keys[where == s] & np.uint64(0xFFFFFFFF), counts[where == s], model.segment_bits)
        model.data[s * len(part) : (s + 1) * len(part)] = part
    got = lm.least_count(model.level(keys))
    assert (got <= np.ceil(counts * 2.0)).mean() > 0.98
    assert (got * lm.BASE + 1 >= counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBc é字\t\n\x0b\x0c\r\x1c\x85", max_size=40), min_size=1, max_size=5), st.sampled_from([3, 8, 1000]))
def test_runs(texts, limit):
    """Whatever the parts, tokens and neighbours are those of the whole texts."""
    known, pairs, want = {}, collections.Counter(), collections.Counter()
    for run in words.runs(texts, limit):
        found = run.words().to_pylist()
        for i, w in zip(run.ids[run.word_at].tolist(), found):
            assert known.setdefault(i, w) == w
        inner = run.inner()
        pairs.update((a, b) for a, b, k in zip(run.ids.tolist(), run.ids[1:].tolist(), inner[1:].tolist()) if k)
    by_word = {w: i for i, w in known.items()}
    assert len(by_word) == len(known)
    for t in texts:
        tokens = [int(words.START), *(by_word[w] for w in t.encode().lower().split()), int(words.END)]
        want.update(zip(tokens, tokens[1:]))
    assert pairs == want
