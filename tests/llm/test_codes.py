"""Vector codes, near copies among vectors, and collocations: against brute force on small tables with every kind of odd row."""

import collections
import hashlib
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest

from beaconframe.llm import codes, neardup, phrases
from beaconframe.llm.queries import oracle_sql, queries

NEW = ["op11_vector_codes", "op12_near_copies", "op13_phrases"]


@pytest.mark.parametrize("name", NEW)
def test_same_rows_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries()[name](spark, sf).select(*columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want.fetchall())


# Vector codes ---------------------------------------------------------------


def slow_codes(rows):
    """The contract in plain integers, entry by entry."""
    kept = [(i, v, g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 8 == 0]
    common = collections.Counter(len(v) for _, v, _ in kept)
    dim = min(common, key=lambda d: (-common[d], d))
    kept = sorted(((i, v, g) for i, v, g in kept if len(v) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * Fraction(x)) for x in v] for _, v, _ in kept]
    w = dim // 8
    books = [[v[p * w : p * w + w] for v in whole[:16]] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)), k) for k, e in enumerate(books[p])) for p in range(8)] for v in whole]

    for _ in range(6):
        found = assign()
        for p in range(8):
            for k in range(len(books[p])):
                mine = [v[p * w : p * w + w] for v, f in zip(whole, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    errors = [min(sum(d for d, _ in f), most) for f in assign()]
    by_label = collections.Counter()
    for (_, _, g), e in zip(kept, errors):
        by_label[g] += e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min(by_label[g], most), sha) for (i, _, g), f, e in zip(kept, assign(), errors)]


def vectors_of(spark, rows, kind="double"):
    odd = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(odd, f"vec_id bigint, embedding array<{kind}>, label int, code string, error int, n_links int").repartition(3)


def odd_vectors(rng, n=60, dim=16):
    near = [rng.normal(size=dim).tolist() for _ in range(n)]
    rows = [(i, v, i % 3 or None) for i, v in enumerate(near)]
    rows += [(100, near[0], 1), (100, near[1], 1), (0, near[0], None), (None, near[2], 2), (None, near[3], None)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 15 + [None], 1), (203, [1.0] * 15 + [math.nan], 1), (204, [math.inf] * 16, 1), (205, [1.0] * 8, 1), (206, [0.0] * 16, 1), (207, [1.0] * 5, 1)]
    return rows


@pytest.mark.parametrize("large", [[], [(-1, [1e300] * 16, 5), (-2, [-1e300, 1e30] * 8, 5)], [(300, [2.0**52 + 1] * 16, 5)]])
def test_codes(spark, large):
    rows = odd_vectors(np.random.default_rng(1)) + large
    got = codes.compressed(vectors_of(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(slow_codes(rows))


def test_codes_of_few_and_none(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(3)]
    assert collections.Counter(map(tuple, codes.compressed(vectors_of(spark, rows)).collect())) == collections.Counter(slow_codes(rows))
    assert codes.compressed(vectors_of(spark, rows).limit(0)).count() == 0


def test_search_drops_only_what_is_farther():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 3, 9):
        points, book = rng.integers(-3, 4, (500, dim)), rng.integers(-3, 4, (16, dim))
        far = ((points[:, None] - book[None]) ** 2).sum(2)
        code, least = codes.nearest(points, book)
        assert (code == far.argmin(1)).all() and (least == far.min(1)).all()
    assert codes.by_variance(np.array([[0, 5, 1], [0, -5, 1], [0, 0, 2]])).tolist() == [1, 2, 0]


def test_limbs():
    for v in (0, 1, -1, 2**32, -(2**32), 2**70 + 5, -(2**90) - 7, 12345678901234567890123):
        assert sum(d << 32 * k for k, d in codes._limbs(v)) == v and all(abs(d) <= 2**32 for _, d in codes._limbs(v))


# Near copies among vectors ---------------------------------------------------


def slow_near(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if good[i] and good[j] and len(a) == len(b) and (a == b or neardup.exact_cosine(np.array(a), np.array(b)) >= 0.95):
            links[i].append(j)
            links[j].append(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        top = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), top, vec_id == top))
    return out


@pytest.mark.parametrize("block", [1_000, 20])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = odd_vectors(rng)
    centre = rng.normal(size=16)
    rows += [(1_000 + i, (centre + rng.normal(size=16) * 0.3).tolist(), 0) for i in range(80)]  # cosines on both sides of the threshold
    rows += [(2_000 + i, (centre * 1e200).tolist(), 0) for i in range(30)] + [(3_000, (centre * 1e-200).tolist(), 0)]
    chain = [np.eye(16)[0] * math.cos(t) + np.eye(16)[1] * math.sin(t) for t in np.arange(0, 2.4, 0.3)]
    rows += [(4_000 - i, v.tolist(), 0) for i, v in enumerate(chain)]
    got = neardup.near_copies(vectors_of(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(slow_near(rows))


def test_near_copies_of_nothing(spark):
    assert neardup.near_copies(vectors_of(spark, odd_vectors(np.random.default_rng(4))).limit(0)).count() == 0
    alone = neardup.near_copies(vectors_of(spark, [(7, None, 1), (8, [0.0], 1)])).collect()
    assert sorted(map(tuple, alone)) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.95 exactly share a bucket as often as the number of tables is set for."""
    rng = np.random.default_rng(5)
    bits, tables = neardup.shape(50_000, recall=0.99)
    a, b = (neardup.unit(rng.normal(size=(4_000, 32))) for _ in range(2))
    b = neardup.unit(b - (a * b).sum(1)[:, None] * a)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    planes = rng.standard_normal((32, bits * tables))
    same = ((a @ planes > 0) == (b @ planes > 0)).reshape(len(a), tables, bits).all(2).any(1)
    assert same.mean() > 0.98


# Collocations ----------------------------------------------------------------


def slow_phrases(rows, top=2_000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= 30}
    inside = collections.defaultdict(int)
    for (lang, w), c in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], c)
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:top])]


def phrase_rows():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4)] + ["É", "字", "\x00", "a b"]
    texts = [" ".join(rng.choice(vocabulary, 120)) + rng.choice([". ", ",", "\n", "\t"]) + "New  YORK city hall! new york\tcity" for _ in range(300)]
    rows = [(t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts)]
    return rows + [(None, "en"), ("", None), ("new york " * 500, "en"), ("...", "xx"), (" \t ", "en"), ("x" * 5_000 + " new york city hall", "en")]


@pytest.mark.parametrize("limit", [phrases.SHARD, 700, 60])
def test_phrases(spark, limit):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "text string, lang string, f int, phrase string, n int").repartition(3)
    got = phrases.collocations(docs, limit=limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = slow_phrases(rows)
    assert len(want) > 60 and collections.Counter(map(tuple, got)) == collections.Counter(want)
    if limit == phrases.SHARD:
        some = phrases.collocations(docs, top=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert collections.Counter(map(tuple, some)) == collections.Counter(slow_phrases(rows, 7))
        assert phrases.collocations(docs.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    monkeypatch.setattr(phrases, "SEGMENT", 64)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string")
    f = phrases.build_filter
    monkeypatch.setattr(phrases, "build_filter", lambda frequent, n: f(frequent, n, 64))
    got = phrases.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(slow_phrases(rows))


def test_suffix_order():
    rng = np.random.default_rng(7)
    words, follows = rng.integers(0, 4, 300), rng.random(300) < 0.8
    follows[-1] = False
    length = phrases._reach(follows, 4)
    spelled = [tuple(words[i : i + length[i]].tolist()) for i in range(300)]
    order, lcp = phrases.suffix_order(words, follows, np.arange(300), 4)
    assert [spelled[i] for i in order] == sorted(spelled)
    for a, b, common in zip(order, order[1:], lcp[1:]):
        assert common == next((k for k in range(4) if spelled[a][k : k + 1] != spelled[b][k : k + 1] or not spelled[a][k : k + 1]), 4)
    for n in (1, 2, 3, 4):
        at, counts = phrases.intervals(order, lcp, length, np.ones(300, bool), n)
        assert dict(zip((s[:n] for s in (spelled[i] for i in at)), counts.tolist())) == collections.Counter(s[:n] for s in spelled if len(s) >= n)
