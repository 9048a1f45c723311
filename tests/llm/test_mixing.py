"""Mixing against the conditions of an optimum, and against targets filled step by step."""

import collections

import numpy as np
import pytest

pytest.importorskip("beaconframe.llm")

from pyspark.sql import functions as F  # noqa: E402

from beaconframe.llm import mixing  # noqa: E402

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6, "a"),
    (2, "quite another text with words of its own, that is", "b"),
    (3, None, "b"),
    (4, "", None),
    (5, " ".join(f"w{i}" for i in range(30_000)), "a"),
    (6, "you are here", "c"),
    (6, "you are here", "c"),
    (6, "you are here", "d"),
    (None, "no id here but some text to read and more", "a"),
    (None, "no id here either, other words follow now", None),
] + [(100 + i, "copy of a text that many documents share with each other", "a") for i in range(40)]


def multiset(rows):
    return collections.Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", i % 2, 2.0) for i, r in enumerate(ROWS)], "doc_id bigint, text string, source string, size string, n int, row_key double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_mixing(docs, none):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(ROWS)
    sizes = [(i, len([w for w in (t or "").encode().split()]), s) for i, t, s in ROWS]
    total = sum(n for _, n, _ in sizes)
    by_source = collections.Counter()
    for _, n, s in sizes:
        by_source[s] += n
    names = sorted((s for s in by_source if s is not None)) + [None]
    weight = dict(zip(names, (5, 2, 1) * 5))
    target, stopped = {}, set()
    while True:
        pool = 1.5 * total - sum(2 * by_source[s] for s in stopped)
        rest = [s for s in names if s not in stopped]
        share = sum(weight[s] for s in rest)
        target = {s: pool * weight[s] / share for s in rest} | {s: 2 * by_source[s] for s in stopped}
        above = {s for s in rest if target[s] > 2 * by_source[s]}
        if not above:
            break
        stopped |= above
    found = {(r.source_size, round(r.target, 3)) for r in plan}
    assert found == {(by_source[s], round(target[s], 3)) for s in names}
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in plan)
    again = mixing.mix_plan(docs.repartition(2)).collect()
    assert multiset((r.doc_id, r.size, r.taken) for r in again) == multiset((r.doc_id, r.size, r.taken) for r in plan)
    assert mixing.mix_plan(none).count() == 0
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in plan)
    assert mixing.mixed(none).count() == 0


def test_mixing_comes_near(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 101)), "abcdef"[i % 6]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken, target = collections.Counter(), {}
    where = {i: s for i, _, s in rows}
    for r in mixing.mix_plan(frame).collect():
        taken[where[r.doc_id]] += r.taken
        target[where[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 20 for s in target)


def test_rates_are_those_of_the_optimum(spark):
    """Every source's words are its target, length is balanced up to its penalty, and log rates are one line in length for all documents below the cap."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(3 + (i % 5) * 0.4, 1))), "abcde"[i % 5]) for i in range(3000)]
    where = {i: s for i, _, s in rows}
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("size > 0").collect()
    size, rate, target = (np.array([r[k] for r in got], float) for k in ("size", "rate", "target"))
    source = np.array([where[r.doc_id] for r in got])
    length = np.log2(size + 1)
    mean = (size * length).sum() / size.sum()
    x = (length - mean) / np.sqrt((size * length**2).sum() / size.sum() - mean**2)
    slopes = []
    for s in "abcde":
        mine = source == s
        assert abs((rate * size)[mine].sum() / target[mine][0] - 1) < 1e-5
        inner = mine & (rate < 2 - 1e-9)
        if target[mine][0] < 2 * size[mine].sum() * (1 - 1e-9):
            slope, m = np.polyfit(x[inner], np.log(rate[inner]), 1)
            slopes.append(slope)
            assert np.allclose(np.log(rate[mine]), np.minimum(np.log(2), m + slope * x[mine]), atol=1e-6)
    assert len(slopes) > 1 and np.ptp(slopes) < 1e-6 and abs(slopes[0]) > 1e-3
    free = np.isin(source, [s for s in "abcde" if target[source == s][0] < 2 * size[source == s].sum() * (1 - 1e-9)])
    pool = sum(target[source == s][0] for s in "abcde")
    assert abs((rate * size * x)[free].sum() + mixing.RIDGE * pool * slopes[0]) < 1e-4 * pool


def test_hot_equal_rows(spark):
    """Equal rows are dealt to groups apart from each other, and taken between them as the mix says."""
    rows = [(None, "the very same row", "a")] * 5_000 + [(i, f"row {i} of the others and more", "b") for i in range(2_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    plan = mixing.mix_plan(frame).collect()
    taken, target = collections.Counter(), {}
    for r in plan:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(plan) == len(rows) and all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    assert mixing.mixed(frame).count() == sum(r.copies for r in plan)
    ids = spark.range(3).select(F.lit(10_000).cast("long").alias("n"), "id")
    assert mixing.each(ids, "n", "number").groupBy("id").agg(F.countDistinct("number").alias("k"), F.max("number").alias("m")).where("k = 10000 and m = 10000").count() == 3


def test_sources_are_numbered_in_order(spark):
    names = [None, "b", "a", "é", "Z", "", "aa", "字"] + [f"s{i}" for i in range(50)]
    got = {r.source: r.place for r in mixing.numbered(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert sorted(got, key=got.get) == sorted(n for n in names if n is not None) + [None] and sorted(got.values()) == list(range(len(names)))
