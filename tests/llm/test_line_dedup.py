"""Line deduplication against a comparison of every pair of documents."""

import numpy as np
import pytest

pytest.importorskip("beaconframe.llm")

from beaconframe.llm import common, line_dedup  # noqa: E402


def brute(rows, least=line_dedup.MIN_WORDS):
    """A line goes if it lies in a run of at least ``least`` words that an earlier document has too."""
    out = {}
    lines_of = lambda t: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()]
    for n, (i, text) in enumerate(rows):
        mine = lines_of(text)
        gone = set()
        for _, earlier in rows[:n]:
            theirs = [x for _, x in lines_of(earlier)]
            for a in range(len(mine)):
                for b in range(len(theirs)):
                    k = 0
                    while a + k < len(mine) and b + k < len(theirs) and mine[a + k][1] == theirs[b + k]:
                        k += 1
                    if sum(len(x.split()) for _, x in mine[a : a + k]) >= least:
                        gone.update(p for p, _ in mine[a : a + k])
        out[i] = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
    return out


def deduplicated(spark, rows, **more):
    return {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **more).collect()}


def test_moved_and_repeated_lines(spark):
    a, b, c = ("first line of six words here", "second line of six words here", "third line of six words here")
    rows = [(1, "\n".join((a, b, c))), (2, "\n".join((c, a, b))), (3, "\n".join((b, "", b))), (4, "\n".join(("x", a, "x", b, a)))]
    want = {1: "\n".join((a, b, c)), 2: "", 3: "", 4: "x\nx"}
    assert deduplicated(spark, rows) == brute(rows) == want


def test_copies_made_of_common_lines(spark):
    """Each line of the copy has another first holder, and no line is long enough by itself."""
    lines = ["one two three", "four five six", "seven eight nine", "ten eleven twelve"]
    rows = [(i + 1, line + f"\nown words of {i}") for i, line in enumerate(lines)] + [(5, "\n".join(lines)), (6, "\n".join(lines)), (7, "\n".join(lines[1:3]))]
    assert deduplicated(spark, rows)[6] == "" and deduplicated(spark, rows)[7] == ""
    assert deduplicated(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [common.HOT_SHARE, 20])
def test_random_documents(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", hot)
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{k}_{j}" for j in range(rng.integers(1, 8))) for k in range(60)]
    rows = []
    for i in range(120):
        text = [pool[min(59, int(rng.exponential(12)))] for _ in range(rng.integers(0, 14))]
        if rows and rng.random() < 0.4:
            other = rows[rng.integers(len(rows))][1].split("\n")
            cut = rng.integers(len(other) + 1)
            text += other[cut : cut + 6]
        rows.append((i, "\n".join(t + " " * int(rng.integers(2)) if rng.random() < 0.9 else "" for t in text)))
    assert deduplicated(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(400_000))  # one line of megabytes
    rows = [(1, long), (2, long + "\nand then something else"), (3, None), (4, ""), (None, "no id and six words here"), (9, "no id and six words here"), (10, "\n\n"), (11, "same row of six words here"), (11, "same row of six words here")]
    got = sorted(map(tuple, line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    want = [(1, long), (2, "and then something else"), (3, None), (4, ""), (None, ""), (9, "no id and six words here"), (10, "\n\n"), (11, "same row of six words here"), (11, "same row of six words here")]
    assert got == sorted(want, key=str)


def test_patience_takes_rare_anchors_and_aligns_the_gaps():
    pairs = [(0, 5, 100), (1, 1, 2), (2, 2, 100), (3, 3, 2), (4, 0, 100), (5, 6, 100)]
    assert line_dedup.patience(pairs) == [(1, 1, 2), (2, 2, 100), (3, 3, 2), (5, 6, 100)]
    assert line_dedup.patience([(0, 4, 1), (1, 4, 1), (2, 4, 1)]) in ([(0, 4, 1)], [(1, 4, 1)], [(2, 4, 1)])


def test_rare_partners_come_first():
    """A common passage that a rare partner's block holds too counts for the rare partner alone."""
    shared = {(1, 0): [(0, 0, 50, [0])], (2, 0): [(1, 3, 2, [1]), (0, 2, 50, [0])]}
    assert line_dedup.removed_lines(shared) == ([0, 1], 1)
