"""Dense channels, equal times and large groups: the rows of the plain pairwise rule, without its pairs."""

import datetime as dt
import random

import pytest

from beaconframe.plans import QUERIES, media

MINUTE = 60_000


def folder(spark, path, calls):
    """An events table of (call_id, ms, unit_ref, k), all clicks."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(milliseconds=ms), unit, "click", 1.0, f'{{"k": {k}}}') for i, ms, unit, k in calls]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    rng = random.Random(3)
    calls = [(i, rng.choice([rng.randrange(3 * MINUTE), rng.randrange(40) * 3 * MINUTE, rng.randrange(120 * MINUTE)]), rng.randrange(3), rng.randrange(100)) for i in range(300)]
    return folder(spark, tmp_path_factory.mktemp("dense"), calls), calls


def pairs(calls, width):
    return [(a, b, abs(a[1] - b[1])) for a in calls for b in calls if a[0] != b[0] and a[2] % 8 == b[2] % 8 and abs(a[1] - b[1]) <= width]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_peer_pin(spark, dense):
    sf, calls = dense
    best = {}
    for a, b, gap in pairs(calls, 20 * MINUTE):
        best[a[0]] = min(best.get(a[0], (9,)), (0 if b[3] < 30 else 1 if b[3] < 60 else 2, gap, b[0]))
    found = QUERIES["j20_peer_pin"](spark, sf)
    assert {(r.call_id, r.gap_ms, r.peer) for r in found.collect()} == {(i, gap, peer) for i, (_, gap, peer) in best.items()}
    assert "Join" not in plan_of(found)


def test_five_nearest(spark, dense):
    sf, calls = dense
    near = {}
    for a, b, gap in pairs(calls, 60 * MINUTE):
        near.setdefault(a[0], []).append((gap, b[0]))
    found = QUERIES["j17_five_nearest"](spark, sf)
    assert {(r.call_id, r.place, r.gap_ms, r.other) for r in found.collect()} == {(i, n, *x) for i, xs in near.items() for n, x in enumerate(sorted(xs)[:5], 1)}
    assert "bucket" not in plan_of(found)


def test_inherited_pins(spark, dense):
    sf, calls = dense
    best = {}
    for a, b, gap in pairs(calls, 20 * MINUTE):
        if a[3] < 50 <= b[3]:
            best[a[0]] = min(best.get(a[0], (1 << 62,)), (gap * 1_000_000 + b[0], b[0]))
    found = QUERIES["g07_inherited_pins"](spark, sf)
    assert {(r.call_id, r.peer) for r in found.collect()} == {(i, peer) for i, (_, peer) in best.items()}
    assert "Join" not in plan_of(found)


def test_inherited_pins_of_large_ids(spark, tmp_path):
    """A million ids outweigh a millisecond, as in the SQL."""
    sf = folder(spark, tmp_path, [(1, 10, 0, 1), (9_000_000, 11, 0, 60), (5, 13, 0, 60)])
    assert [tuple(r) for r in QUERIES["g07_inherited_pins"](spark, sf).collect()] == [(1, 5)]


@pytest.mark.parametrize("name", ["w07_cooldown", "w08_repeat_suppression"])
def test_all_of_a_moment_fire(spark, tmp_path, name):
    sf = folder(spark, tmp_path, [(1, 0, 8, 7), (2, 0, 8, 7), (3, 1, 8, 7), (4, 5 * 60 * MINUTE, 8, 7), (5, 5 * 60 * MINUTE, 8, 7)])
    assert {r.call_id for r in QUERIES[name](spark, sf).collect()} == {1, 2, 4, 5}


def test_subscribers_are_counted_by_list(spark, tmp_path):
    spark.createDataFrame([(i, "oak" if i % 2 else "elm", f"Brand#{1 + i % 4}", 1) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i // 2, "BUILDING") for i in range(200)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["j26_keyword_subscribers"](spark, str(tmp_path))
    assert {(r.words, r.users) for r in found.collect()} == {("oak", 10), ("elm", 10)}
    text = plan_of(found)
    assert text.rindex("Join") < text.index("c_custkey", text.rindex("Join")) and "count(distinct who" not in text.split("Join")[1]


def test_merged_incidents_are_chains(spark, tmp_path):
    """Each within 15 minutes of the one before, though the last is later than that after the first."""
    sf = folder(spark, tmp_path, [(1, 0, 0, 4), (2, 10 * MINUTE, 0, 4), (3, 20 * MINUTE, 0, 4), (4, 36 * MINUTE, 0, 4), (5, 20 * MINUTE, 0, 5)])
    assert {tuple(r)[1:2] + tuple(r)[3:] for r in QUERIES["a39_merged_incidents"](spark, sf).collect()} == {(4, 3), (4, 1), (5, 1)}


def test_boundary_files_are_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "PART", 10)
    spark.createDataFrame([(i, f"c{i}", i % 2, float(i)) for i in range(1, 41)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    made = media.boundary_files(spark, str(tmp_path))
    assert made.count() == made.select("stem").distinct().count() == 9  # two nations in four parts, and number 40
    assert QUERIES["s18_boundaries"](spark, str(tmp_path)).count() == 40
