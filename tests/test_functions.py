"""Text, signal and state functions on small vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconframe.functions import geo, signal, streets
from beaconframe.functions import text as tx
from beaconframe.operators import search, temporal
from beaconframe.streaming.stateful import Pending


def value(spark, column, **given):
    frame = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in given.items()))
    return frame.select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "said, want",
    [("10-20 CENTER STREET", "1020 CENTER STREET"), ("MAIN & ELM", "MAIN AND ELM"), ("STATION40", "STATION 40"), ("85-E-212 STREET", "85 E 212 STREET"), ("3235 W 88TH ST", "3235 W 88TH ST"), ("", "")],
)
def test_normalise_transcript(spark, said, want):
    assert value(spark, tx.normalise_transcript(F.col("x")), x=said) == want


def test_keyword_hits(spark):
    assert value(spark, tx.hits(F.col("x"), "fire"), x="Fire at the fire, misfire. FIRE") == [0, 12, 27]
    assert value(spark, tx.hits(F.col("x"), "a.b"), x="axb a.b") == [4]
    assert value(spark, tx.hits(F.col("x"), "fire"), x="") == []


def test_context(spark):
    text = "x" * 60 + " fire " + "y" * 60
    got = value(spark, tx.context(F.col("x"), F.lit(61), 4), x=text)
    assert got == "..." + text[11:115] + "..."


def test_house_number(spark):
    assert value(spark, tx.merge_house_number(F.col("x")), x="RESPOND TO 26, 29 SOUTH ST") == "RESPOND 2629 SOUTH ST"
    assert value(spark, tx.merge_house_number(F.col("x")), x="TO 1, 2 SOUTH ST") == "TO 1, 2 SOUTH ST"


@pytest.mark.parametrize("text, want", [("", True), (None, True), ("aaaaaaaaaaaaaaa a", True), ("the the the the the", True), ("engine seven respond to main street", False)])
def test_tones_only(spark, text, want):
    assert value(spark, tx.tones_only(F.col("x")), x=text) is want


def test_streets(spark):
    assert value(spark, tx.canonical_street(F.col("x")), x="123 North Main Street, Apt 4") == "123 N MAIN ST"
    assert value(spark, tx.street_core(F.col("x")), x="North Main Street") == "MAIN"
    alike = lambda a, b: value(spark, streets.alike(F.col("a"), F.col("b")), a=a, b=b)
    assert alike("DURST CLACK ROAD", "DURST CLAGG ROAD") and alike("CARVER NILES RD", "NILES CARVER ROAD")
    assert not alike("OLIVE STREET", "OLIVE AVE NE") and not alike("EAST 85TH ST", "WEST 85TH ST")


NAMES = [
    "BEACH", "BEECH", "MELTON", "MILTON", "QUAYLE", "QUAIL", "YOULL", "YULE", "STAMBALL", "STAMBAUGH", "MAHOGANY", "MAHONING", "ALCETTA", "ELSETTA", "ABEL", "AXEL", "BELMONT", "BEAUMONT",
    "BLANE", "BLAINE", "AARON", "ARON", "CREEK", "COURT", "12TH", "13TH", "KIMROSE", "KIMROS", "MAIN", "WASHINGTON", "SOBEL", "TOBEL", "LEE", "LEA", "GLENWOOD", "GALEWOOD", "ELLA", "ELA", "TOOL", "TOL", "A", "",
]


def test_street_scores_and_keys(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    side = lambda x: names.select(F.col("n").alias(x), streets.match_keys(F.col("n"), F.col("n")).alias(f"keys_{x}"))
    rows = side("a").crossJoin(side("b")).select("a", "b", streets.score(F.col("a"), F.col("b")).alias("score"), F.arrays_overlap("keys_a", "keys_b").alias("met")).collect()
    score = {(r.a, r.b): r.score for r in rows}
    assert all(r.met for r in rows if r.score >= streets.LEAST)
    want = {("MAIN", "MAIN"): 1, ("BEACH", "BEECH"): 0.88, ("QUAYLE", "QUAIL"): 0.88, ("YOULL", "YULE"): 0.88, ("ALCETTA", "ELSETTA"): 0.8, ("STAMBALL", "STAMBAUGH"): 0.73, ("SOBEL", "TOBEL"): 0, ("12TH", "13TH"): 0, ("CREEK", "COURT"): 0, ("MAIN", "WASHINGTON"): 0, ("GLENWOOD", "GALEWOOD"): 0, ("BELMONT", "BEAUMONT"): 0}
    assert {k: round(score[k], 6) for k in want} == want
    assert score["ABEL", "AXEL"] > 0.78


def test_best_matches(spark):
    known = spark.createDataFrame([("BEECH ST",), ("BEECH AVE",), ("N MAIN ST",), ("CARVER NILES RD",), ("GALEWOOD DR",), ("GLENWOOD DR",), ("",), (None,), ("BEECH ST",)], "street string")
    heard = spark.createDataFrame([("BEACH STREET",), ("MAIN ST",), ("SOUTH MAIN ST",), ("NILES CARVER ROAD",), ("GLENWOOD DRIVE",), ("ZZZ RD",), ("",), (None,)], "said string")
    got = {r.said: (r.street, r.score) for r in streets.best_matches(heard, known).collect()}
    assert got == {"BEACH STREET": ("BEECH ST", 0.88), "MAIN ST": ("N MAIN ST", 1.0), "NILES CARVER ROAD": ("CARVER NILES RD", 1.0), "GLENWOOD DRIVE": ("GLENWOOD DR", 1.0)}


def test_geometry(spark):
    d = value(spark, geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=0.0, b=0.0, c=0.0, d=1.0)
    assert d == pytest.approx(111194.9, abs=1)
    assert geo.colours({1: {2, 3}, 2: {1}, 3: {1}}) == {1: 0, 2: 1, 3: 1}


def test_access_lists(spark):
    lists = spark.createDataFrame([("a", "*"), ("b", '[{"id":1,"talkgroups":[2]},{"id":3,"talkgroups":"*"},{"id":4}]'), ("c", "[]"), ("d", None)], "principal string, systems string")
    found = {(r.principal, r.system_ref, r.talkgroup_ref) for r in search.rights_table(lists).collect()}
    assert found == {("a", None, None), ("b", 1, 2), ("b", 3, None), ("b", 4, None), ("d", None, None)}


def test_delay_minutes():
    assert search.delay_minutes(30, {1: 0, 2: 9}, {2: 5, 4: 2}) == 2
    assert search.delay_minutes(30, {1: 0, 2: 9}, {2: 0}) == 9
    assert search.delay_minutes(30, {}, {}) == 30
    assert search.delay_minutes(0, {}, {}, default=4) == 4


def test_arrivals(spark):
    rows = [(1, 0, 1, 5.0), (2, 1000, 1, 5.0), (3, 2001, 1, 5.0), (4, 2900, 1, 9.0), (5, 0, 2, 0.0)]
    calls = spark.createDataFrame(rows, "call_id bigint, ts_ms bigint, channel bigint, duration double")
    assert {r.call_id for r in temporal.chained_duplicates(calls, ["channel"], 1000).where("duplicate").collect()} == {2, 4}
    assert {r.call_id: r.prior for r in temporal.prior_arrival(calls, ["channel"], 1000).where("prior is not null").collect()} == {2: 1}
    assert {r.call_id for r in temporal.fired(calls, ["channel"], 1500).collect()} == {1, 3, 5}


def test_band_join_edges(spark):
    rows = [(1, 0), (2, 1000), (3, 2000), (4, 2001)]
    calls = spark.createDataFrame([(i, t, 1) for i, t in rows], "call_id bigint, ts_ms bigint, channel bigint")
    got = {(r.call_id, r.r_call_id) for r in temporal.band_join(calls, calls, ["channel"], 1000).collect()}
    assert got == {(a, b) for a, s in rows for b, t in rows if abs(s - t) <= 1000}


def test_pending_tones():
    p = Pending(120_000)
    assert p.voice(0) == []
    p.tone(1, 1_000), p.tone(2, 60_000)
    assert p.voice(500) == []
    assert p.voice(179_000) == [1, 2]
    p.tone(3, 200_000)
    assert p.voice(321_000) == []
    assert p.tone(4, 400_000) == [3]


def tone(frequency, seconds, rate=8000):
    return 0.5 * np.sin(2 * np.pi * frequency * np.arange(int(rate * seconds)) / rate)


def test_tone_segments():
    clip = np.concatenate([np.zeros(4000), tone(600, 1.0), tone(900, 3.0), np.zeros(4000)])
    found = signal.tone_segments(clip, 8000)
    assert [round(t["frequency"], -1) for t in found] == [600, 900]
    assert found[1]["duration"] == pytest.approx(3.0, abs=0.3)
    spec = {"a": {"frequency": 601, "min": 0.5}, "b": {"frequency": 899, "min": 2}, "tolerance": 0.02}
    assert signal.matches_set(found, spec)
    assert not signal.matches_set(found[::-1][:1], spec)


def test_harmonics_go():
    low = {"frequency": 500.0, "start": 0.0, "end": 1.0, "duration": 1.0, "magnitude": 1.0}
    assert signal.without_harmonics([low, low | {"frequency": 1010.0}, low | {"frequency": 1250.0}]) == [low, low | {"frequency": 1250.0}]


def test_profiles(spark):
    assert len(signal.energy_profile(np.zeros(1000))) == 0
    assert signal.energy_profile(tone(500, 1.0)).max() == 1.0
    x = [float(v) for v in np.sin(np.arange(40) / 3) + 1.5]
    frame = spark.createDataFrame([(x, [0.0] * 5 + x[:-5], [0.0] * 40)], "a array<double>, b array<double>, z array<double>")
    got = frame.select(signal.best_cosine(F.col("a"), F.col("b")).alias("v"), signal.best_cosine(F.col("a"), F.col("z")).alias("z")).collect()[0]
    assert got.v == pytest.approx(1.0) and got.z == 0.0


def test_wav_and_spans():
    x, rate = signal.pcm_of_wav(signal.wav_of_pcm(tone(500, 0.5)))
    assert rate == 8000 and np.abs(x - tone(500, 0.5)).max() < 1e-3
    assert signal.kept_spans(10, [(1, 2), (1.2, 1.5)]) == [(0.0, 0.95), (2.05, 10)]
    assert signal.kept_spans(1, [(0, 1)]) == [(0.0, 1)]


def noisy(parts, rate=8000, level=0.01):
    clip = np.concatenate(parts)
    return clip + level * np.random.default_rng(3).standard_normal(len(clip))


def test_gates_follow_the_clip():
    blank = np.zeros(8000)
    for loudness in (1.0, 0.1):
        found = signal.tone_segments(loudness * noisy([blank, tone(600, 1.0), tone(950, 1.0), blank]), 8000)
        assert [round(t["frequency"], -1) for t in found] == [600, 950]
    assert signal.tone_segments(0.01 * noisy([blank, tone(600, 1.0), blank]), 8000) == []  # below the least magnitude
    assert signal.tone_segments(noisy([blank, blank, blank], level=0.3), 8000) == []  # noise alone
    level, floor = signal.relative_levels(np.array([1.0] * 6 + [0.1] * 2 + [0.01] * 2), 8000, 256)
    assert level[0] == 0 and floor == pytest.approx(-20)  # the third of ten sorted levels bounds the quiet ones; the third of those four is the floor
    assert signal.relative_levels(np.zeros(3), 8000, 256)[1] == signal.NO_FLOOR_DB
    late = np.array([0.1] * 100 + [1.0] * 10)  # speech after the first three seconds does not set the peak
    assert signal.relative_levels(late, 8000, 256)[0][0] == 0 and signal.relative_levels(late, 8000, 256, None)[0][0] == pytest.approx(-20)


def test_sustained_tones():
    blank = np.zeros(8000)
    both = tone(600, 1.0) + 0.5 * tone(1500, 1.0)
    found = signal.sustained_tones(noisy([blank, both, blank, tone(2500, 0.1), blank]), 8000)
    assert [round(t["frequency"], -1) for t in found] == [600, 1500]
    assert all(t["start"] == pytest.approx(1, abs=0.25) and t["end"] == pytest.approx(2, abs=0.25) for t in found)
    assert signal.sustained_tones(0.02 * noisy([blank, both, blank]), 8000) == []
    assert signal.sustained_tones(np.zeros(100), 8000) == signal.sustained_tones(np.zeros(9000), 8000) == []


def busy_channel(spark):
    """One channel with nine calls in ten, some at equal times, over several slices; two quiet ones, one of them without a name."""
    rows, ts = [], 1_000
    for i in range(400):
        ts += (7 * i * i + 3 * i) % 97 * (0 if i % 9 == 0 else 1)
        rows.append((i, [1, 1, 1, 1, 1, 2, 1, 1, 1, None][i % 10], ts, float(i % 7), i % 5))
    return rows, spark.createDataFrame(rows, "call_id bigint, channel int, ts_ms bigint, duration double, k int").repartition(5)


def test_sliced_windows(spark):
    from pyspark.sql import Window

    rows, calls = busy_channel(spark)
    w = Window.partitionBy("channel").orderBy("ts_ms", "call_id")
    plain = calls.select("call_id", F.lag("call_id").over(w).alias("previous"), F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    want = {r.call_id: (r.previous, r.total) for r in plain.collect()}
    for width in (150, 1_000, 10**9):
        got = temporal.running_sum(temporal.with_previous(calls, ["channel"], "duration", slice_ms=width), ["channel"], "k", "total", slice_ms=width)
        assert {r.call_id: (r.previous and r.previous.call_id, r.total) for r in got.collect()} == want
    for back, ahead in ((300, 0), (-1, 200), (50, 60)):
        band = F.count(F.lit(1))
        plain = calls.withColumn("n", band.over(Window.partitionBy("channel").orderBy("ts_ms").rangeBetween(-back, ahead)))
        got = temporal.over_band(calls, ["channel"], back, ahead, band, "n", slice_ms=400)
        assert {r.call_id: r.n for r in got.collect()} == {r.call_id: r.n for r in plain.collect()}
    assert temporal.with_previous(calls.limit(0), ["channel"]).count() == 0


def test_numbered(spark):
    from beaconframe.operators.numbering import numbered

    rows = [(i * 37 % 101, f"x{i}", i) for i in range(101)] + [(None, "none", 0)]
    frame = spark.createDataFrame(rows, "id int, name string, n int").repartition(7)
    got = numbered(frame, ["id"], "number").collect()
    assert [(r.number, r.id) for r in sorted(got, key=lambda r: r.number)] == list(enumerate([None, *range(101)], 1))
    assert {(r.id, r.name, r.n) for r in got} == set(rows) and numbered(frame.limit(0), ["id"], "number").count() == 0
