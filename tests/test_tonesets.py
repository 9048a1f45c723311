"""Tone sets matched by joins, against every pair of tones of every clip."""

import random

import numpy as np

from beaconframe.functions import signal
from beaconframe.operators import tonesets

SPEC = "struct<frequency: double, min: double, max: double>"
SETS = f"set_id int, a {SPEC}, b {SPEC}, long {SPEC}, tolerance double, place int"
TONES = "clip_id int, place int, frequency double, start double, end double, duration double"


def slow(tones, sets):
    out = {}
    for set_id, a, b, long, tolerance, _ in sets:
        hz = tolerance * 500 if tolerance < 1 else tolerance
        fits = lambda t, s: s is not None and abs(t[2] - s[0]) <= hz and t[5] >= (s[1] or 0) and (not s[2] or t[5] <= s[2])  # noqa: E731, B023
        for clip in {t[0] for t in tones}:
            mine = sorted((t for t in tones if t[0] == clip), key=lambda t: (t[3], t[1]))
            if a and b:
                for x in (t for t in mine if fits(t, a)):
                    after = [t for t in mine if fits(t, b) and t[3] >= x[3] and -x[5] <= t[3] - x[4] <= 0.5]
                    if after:
                        out[clip, set_id] = (x[1], min(after, key=lambda t: (abs(t[3] - x[4]), t[3], t[1]))[1])
                        break
            else:
                one = a or b or long
                hit = next((t for t in mine if fits(t, one)), None)
                if hit:
                    out[clip, set_id] = (hit[1], None)
    return out


def test_same_as_every_pair(spark):
    rng = random.Random(9)
    tones = []
    for clip in range(40):
        start = 0.0
        for place in range(rng.randint(0, 6)):
            length = rng.choice([0.25, 0.5, 1.0, 3.0])
            tones.append((clip, place, float(rng.choice([395, 400, 405, 410, 700, 705, 900])), start, start + length, length))
            start += rng.choice([0.0, length, length + 0.25, length + 0.5, length + 0.75])
    spec = lambda: None if rng.random() < 0.4 else (float(rng.choice([400, 402, 700, 900])), rng.choice([None, 0.0, 0.5]), rng.choice([None, 0.0, 1.0]))
    sets = [(i, spec(), spec(), spec(), rng.choice([0.01, 0.02, 5.0, 12.0]), 1) for i in range(120)] + [(500, None, None, None, 10.0, 1)]
    frame, known = spark.createDataFrame(tones, TONES).repartition(3), spark.createDataFrame(sets, SETS).repartition(3)
    got = tonesets.matched_sets(frame, known).collect()
    want = slow(tones, sets)
    assert {(r.clip_id, r.set_id): (r.first.place, r.second and r.second.place) for r in got} == want and len(got) == len(want)
    assert {v[1] is None for v in want.values()} == {True, False}
    assert tonesets.matched_sets(frame.limit(0), known).count() == 0 and tonesets.matched_sets(frame, known.limit(0)).count() == 0


def test_known_sets(spark):
    rng = random.Random(10)
    hz = lambda: float(rng.choice([300, 304, 305, 311, 600]))
    sets = [(i, (hz(), None, None), (hz(), None, None), (hz(), None, None), 10.0, 1) for i in range(4)] + [(9, None, None, (311.0, None, None), 10.0, 1), (10, (600.0, None, None), None, None, 10.0, 1)]
    candidates = [(i, hz(), None if i % 3 == 0 else hz()) for i in range(60)] + [(99, None, None)]
    got = tonesets.known_sets(spark.createDataFrame(candidates, "candidate_id int, a_hz double, b_hz double"), spark.createDataFrame(sets, SETS), 5.0).collect()
    pairs = [(s[1][0], s[2][0]) for s in sets if s[1] and s[2]]
    want = {i: a is not None and (any(abs(a - x) <= 5 and abs(b - y) <= 5 for x, y in pairs) if b is not None else abs(a - 311.0) <= 5) for i, a, b in candidates}
    assert {r.candidate_id: r.known for r in got} == want and set(want.values()) == {True, False}


def test_tones_of_stored_clips(spark):
    t = np.arange(signal.RATE) / signal.RATE
    quiet = np.zeros(signal.RATE // 2)
    clip = np.concatenate([quiet, 0.5 * np.sin(2 * np.pi * 500 * t), 0.5 * np.sin(2 * np.pi * 1200 * t), quiet])
    rows = [(1, signal.wav_of_pcm(clip), "x"), (2, b"no wave", "x"), (3, None, "x"), (4, signal.wav_of_pcm(quiet), "x"), (5, b"", "x"), (None, signal.wav_of_pcm(clip), "x")]
    got = tonesets.detected_tones(spark.createDataFrame(rows, "clip_id bigint, wav binary, frequency string")).collect()
    assert sorted((r.clip_id or 0, r.place, round(r.frequency)) for r in got) == [(0, 0, 500), (0, 1, 1200), (1, 0, 500), (1, 1, 1200)]
