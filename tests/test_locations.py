"""Addresses in transcripts: sentences with known outcomes, guards, and alignment against all alignments."""

import itertools
import random

import pytest

from beaconframe.functions import locations as loc

KNOWN = loc.Gazetteer(("LAMONT DRIVE", "LEMOYNE AVENUE", "NORTH STATE STREET", "BUSHNELL CAMPBELL ROAD", "SOUTHERN AVENUE", "SOUTHERN BOULEVARD", "OAK RUN"), ("SHEPHERD OF THE VALLEY",))
FOUND = [
    ("respond to 4100 westbrook drive apartment 4b for a fall", {"address": "4100 WESTBROOK DRIVE", "apartment": "APARTMENT 4B"}),
    ("4918 Bushnell Campbell crosses of Lamont and Lemoyne Avenue", {"address": "4918 BUSHNELL CAMPBELL ROAD", "cross_1": "LAMONT DRIVE", "cross_2": "LEMOYNE AVENUE"}),
    ("crosses are lamont and lemoyne", {"address": "LAMONT DRIVE & LEMOYNE AVENUE", "cross_1": "LAMONT DRIVE", "cross_2": "LEMOYNE AVENUE"}),
    ("lamont and lemoyne for a crash", {"address": "LAMONT DRIVE & LEMOYNE AVENUE"}),
    ("lamont in north state, two cars", {"address": "LAMONT DRIVE & NORTH STATE STREET"}),
    ("lamont and lemoyne are friends", {}),
    ("2450 state route 88 between lamont and oak run", {"address": "2450 SR 88", "cross_1": "LAMONT DRIVE", "cross_2": "OAK RUN"}),
    ("ninety of off of lamont for smoke", {"address": "LAMONT DRIVE"}),
    ("882-12 southern, room 7", {"address": "88212 SOUTHERN", "apartment": "ROOM 7"}),
    ("12 lake road west and 14 oak run", {"address": "14 OAK RUN"}),
    ("12 lake road west", {"address": "12 LAKE ROAD WEST"}),
    ("at the hill top school", {"place": "HILL TOP SCHOOL"}),
    ("squad call shepherd of the valley room 222", {"place": "SHEPHERD OF THE VALLEY", "apartment": "ROOM 222"}),
    ("22 and 45, copy that", {}),
    ("", {}),
]


@pytest.mark.parametrize("text, want", FOUND)
def test_found(text, want):
    assert loc.extract(text, KNOWN) == want


KEPT = [
    ("4100 WESTBROOK DRIVE", "ADVISING YOUR SQUAD HAS RESPONDED 4100 WESTBROOK DRIVE IT S A 41 YEAR OLD FEMALE WHO S THROWING UP"),
    ("4918 BUSHNELL CAMPBELL ROAD", "STATION 12 MUTUAL AID WITH 29 FOR A MEDIC 4918 BUSHNELL CAMPBELL ROAD CROSSES OF BRADLEY BROWNLEE AND BEACH SMITH ROAD 55 YEAR OLD MALE TIME 1332"),
    ("7814 BEEMAN AVENUE", "DAMAGE REPORT AT 7814 BEEMAN AVENUE THAT S 7814 BEEMAN SAYS THAT HIS VEHICLE WAS DAMAGED"),
    ("1501 TIBBETTS WICK ASSISTED LIVING", "SQUAD CALL SHEPHERD OF THE VALLEY 1501 TIBBETTS WICK ASSISTED LIVING ROOM 222 97 YEAR OLD MALE"),
    ("65 WEST WALNUT NO CONTACT", "SILENT PANIC ALARM COMING FROM PAPA JOHN 65 WEST WALNUT NO CONTACT MADE WITH EMPLOYEES THERE"),
    ("882 LIBERTY STREET", "bellaria pizza, 88-2 liberty street"),
    ("LUMONT DRIVE & LEMOYNE AVENUE", "crosses of lamont and lemoyne"),
    ("2450 SR 88", "2450 state route 88"),
    ("41 OAK RUN", "41 oak run, 41 year old male"),
]
DROPPED = [
    ("99 OAK RUN", "at oak run", "not said"),
    ("12 MAPLE STREET", "12 people on the street", "not said"),
    ("41 OAK RUN", "oak run, for a 41 year old male", "age"),
    ("1332 OAK RUN", "oak run. time 1332", "time"),
    ("12 OAK RUN", "engine 12 to oak run", "unit"),
    ("2015 OAK RUN", "a 2015 ford on oak run", "vehicle"),
    ("OKAY COPY THAT", "okay copy that", "noise"),
    ("ABC 1234", "plate abc 1234", "plate"),
    ("ENGINE 12", "engine 12", "unit"),
    ("A", "a", "malformed"),
    ("LAMONT DRIVE & OAK RUN", "lamont and oak run, you can disregard", "cancelled"),
    ("SR 411 & AROUND", "down by the creek", "not said"),
]


def test_guards():
    assert [(a, loc.rejected(a, t)) for a, t in KEPT] == [(a, "") for a, _ in KEPT]
    assert [(a, loc.rejected(a, t)) for a, t, _ in DROPPED] == [(a, why) for a, _, why in DROPPED]
    assert loc.tidy("1501 Tibbetts Wick assisted living") == "1501 TIBBETTS WICK"


def slow_alignment(wanted, said):
    """The best score over all ways to match words in order."""
    best = 0
    for n in range(1, min(len(wanted), len(said)) + 1):
        for a in itertools.combinations(range(len(wanted)), n):
            for b in itertools.combinations(range(len(said)), n):
                if all(loc._alike(wanted[i], said[j]) for i, j in zip(a, b)):
                    best = max(best, 3 * n - (a[-1] - a[0] + 1 - n) - (b[-1] - b[0] + 1 - n))
    return best


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        wanted, said = [[rng.choice(["OAK", "MAPLE", "MAPEL", "12", "RIDGE"]) for _ in range(rng.randint(0, n))] for n in (3, 6)]
        n, first, last = loc.alignment(wanted, said)
        assert (n > 0) == (slow_alignment(wanted, said) > 0)
        if n:
            assert 0 <= first <= last < len(said) and slow_alignment(wanted, said[first : last + 1]) == slow_alignment(wanted, said)


def test_rows(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(FOUND)] + [(None, "12 oak run", "x"), (50, None, "x"), (1, FOUND[1][0], "y")]
    frame = spark.createDataFrame(rows, "call_id bigint, transcript string, address string").repartition(3)
    got = sorted((tuple(r) for r in loc.locations(frame, KNOWN).collect()), key=str)
    want = [(i, *map(loc.extract(t, KNOWN).get, loc.FIELDS), None) for i, t, _ in rows if t and loc.extract(t, KNOWN)]
    assert got == sorted(want, key=str)
    assert loc.locations(frame.limit(0), KNOWN).count() == 0
