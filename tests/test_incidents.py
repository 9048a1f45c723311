"""Transcripts to incidents, on sentences with known outcomes."""

from beaconframe.functions.locations import Gazetteer
from beaconframe.operators import incidents

KNOWN = Gazetteer(("OAK RUN",), ("HILL HOUSE",))
ROWS = [
    (1, "structure fire at 12 oak run", "ok", "12 OAK RUN", "Structure Fire"),
    (2, None, "skipped", None, None),
    (3, " \n\t", "skipped", None, None),
    (4, "engine 12 oak run, car fire", "failed", None, "Vehicle Fire"),
    (5, "call at the hill house room 2", "failed", None, None),
    (6, "copy that", "failed", None, None),
    (None, "14 oak run", "ok", "14 OAK RUN", None),
]


def test_processed(spark):
    frame = spark.createDataFrame([(*r[:2], "x") for r in ROWS], "call_id bigint, transcript string, status string").repartition(3)
    got = {r.call_id: r for r in incidents.processed(frame, KNOWN).collect()}
    assert len(got) == len(ROWS)
    for call, text, status, address, category in ROWS[:-1]:
        r = got[call]
        assert (r.status, r.address, r.category) == (status, address, category)
        assert r.notes == (text.upper() if status == "failed" else None)
    assert (got[5].place, got[5].apartment) == ("HILL HOUSE", "ROOM 2")
    assert incidents.processed(frame.limit(0), KNOWN).count() == 0


def test_saved_once(spark):
    found = incidents.processed(spark.createDataFrame([r[:2] for r in ROWS[:-1]], "call_id bigint, transcript string"), KNOWN)
    saved = spark.createDataFrame([(9, "x", "y")], "call_id bigint, address string, category string")
    first = incidents.new_incidents(saved, found)
    assert [r.call_id for r in first.collect()] == [1]
    assert incidents.new_incidents(saved.unionByName(first), found).count() == 0
