"""Pending tones with timers and links, and addresses, on small vectors."""

from pyspark.sql import functions as F

from beaconframe.functions import address
from beaconframe.streaming.book import Book


def test_tones_meet_the_next_long_voice():
    b = Book()
    assert b.events(1, 10, 0, True, 0) == [] and b.events(1, 11, 60_000, True, 0) == []
    assert b.events(1, 12, 119_000, False, 8) == [("attached", 10, 12), ("attached", 11, 12)]
    assert b.events(1, 13, 120_000, False, 8) == []


def test_replaced_and_orphaned():
    b = Book(orphan_ms=180_000)
    b.events(1, 10, 0, True, 0)
    assert b.events(1, 11, 121_000, True, 0) == [("expired", 10, None)]
    assert b.events(2, 12, 121_000 + 180_001, True, 0) == [("orphan", 11, None)]


def test_orphans_and_what_waits_behind_them():
    b = Book()
    b.settle("tone", 1, 10, 0, 0)
    b.settle("lock", 1, 0, 0, 0)
    b.settle("tone", 1, 11, 30_000, 0)
    assert b.due() == 60_000 and b.passed(60_000) == []
    assert b.passed(60_001) == [("orphan", 10, None, 60_000), ("dropped", 11, None, 60_000)] and b.empty()


def test_short_voice_waits():
    b = Book()
    b.events(1, 10, 0, True, 0)
    assert b.events(1, 11, 1_000, False, 2) == [] and b.events(1, 12, 2_000, False, 2) == []
    assert b.events(2, 13, 18_000, True, 0) == [("attached", 10, 12)]
    b.events(2, 14, 19_000, False, 2)
    assert b.events(2, 15, 20_000, False, 9) == [("attached", 13, 15)]


def test_linked_and_locked():
    b = Book(links={1: {2}})
    b.events(1, 10, 0, True, 0)
    b.lock(1)
    b.events(1, 11, 1_000, True, 0)
    assert b.events(2, 12, 31_000, False, 9) == []
    assert b.events(2, 13, 30_000, False, 9) == [("attached", 10, 13)]
    assert b.events(1, 14, 32_000, False, 9) == [("attached", 11, 14)]


def test_guarded_corrections():
    assert address.corrected("SHOR RD", [("SHOR", "SHORE")]) == "SHORE RD"
    assert address.corrected("LAKE SHORE DR", [("LAKE", "LAKE SHORE")]) == "LAKE SHORE DR"
    assert address.corrected("ASHOR", [("SHOR", "SHORE")]) == "ASHOR"
    assert address.corrected("MANE ST", [("MANE", "MAIN ST")]) == "MAIN ST"


def test_address_guards(spark):
    rows = [("12 MAIN ST", "at 12 main", "12 MAIN ST"), ("12 MAIN ST", "at main", None), ("OKAY", "okay", None), ("ABC 1234", "1234", None), ("ENGINE 12", "12", None), ("A", "a", None)]
    frame = spark.createDataFrame(rows, "a string, t string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", address.kept_address(F.col("a"), F.col("t"))).collect())
    got = spark.createDataFrame([("fire at 1200 north maple street apt 4b cross of oak and elm at the hill school",)], "t string").select(address.extract(F.col("t")).alias("x")).collect()[0].x
    assert (got.address, got.apartment, got.common_name) == ("1200 NORTH MAPLE STREET", "4B", "HILL SCHOOL")
