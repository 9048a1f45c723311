"""A line break ends what is said, for units and for addresses; a number counts where it is said with its street."""

import pyarrow as pa
from pyspark.sql import functions as F

from beaconframe.functions import locations
from beaconframe.functions import text as tx
from beaconframe.functions.mentions import annotations_of, mentions_of
from beaconframe.plans.locations import KNOWN
from beaconframe.plans.mentions import SETTINGS
from beaconframe.sources import shared


def named(text):
    return [(m.first, m.second, m.number) for _, found, _ in mentions_of([text], SETTINGS) for m in found]


def test_units_end_with_the_line():
    assert named("an engin\n1. County, engne-598") == [("COUNTY", "ENGINE", "598")]
    assert sorted(named("medic\n7 and cty\nsquad 8, county\nengin 9")) == [("", "ENGINE", "9"), ("", "SQUAD", "8")]
    [(_, found, up)] = mentions_of(["an engin\n1. County, engne-598"], SETTINGS)
    assert [a[1:] for a in annotations_of(found, up)[1]] == [("COUNTY ENGINE 598", 12, 29)]


def test_addresses_end_with_the_line():
    assert locations.extract("on page 17\ngibson and mcguffey, disregard.", KNOWN)["address"] == "GIBSON STREET & MCGUFFEY ROAD"
    assert locations.extract("17 gibson street", KNOWN)["address"] == "17 GIBSON STREET"


def test_a_number_elsewhere_confirms_nothing():
    assert locations.rejected("20 NORTH HAZELWOOD AVENUE", "on page 20 of it\npulse of 20 north hazelwood.") == "vitals"
    assert locations.rejected("20 NORTH HAZELWOOD AVENUE", "pulse of 20. 20 north hazelwood.") == ""
    assert locations.rejected("20 NORTH HAZELWOOD AVENUE", "pulse of 20 north hazelwood, so 20 north hazelwood.") == ""


def test_slices_have_every_row(monkeypatch):
    monkeypatch.setattr(shared, "SLICE_BYTES", 10)
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * n for n in (3, 30, 0)] + [None, "", "b" * 11, "c"])], names=["call_id", "transcript"])
    parts = list(shared.sliced([batch, batch.slice(0, 0)]))
    assert len(parts) > 1 and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])


def test_mostly_one_character(spark):
    """Against the count of each character, at the edges of seven tenths and of 20 characters."""
    texts = ["a" * i + "bc" * j for i in range(0, 40) for j in range(0, 9)] + ["ab" * i + "a" * j for i in range(1, 12) for j in range(0, 14)] + [" ".join("aab" * 9 + "é" * n) for n in (20, 60, 80)] + ["😀" * 30 + "x y", " " * 30 + "ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tones_only(F.col("t")).alias("v")).collect()

    def wanted(text):
        solid = "".join(c for c in text if c not in " \t\n\x0b\f\r")
        words = [w for w in text.split(" ") if w]
        return len(text.strip(" ")) < 10 or max((solid.count(c) for c in solid), default=0) > len(solid) * 0.7 or len(words) >= 3 and len({w.lower() for w in words if len(w) > 1}) < 2

    assert {r.t: r.v for r in got} == {t: wanted(t) for t in texts}
