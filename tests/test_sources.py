"""File readers, labels and units on small vectors."""

from pyspark.sql import functions as F

from beaconframe.functions import nature, units
from beaconframe.sources import files


def one(spark, columns, **given):
    frame = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return frame.select(*[c.alias(n) for n, c in columns.items()]).collect()[0].asDict()


def test_masks(spark):
    got = one(spark, files.parse_mask(F.col("x"), "#DATE_#TIME_#TGAFS_#MHZ_#UNITLBL"), x="2024-01-02_10-20-30_01-123_154.25_Engine 7.mp3")
    assert got["talkgroup"] == (1 << 7) | 123 and got["frequency"] == 154_250_000 and got["unit_label"] == "Engine 7"
    assert got["ts_ms"] == 1704190830000 and got["system"] is None
    assert set(one(spark, files.parse_mask(F.col("x"), "#SYS_#TG"), x="nothing like it").values()) == {None}
    assert files.compile_mask("#UNIT_#UNITLBL")[1] == ["#UNIT", "#UNITLBL"]


def test_recorder_json(spark):
    text = '{"freqList":[{"freq":1,"len":2.0},{"freq":9}],"patched_talkgroups":[0,7],"srcList":[{"src":-1},{"src":5,"pos":0.5}],"start_time":3,"talkgroup":4}'
    p = one(spark, {"p": files.parse_recorder(F.col("x"))}, x=text)["p"]
    assert (p.frequency, p.patches, [u.src for u in p.units], p.ts_ms, p.talkgroup) == (1, [7], [5], 3000, 4)
    empty = one(spark, {"p": files.parse_recorder(F.col("x"))}, x="{}")["p"]
    assert empty.patches == [] and empty.units == [] and empty.ts_ms is None


def test_lists(spark, tmp_path):
    (tmp_path / "tg.csv").write_text("Decimal,Hex,Label,Mode,Name,Tag,Group\n1,a,One,D,First,fire,A\n1,a,Again,D,x,x,x\n2,b,Two,D,Second,ems,B\n")
    got = files.talkgroup_list(spark, str(tmp_path / "tg.csv")).orderBy("ref").collect()
    assert [(r.ref, r.label, r.tag, r.groups) for r in got] == [("1", "One", "fire", "A"), ("2", "Two", "ems", "B")]
    (tmp_path / "tones.csv").write_text("Name,A Tone,b-tone,Tol\nMedic,600,900,10\n,500,700,\nbad,,900,\nnone,,,x\n")
    got = {r.label: (r.a, r.b, r.tolerance, r.warning) for r in files.tone_list(spark, str(tmp_path / "tones.csv")).collect()}
    assert got == {"Medic": (600.0, 900.0, 10.0, None), "500.0/700.0": (500.0, 700.0, None, None), "bad": (None, 900.0, None, "B tone without A tone"), "none": (None, None, None, "no tones")}
    assert files.header_key("A-Tone_ Hz") == "atonehz"


def test_nature(spark):
    calls = spark.createDataFrame([(1, "smoke from a house fire on main"), (2, "car alarms going off"), (3, ""), (4, None), (5, "working back there")], "call_id bigint, transcript string")
    phrases = spark.createDataFrame([("FIRE", "house fire"), ("FIRE", "smoke"), ("ALARM", "alarm"), ("WORK", "works")], "label string, phrase string")
    scores = {(r.call_id, r.label): r.score for r in nature.evidence(calls, phrases).collect()}
    assert scores == {(1, "FIRE"): 4, (2, "ALARM"): 1}
    best = {r.call_id: r.label for r in nature.best_label(nature.evidence(calls, phrases)).collect()}
    assert best == {1: "FIRE", 2: "ALARM"}
    said = lambda t, n: one(spark, {"v": nature.with_fallback(nature.sanitise(F.col("t"), F.col("n")))}, t=t, n=n)["v"]
    assert said("burglar alarm at the store", "ALARM DROP MEDICAL") == "BURGLARY"
    assert said("medical alarm at 5 main", "BURGLARY") == "ALARM DROP MEDICAL"
    assert said("plate comes back to a ford", "TRAFFIC STOP") == nature.UNKNOWN
    assert said("Engine 12 on scene", "STRUCTURE FIRE") == nature.UNKNOWN


def test_units():
    words = units.UnitWords(types=(units.FuzzyWord("ENGINE", 2, ("ENGIN",)), units.FuzzyWord("MEDIC", 1, (), ("MAGIC",))), prefixes=(units.FuzzyWord("CITY", 0),))
    text = "city engine 07 and medik 12, magic 9, engin 1234, Engin 3"
    found = units.find_units(text, words)
    assert [f[0] for f in found] == ["CITY ENGINE 7", "MEDIC 12", "ENGINE 3"]
    assert units.corrected(text, found).startswith("CITY ENGINE 7 and MEDIC 12, magic")
    assert units.edits("abc", "abd", 1) == 1 and units.edits("abc", "xyz", 1) == 2 and units.find_units("", words) == []
