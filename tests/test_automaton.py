"""Keyword lists in one pass, against one pattern for each keyword."""

import re

from beaconframe.functions import automaton

KEYWORDS = ["fire", " Fire", "THE THE", "c++", "é", "rd", "a_b", "", "  ", "fire engine", "engine 5"]
TEXTS = ["Fire at the fire, misfire. FIRE", "the the the the", "c++x C++ d", "É e é", "ß fire ß", "a_b xa_b a_b_", "FIRE ENGINE 5", "", "rd. (RD) ord", "x" * 60 + " fire " + "é" * 60, "ﬁre ı fire"]


def slow(text):
    raw = automaton.upper(text).encode().decode("latin-1")
    for k in KEYWORDS:
        word = automaton.upper(k.strip()).encode().decode("latin-1")
        if word:
            for m in re.finditer(rf"(?a:\b){re.escape(word)}(?a:\b)", raw, re.ASCII):
                yield k, m.start(), len(word)


def test_same_as_one_pattern_each():
    for text in TEXTS:
        assert sorted(automaton.find_keywords(text, tuple(KEYWORDS))) == sorted(slow(text))
    assert list(automaton.find_keywords("fire", ())) == []
    assert [len(automaton.upper(t).encode()) for t in TEXTS] == [len(t.encode()) for t in TEXTS]


def test_context():
    raw = TEXTS[9].encode()
    assert automaton.context_of(raw, 61, 4) == b"..." + raw[11:115] + b"..."
    assert automaton.context_of(b"fire", 0, 4) == b"fire"


def test_rows(spark):
    frame = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(TEXTS)] + [(None, None, 1, "p"), (3, TEXTS[3], 2, "q")], "call_id bigint, transcript string, position int, keyword string")
    got = automaton.keyword_hits(frame, KEYWORDS).collect()
    want = [(i, *hit[:2]) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])] for hit in slow(t)]
    assert sorted((r.call_id, r.keyword, r.position) for r in got) == sorted(want)
    assert automaton.keyword_hits(frame.limit(0), KEYWORDS).count() == 0 and automaton.keyword_hits(frame, []).count() == 0


def test_first_group():
    groups = (("structure fire", "smoke"), ("fire",), ("smoke", "gas"))
    assert [automaton.least_group(t, groups) for t in ("a fire, then smoke", "structure fire", "gas", "misfire", "", "none")] == [1, 1, 3, 2, None, None]


def test_both_ways_to_capitals():
    latin = "".join(map(chr, range(0x20, 0x100)))
    assert automaton.upper(latin) == latin.translate(automaton._capitals()) == automaton.upper(latin + "字")[:-1]
    assert automaton.upper("straße ÿ") == "STRAßE Ÿ"
