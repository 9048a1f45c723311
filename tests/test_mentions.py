"""Misheard words in transcripts: the index against all pairs, mentions against known sentences, planted spans in whole documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from beaconframe.functions import fuzzy, mentions, units
from beaconframe.functions.units import FuzzyWord as W

SETTINGS = mentions.Settings(
    types=(W("ENGINE", 2, ("ENGIN",)), W("MEDIC", 1), W("RESCUE", 1, (), ("ELEVATOR",)), W("MEDIC ENGINE", 1)),
    prefixes=(W("CITY", 0), W("COUNTY", 1)),
    dispatches=(W("VECC", 1, ("DECK",)), W("METRO", 1)),
    separators=(W("FIRE", 1), W("OPS", 0)),
    shorthands=(mentions.Shorthand("TAC", "METRO", "OPS"),),
    corrections=(W("MAHONING", 2), W("LORDSTOWN", 2, ("LORDS TOWN",))),
)


def slow_match(token, words):
    plain = [w.word.replace(" ", "") for w in words]
    for i, w in enumerate(plain):
        if w == token:
            return i, 0
    for i, w in enumerate(words):
        if token in [a.replace(" ", "") for a in w.aliases]:
            return i, 0
    near = [(units.edits(token, p, w.distance), i) for i, (p, w) in enumerate(zip(plain, words)) if w.distance]
    near = [(d, i) for d, i in near if d <= words[i].distance]
    return (min(near)[1], min(near)[0]) if near else (-1, 0)


def test_index_finds_what_all_pairs_find():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("ABCDE") for _ in range(n))
    words = tuple(W(make(rng.randint(1, 9)), rng.choice([0, 1, 1, 2, 3]), (make(4),)) for _ in range(300))
    tokens = list({make(rng.randint(1, 11)) for _ in range(1500)} | {w.word for w in words})
    found, distance = fuzzy.Index(words).match([t.encode() for t in tokens])
    assert list(zip(found.tolist(), distance.tolist())) == [slow_match(t, words) for t in tokens]
    a = fuzzy._matrix([t.encode() for t in tokens[:500]] + [b""])
    b = fuzzy._matrix([t.encode() for t in tokens[500:1000]] + [b"AB"])
    want = [units.edits(x, y, 99) for x, y in zip([*tokens[:500], ""], [*tokens[500:1000], "AB"])]
    assert fuzzy.edit_distances(*a, *b).tolist() == want


def slow_candidates(text, words):
    tokens = [m.group() for m in units.TOKEN.finditer(text)]
    for i in range(len(tokens)):
        for m in range(3):
            run = tokens[i : i + m + 1]
            if len(run) <= m or any(t.isdigit() for t in run):
                break
            word, distance = slow_match("".join(run), words)
            if word >= 0:
                yield i, i + m, word, distance
                break


def test_candidates():
    rng = random.Random(2)
    pool = ["ENG", "INE", "ENGIN", "ENGNE", "MEDIC", "MEDIK", "12", "A", "RESCU", "MED", "IC", "-", "É", "TOWN", "LORDS"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    tokens = fuzzy.tokens_of([t.encode() for t in texts])
    words = SETTINGS.types + SETTINGS.corrections
    got = fuzzy.Index(words).candidates(tokens)
    for doc, text in enumerate(texts):
        at = tokens.of(doc).start
        assert [(a - at, b - at, w, d) for a, b, w, d in got.get(doc, [])] == list(slow_candidates(text, words))


def said(text):
    return [(m.kind, m.name, m.fuzzy, [mentions._plain(r) for r in m.raw]) for _, found, _ in mentions.mentions_of([text], SETTINGS) for m in found]


def test_units():
    assert said("city engine 5 and Engine 12") == [("unit", "CITY ENGINE 5", False, ["CITY ENGINE 5"]), ("unit", "ENGINE 12", False, ["ENGINE 12"])]
    assert said("respond enjine 7, é medik-12") == [("unit", "ENGINE 7", True, ["ENJINE 7"]), ("unit", "MEDIC 12", True, ["MEDIK-12"])]
    assert said("conty eng ine 3") == [("unit", "COUNTY ENGINE 3", True, ["CONTY ENG INE 3"])]
    assert said("conty engine 3") == [("unit", "COUNTY ENGINE 3", False, ["CONTY EN"])]  # as many letters as were said without the prefix
    assert said("elevator rescue, 123 main") == [] and said("elevator rescue 123 main") == [] and said("rescue 1234") == []
    assert said("engine 5 engine  5") == [("unit", "ENGINE 5", False, ["ENGINE 5", "ENGINE  5"])]
    assert said("medic engine 4") == [("unit", "MEDIC ENGINE 4", False, ["MEDIC ENGINE 4"])]
    assert said("") == [] and said("engine") == [] and said("12 engine") == []


def test_channels():
    assert said("switch to deck fire 3") == [("channel", "VECC FIRE 3", True, ["DECK FIRE 3"])]
    assert said("metro ops 12, tac-4 tac5 tac 6") == [("channel", "METRO OPS 12", False, ["METRO OPS 12"]), ("channel", "METRO OPS 6", False, ["TAC 6"]), ("channel", "METRO OPS 4", False, ["TAC-4"]), ("channel", "METRO OPS 5", False, ["TAC5"])]
    assert said("metro 12") == [] and said("metro ops 123") == []


def test_corrections_and_annotations(spark):
    assert mentions.corrected_texts(["to mahonning and lords town now", "é lordstwn", "nothing", ""], SETTINGS) == ["TO MAHONING AND LORDSTOWN NOW", "É LORDSTOWN", "nothing", ""]
    rows = [(1, "é mahonning enjine 5 deck, fire 3 engine 5", 7), (2, None, 7), (3, "", 7), (None, "medic 1", 7)]
    frame = spark.createDataFrame(rows, "call_id bigint, transcript string, start int")
    got = sorted(map(tuple, mentions.annotations(frame, SETTINGS).collect()), key=str)
    text = "É MAHONING ENGINE 5 VECC FIRE 3 ENGINE 5"
    assert [text[r[3] : r[4]] for r in got if r[0] == 1] == [r[2] for r in got if r[0] == 1] and sorted(r[2] for r in got) == ["ENGINE 5", "ENGINE 5", "MEDIC 1", "VECC FIRE 3"]
    assert mentions.corrected(frame, SETTINGS).count() == 4 and mentions.mentions(frame.limit(0), SETTINGS).count() == 0


def test_planted_in_whole_documents(spark, sf):
    """All mentions of a list of a thousand words, each misheard by one letter, in whole documents."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("BCDFGHJKLMNPQRSTVWXZ"), 9)) for _ in range(1000)]
    settings = mentions.Settings(types=tuple(W(w, 1) for w in words))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows, want = [], set()
    for r in docs:
        word, cut = words[r.doc_id % 1000], r.doc_id * 37 % (len(r.text) + 1)
        rows.append((r.doc_id, f"{r.text[:cut]}\n{word[:3]}{word[4:].lower()} {r.doc_id % 900}\n{r.text[cut:]}"))
        want.add((r.doc_id, word, str(r.doc_id % 900)))
    frame = spark.createDataFrame(rows, "call_id bigint, transcript string").repartition(4)
    got = mentions.mentions(frame, settings).where("kind = 'unit'").select("call_id", "second", "number").collect()
    assert {tuple(r) for r in got} == want
    assert mentions.mentions(frame, settings).where(F.col("fuzzy")).count() == len(want)
