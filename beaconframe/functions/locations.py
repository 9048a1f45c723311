"""Addresses, cross streets, apartments and place names in transcripts: spans over tokens, ranked rules, one fold.

A text becomes tokens, a line break among them, so that nothing goes on over it; and tokens become atoms: a house number, a street (known,
or named with its type), a numbered route, a known place.  A rule is a sequence of
atoms and words; every place where one fits is a candidate with its span, its rank
and what it says.  Candidates are taken in the order of rank and place, and none may
overlap one taken before.  What is taken for an address then has to be found again
in the transcript by alignment, and must not be something else that looks like one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import ship
from .address import may_have_location
from .automaton import upper
from .units import edits

TYPES = frozenset("RD ROAD ST STREET AVE AVENUE DR DRIVE LN LANE CT COURT BLVD BOULEVARD PL PLACE PT POINT WAY CIR CIRCLE TRL TRAIL TERR TER HWY HIGHWAY PKWY PARKWAY RUN".split())
DIRECTIONS = frozenset("N S E W NORTH SOUTH EAST WEST NORTHEAST NORTHWEST SOUTHEAST SOUTHWEST NE NW SE SW".split())
_NO_STEM = TYPES | DIRECTIONS
#: Words that no street name holds; a name ends before them.
STOPS = frozenset("THE A AN AT ON IN OF NEAR BY OFF AND OR TO FOR WITH IS ARE FROM CROSS CROSSES BETWEEN RESPOND GO AROUND ACROSS THAT TIME YOUR WE YOU THEY IT S HAS HAVE RESPONDED UNIT ENGINE MEDIC STATION SQUAD APARTMENT APT ROOM SUITE LOT".split())
ROUTES = {("STATE", "ROUTE"): "SR", ("SR",): "SR", ("ROUTE",): "SR", ("RT",): "SR", ("US", "ROUTE"): "US", ("US",): "US", ("INTERSTATE",): "I", ("I",): "I", ("COUNTY", "ROAD"): "CR", ("CR",): "CR"}
_ROUTE_HEADS = frozenset(k[0] for k in ROUTES)
ROOMS = frozenset("APARTMENT APT UNIT ROOM SUITE LOT BUILDING".split())
FACILITIES = frozenset("SCHOOL CHURCH HOSPITAL PLAZA PARK APARTMENTS MANOR MOTEL HOTEL LIBRARY CLINIC MALL".split())
#: What may follow a pair of bare street names: then they are a place, and not two things in a sentence.
AFTER = frozenset(["FOR", "TIME", ",", ".", "\n", ""])

_TOKEN = re.compile(r"[A-Z0-9]+(?:['-][A-Z0-9]+)*|[,.;&\n]")


@dataclass(frozen=True)
class Gazetteer:
    """Known streets by full name, and known places."""

    streets: tuple[str, ...] = ()
    places: tuple[str, ...] = ()


@dataclass
class Atom:
    kind: str
    last: int
    value: str


@dataclass
class Span:
    """What a rule found in tokens first..last."""

    rank: int
    first: int
    last: int
    found: dict[str, str]


class Names:
    """A gazetteer by words: full names, and names without their type, which stand for the full one where only one has them."""

    def __init__(self, known: Gazetteer):
        self.streets: dict[tuple[str, ...], str] = {}
        bare: dict[tuple[str, ...], list[str]] = {}
        for street in known.streets:
            words = tuple(street.upper().split())
            self.streets[words] = " ".join(words)
            if len(words) > 1 and words[-1] in TYPES:
                bare.setdefault(words[:-1], []).append(" ".join(words))
        for words, full in bare.items():
            self.streets.setdefault(words, full[0] if len(set(full)) == 1 else " ".join(words))
        self.places = {tuple(p.upper().split()): p.upper() for p in known.places}
        self.longest = max(map(len, [*self.streets, *self.places]), default=0)
        self.heads = {k[0] for k in [*self.streets, *self.places] if k}

    def at(self, words: list[str], i: int) -> Atom | None:
        for n in range(min(self.longest, len(words) - i), 0, -1):
            key = tuple(words[i : i + n])
            if key in self.streets:
                return Atom("street", i + n - 1, self.streets[key])
            if key in self.places:
                return Atom("place", i + n - 1, self.places[key])
        return None


_names = lru_cache(maxsize=8)(Names)


def atoms_of(words: list[str], names: Names) -> dict[int, list[Atom]]:
    """Atoms by the token that they begin with."""
    out: dict[int, list[Atom]] = {}
    for i, w in enumerate(words):
        if w in names.heads and (known := names.at(words, i)):
            out.setdefault(i, []).append(known)
        for head, short in ROUTES.items() if w in _ROUTE_HEADS else ():
            if tuple(words[i : i + len(head)]) == head and i + len(head) < len(words) and re.fullmatch(r"\d{1,3}", words[i + len(head)]):
                out.setdefault(i, []).append(Atom("route", i + len(head), f"{short} {words[i + len(head)]}"))
        if w[0].isdigit() and re.fullmatch(r"\d{1,6}|\d{1,3}-\d{1,3}", w):
            out.setdefault(i, []).append(Atom("house", i, w.replace("-", "")))
        if w in TYPES and i and words[i - 1].isalnum():
            first = i
            while first and i - first < 3 and re.fullmatch(r"[A-Z][A-Z'-]*|\d+(?:ST|ND|RD|TH)", words[first - 1]) and words[first - 1] not in STOPS | TYPES:
                first -= 1
            last = i + 1 if i + 1 < len(words) and words[i + 1] in DIRECTIONS and len(words[i + 1]) > 1 else i
            for start in range(first, i):
                out.setdefault(start, []).append(Atom("named", last, " ".join(words[start : last + 1])))
        if w in FACILITIES and i and words[i - 1] not in STOPS and words[i - 1].isalpha():
            start = i - 1
            while start and i - start < 4 and words[start - 1].isalpha() and words[start - 1] not in STOPS | TYPES:
                start -= 1
            out.setdefault(start, []).append(Atom("facility", i, " ".join(words[start : i + 1])))
    return out


ANY = ("street", "named", "route")
_AND, _IN, _COMMA, _AT = ({"AND", "&"},), ({"IN"},), ({","},), ({"AT"},)
#: rank, the sequence (a tuple names kinds of atoms, a set words), what becomes of the atoms' values, and whether a cue must follow.
RULES: tuple[tuple[int, tuple, str, bool], ...] = (
    (1, (("house",), ("route",), {"BETWEEN"}, ANY, *_AND, ANY), "house route", False),
    (2, (("house",), ("street",)), "house", False),
    (3, ({"OFF"}, {"OF"}, ("street", "named")), "street", False),
    (4, (("street",), *_AND, ("street", "route")), "pair", True),
    (4, (("route",), *_AND, ("street",)), "pair", True),
    (5, (("street",), *_IN, ("street",)), "pair", True),
    (6, (("street",), *_COMMA, ("street",)), "pair", True),
    (7, (("house",), ("named",)), "house", False),
    (8, (("house",), ("route",)), "house", False),
    (9, (ANY, *_AT, ANY), "pair", False),
    (9, (("named", "route"), *_AND, ("named", "route")), "pair", False),
    (20, ({"CROSS", "CROSSES"}, {"OF", "IS", "ARE", "STREETS"}, ANY, *_AND, ANY), "crosses", False),
    (20, ({"BETWEEN"}, ANY, *_AND, ANY), "crosses", False),
    (20, ({"CROSSROADS"}, {"OF", "ARE"}, ANY, {"AND", "&", ","}, ANY), "crosses", False),
    (21, ({"CROSS", "CROSSES"}, {"OF", "IS", "ARE", "STREET"}, ANY), "cross", False),
    (30, (ROOMS, ("room",)), "room", False),
    (40, (("place",),), "place", False),
    (41, ({"AT"}, {"THE"}, ("facility",)), "place", False),
    (42, ({"AT"}, ("facility",)), "place", False),
)


def _fits(words: list[str], atoms: dict[int, list[Atom]], i: int, sequence: tuple) -> Iterator[tuple[int, list[str]]]:
    """(token after it, values of its atoms) for each way in which a sequence fits at a token."""
    if not sequence:
        yield i, []
        return
    head, rest = sequence[0], sequence[1:]
    if isinstance(head, tuple):
        if head == ("room",) and i < len(words) and re.fullmatch(r"[A-Z]?\d+[A-Z]?|[A-Z]", words[i]):
            yield from ((end, [words[i], *more]) for end, more in _fits(words, atoms, i + 1, rest))
        for atom in atoms.get(i, ()):
            if atom.kind in head:
                yield from ((end, [atom.value, *more]) for end, more in _fits(words, atoms, atom.last + 1, rest))
    elif i < len(words) and words[i] in head:
        yield from ((end, [words[i], *more]) for end, more in _fits(words, atoms, i + 1, rest))


def _says(kind: str, v: list[str]) -> dict[str, str]:
    if kind == "house route":
        return {"address": f"{v[0]} {v[1]}", "cross_1": v[3], "cross_2": v[5]}
    if kind == "house":
        return {"address": " ".join(v)}
    if kind == "street":
        return {"address": v[2]}
    if kind == "pair":
        return {"address": f"{v[0]} & {v[2]}"}
    if kind in ("crosses", "cross"):
        streets = [x for x in v if x not in ("AND", "&", ",") and len(x) > 1][-(2 if kind == "crosses" else 1) :]
        return {f"cross_{i}": s for i, s in enumerate(streets, 1)}
    return {"apartment": " ".join(v)} if kind == "room" else {"place": v[-1]}


def spans_of(words: list[str], known: Gazetteer) -> list[Span]:
    """All candidates of all rules."""
    atoms = atoms_of(words, _names(known))
    starts = sorted(set(atoms) | {i for i, w in enumerate(words) if w in ROOMS or w in ("OFF", "CROSS", "CROSSES", "BETWEEN", "CROSSROADS", "AT")})
    out = []
    for i in starts:
        for rank, sequence, kind, cue in RULES:
            for end, values in _fits(words, atoms, i, sequence):
                after = words[end] if end < len(words) else ""
                aged = after.isdigit() and words[end + 1 : end + 2] == ["YEAR"]
                if not cue or after in AFTER or aged:
                    out.append(Span(rank, i, end - 1, _says(kind, values)))
    return out


def extract(text: str, known: Gazetteer) -> dict[str, str]:
    """address, cross_1, cross_2, apartment and place, those that there are.

    The longer of two candidates of one rank at one place counts.  Two cross streets
    without an address are the address.
    """
    return _extract(_TOKEN.findall(upper(text)), known)


def _extract(words: list[str], known: Gazetteer) -> dict[str, str]:
    spans = spans_of(words, known)
    # A pair that a transcript calls cross streets is no intersection of its own.
    crosses = [s for s in spans if "cross_2" in s.found]
    spans = [s for s in spans if " & " not in s.found.get("address", "") or not any(c.first < s.first and s.last <= c.last for c in crosses)]
    out: dict[str, str] = {}
    taken: list[Span] = []
    for span in sorted(spans, key=lambda s: (s.rank, s.first, -s.last)):
        new = {k: v for k, v in span.found.items() if k not in out}
        if new and not any(span.first <= t.last and t.first <= span.last for t in taken):
            out |= new
            taken.append(span)
    if "address" not in out and "cross_2" in out:
        out["address"] = f"{out['cross_1']} & {out['cross_2']}"
    return out


# Guards -------------------------------------------------------------------------

#: Narrative after a street that is no part of it.
TAILS = re.compile(r"\s+(?:ASSISTED LIVING|NURSING HOME|NO CONTACT|CROSSROADS OF|CROSSES OF|ADVISED|IN REFERENCE|FOR A)\b.*$")


def tidy(address: str) -> str:
    return TAILS.sub("", upper(address).strip())


@lru_cache(maxsize=1 << 18)
def _alike(a: str, b: str) -> bool:
    """Equal, or one misheard letter (two in words of eight letters and more); numbers only equal."""
    return a == b or min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and a.isalpha() and b.isalpha() and edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 8 else 1)


def alignment(wanted: list[str], said: list[str]) -> tuple[int, int, int]:
    """The best local alignment of the address's words with the transcript's: how many match, and the first and the last word said (-1 without any).

    A match gives three, each word left out on either side takes one.  So no alignment
    reaches farther from a match than three times the address's length, and what lies
    beyond that is left out.
    """
    lengths = {len(w) + d for w in wanted for d in (-2, -1, 0, 1, 2)}
    near = {s for s in set(said) if len(s) in lengths and any(_alike(w, s) for w in wanted)}
    reach, best, start = 3 * len(wanted), (0, 0, -1, -1), None
    places = [j for j, s in enumerate(said) if s in near]
    for j, after in zip(places, [*places[1:], len(said) + 2 * reach + 1]):
        start = j if start is None else start
        if after - j > reach:
            score, n, first, last = _aligned_part(wanted, said[start : j + 1])
            best = max(best, (score, n, first + start, last + start), key=lambda o: (o[0], -o[2]))
            start = None
    return best[1:]


def _aligned_part(wanted: list[str], said: list[str]) -> tuple[int, int, int, int]:
    """The score, and as in `alignment`."""
    best = (0, 0, -1, -1)
    row = [(0, 0, -1, -1)] * (len(said) + 1)
    for w in wanted:
        new = [(0, 0, -1, -1)]
        for j, s in enumerate(said, 1):
            score, n, first, _ = row[j - 1]
            options = [(0, 0, -1, -1)]
            if _alike(w, s):
                options.append((score + 3, n + 1, first if n else j - 1, j - 1))
            for x in (row[j], new[j - 1]):
                if x[0] > 1:
                    options.append((x[0] - 1, *x[1:]))
            new.append(max(options, key=lambda o: (o[0], -o[2])))
        row = new
        best = max([best, *row], key=lambda o: (o[0], -o[2]))
    return best


def aligned(address: str, transcript: str) -> bool:
    """Whether the address was said: its number as such, or as a pair around a hyphen; and each word of the street's name, in one place."""
    return _aligned(address, _TOKEN.findall(upper(transcript)))


def _aligned(address: str, tokens: list[str]) -> bool:
    said = [w for token in tokens for w in ([token.replace("-", ""), *token.split("-")] if "-" in token else [token])]
    for side in tidy(address).split(" & "):
        words = side.split()
        number = words[0] if len(words) > 1 and words[0].isdigit() else ""
        if number and number not in said:
            return False
        if len(words) > 1 and words[-2] in ROUTES.values() and words[-1].isdigit():
            if words[-1] not in said:
                return False
            continue
        stem = [w for w in words[bool(number) :] if w not in _NO_STEM]
        if not stem or alignment(stem, [w for w in said if w not in _NO_STEM])[0] < len(stem):
            return False
    return True


#: What stands before or after a number that is no house number.
_BEFORE = {
    "time": re.compile(r"\bTIME (?:IS |OF CALL )?$"),
    "unit": re.compile(r"\b(?:ENGINE|MEDIC|SQUAD|TRUCK|LADDER|RESCUE|TANKER|BATTALION|CAR) $"),
    "plate": re.compile(r"\b(?:PLATE|REGISTRATION|LICENSE)(?: NUMBER| OF)? [A-Z0-9 -]{0,12}$"),
    "vitals": re.compile(r"\b(?:PULSE|BLOOD PRESSURE|OXYGEN|PAIN)(?: IS| OF| AT)? $"),
}
_AFTER = {
    "age": re.compile(r"[- ]YEAR\b"),
    "vehicle": re.compile(r" (?:FORD|CHEVY|CHEVROLET|HONDA|TOYOTA|DODGE|JEEP|NISSAN|BUICK|KIA|GMC)\b"),
}
#: Letters of a transcript that are looked at on each side of a number.
_AROUND = 60
_BLOCKED = re.compile(r"\b(?:STAND DOWN|DISREGARD|CANCEL(?:LED)?|RADIO TEST)\b")
NOISE = re.compile(r"\b(?:OKAY|COPY THAT|THANK YOU|YEAH|UH|STAND BY|GO AHEAD)\b")
PLATE = re.compile(r"[A-Z]{2,3}[ -]?\d{3,4}|\d{3,4}[ -]?[A-Z]{2,3}")
UNIT = re.compile(r"\W*(?:ENGINE|MEDIC|SQUAD|TRUCK|UNIT|STATION|CAR|LADDER|RESCUE)\W+\d{1,4}\W*")


def rejected(address: str, transcript: str) -> str:
    """Why an address is no dispatched location, or ''.

    A house number before a street with its type was said as a location, so what else
    the transcript tells does not count against it.
    """
    return _rejected(tidy(address), _TOKEN.findall(upper(transcript)))


def _places(number: str, said: str) -> list[tuple[str, str]]:
    """What stands before and after each place of a number that is not part of a word."""
    out, at = [], said.find(number)
    while at >= 0:
        end = at + len(number)
        if not (said[at - 1 : at].isalnum() or said[end : end + 1].isalnum()):
            out.append((said[max(at - _AROUND, 0) : at], said[end : end + _AROUND]))
        at = said.find(number, end)
    return out


def _rejected(up: str, tokens: list[str]) -> str:
    said = " ".join(tokens)
    if len(up) < 3 or not re.search("[A-Z]", up) or re.search(r"\b(\w+) \1 \1\b", up):
        return "malformed"
    for name, pattern in (("noise", NOISE.search), ("plate", PLATE.fullmatch), ("unit", UNIT.fullmatch)):
        if pattern(up):
            return name
    if not _aligned(up, tokens):
        return "not said"
    words = up.split()
    typed = words[-1] in TYPES or len(words) > 2 and words[-2] in TYPES
    places = _places(words[0], said) if words[0].isdigit() else []
    starts = lambda n: n[:1] == words[1:2] or n[1:2] == words[1:2] and n[0].isalpha()
    near = [(before, after) for before, after in places if starts(after.split())]
    strong = (typed or len(words) > 2) and bool(near)
    # A number that is said with the street counts there alone, and once without a doubt is enough.
    counted, enough = (near, all) if strong else (places, any)
    for name, pattern in _BEFORE.items():
        if places and (name != "unit" or len(words[0]) < 4) and enough(bool(pattern.search(before)) for before, _ in counted):  # no unit has a longer number
            return name
    for name, pattern in _AFTER.items():
        if places and enough(bool(pattern.match(after)) for _, after in counted):
            return name
    return "cancelled" if not strong and _BLOCKED.search(said) else ""


FIELDS = ("address", "cross_1", "cross_2", "apartment", "place")


def locations(transcripts: DataFrame, known: Gazetteer) -> DataFrame:
    """call_id, the FIELDS (null where there is none) and rejected (why the address is no location, or null), for the transcripts that may name a place.

    Texts without any sign of a location are left out before a worker sees them.  Null
    and empty transcripts give no row.  Other columns are not read.
    """
    ship(transcripts.sparkSession)
    kind = transcripts.schema["call_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for call, value in zip(batch.column("call_id").to_pylist(), batch.column("transcript")):
                words = _TOKEN.findall(upper(value.as_py()))
                if found := _extract(words, known):
                    rows.append((call, *map(found.get, FIELDS), "address" in found and _rejected(tidy(found["address"]), words) or None))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(columns[0], batch.schema.field("call_id").type), *[pa.array(c, pa.string()) for c in columns[1:]]], names=["call_id", *FIELDS, "rejected"])

    stems = sorted({" ".join(k) for k in _names(known).streets} | set(known.places))
    may = transcripts.select("call_id", "transcript").where("transcript is not null")
    screened = may.where(may_have_location(may.transcript) | may.transcript.rlike(_screen(stems)))
    return screened.mapInArrow(run, f"call_id {kind}, " + ", ".join(f"{f} string" for f in (*FIELDS, "rejected")))


def _screen(names: list[str]) -> str:
    """A pattern for the gazetteer's names and other words that a rule begins with."""
    own = [rf"{re.escape(n)}" for n in names] + sorted(ROOMS | FACILITIES | {"CROSSES", "BETWEEN", "CROSSROADS"})
    return rf"(?i)\b(?:{'|'.join(own)})\b"
