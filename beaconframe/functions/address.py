"""Addresses in transcripts: pre-screening, rule extraction, guards, guarded corrections."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = "STREET|ROAD|AVENUE|DRIVE|LANE|COURT|BOULEVARD|PLACE|TRAIL|HIGHWAY|PARKWAY|CIRCLE|TERRACE|ST|RD|AVE|DR|LN|CT|BLVD|PL|TRL|HWY|PKWY|CIR|TERR"
ROUTES = r"\b(?:STATE ROUTE|ROUTE|INTERSTATE|SR|US|I)[ -]?\d+\b"
HINTS = r"\b(?:ADDRESS|LOCATION|INTERSECTION|CORNER|CROSS|BLOCK OF|AREA OF|MILE MARKER)\b"
NOISE = r"\b(?:OKAY|COPY THAT|THANK YOU|YEAH|UH|STAND BY|GO AHEAD)\b"
# What follows the word before a unit number that is no house number.
UNIT_WORDS = r"\b(?:ENGINE|MEDIC|SQUAD|TRUCK|UNIT|STATION|CAR|LADDER|RESCUE)\b"


def may_have_location(text: Column, streets: list[str] | None = None) -> Column:
    """Whether a street type, a route, a hint, a house number before a word or a known street is in the text."""
    up = F.regexp_replace(F.upper(text), r"[^\x00-\x7F]", "~")  # words are bounded by ASCII letters and digits
    out = up.rlike(rf"\b(?:{TYPES})\b") | up.rlike(ROUTES) | up.rlike(HINTS) | up.rlike(r"\b\d{2,6} [A-Z]{3,}")
    for street in streets or []:
        out = out | F.contains(up, F.lit(street.upper()))
    return out


def extract(text: Column) -> Column:
    """address, cross_streets, apartment and common_name by rules in a fixed order of preference."""
    up = F.upper(text)
    numbered = F.regexp_extract(up, rf"\b(\d{{1,6}} (?:[NSEW] |NORTH |SOUTH |EAST |WEST )?(?:[A-Z0-9]+ ){{1,3}}(?:{TYPES}))\b", 1)
    route = F.regexp_extract(up, rf"(\d{{1,6}} (?:STATE ROUTE|ROUTE|SR|US) \d+)", 1)
    crossing = F.regexp_extract(up, rf"\b((?:[A-Z0-9]+ ){{1,2}}(?:{TYPES})? ?(?:AND|AT) (?:[A-Z0-9]+ ){{1,2}}(?:{TYPES}))\b", 1)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        F.coalesce(blank(numbered), blank(route), blank(crossing)).alias("address"),
        blank(F.regexp_extract(up, rf"\b(?:CROSS OF|CROSSES?|BETWEEN) ((?:[A-Z0-9]+ ){{1,3}}AND (?:[A-Z0-9]+ ?){{1,3}})", 1)).alias("cross_streets"),
        blank(F.regexp_extract(up, r"\b(?:APARTMENT|APT|UNIT|ROOM|SUITE|LOT) #?([A-Z]?\d+[A-Z]?)\b", 1)).alias("apartment"),
        blank(F.regexp_extract(up, r"\bAT (?:THE )?([A-Z]+(?: [A-Z]+)? (?:SCHOOL|CHURCH|HOSPITAL|PLAZA|PARK|APARTMENTS|NURSING HOME))\b", 1)).alias("common_name"),
    )


def is_noise(address: Column) -> Column:
    return F.upper(address).rlike(NOISE)


def is_plate(address: Column) -> Column:
    return F.upper(address).rlike(r"^[A-Z]{2,3}[ -]?\d{3,4}$|^\d{3,4}[ -]?[A-Z]{2,3}$")


def is_unit(address: Column) -> Column:
    return F.upper(address).rlike(rf"^\W*{UNIT_WORDS}\W+\d{{1,4}}\W*$")


def is_malformed(address: Column) -> Column:
    return (F.length(F.trim(address)) < 3) | ~F.upper(address).rlike("[A-Z]") | F.upper(address).rlike(r"\b(\w+) \1 \1\b")


def kept_address(address: Column, transcript: Column) -> Column:
    """The address, or null if a guard rejects it: noise, a plate, a unit, malformed, or a number that was never said."""
    number = F.regexp_extract(address, r"^(\d+)", 1)
    said = F.contains(F.regexp_replace(transcript, "[^0-9]", ""), number)
    bad = is_noise(address) | is_plate(address) | is_unit(address) | is_malformed(address) | ((number != "") & ~said)
    return F.when(~bad, address)


def replace_guarded(text: str, bad: str, correct: str) -> str:
    """Replace whole-word ``bad`` by ``correct``, but where the place lies within ``correct`` already, or where the words around spell its rest."""
    wanted = correct.split()
    out, at = [], 0
    taken = [m.span() for m in re.finditer(rf"\b{re.escape(correct)}\b", text)]
    for m in re.finditer(rf"\b{re.escape(bad)}\b", text):
        inside = any(a <= m.start() and m.end() <= b for a, b in taken)
        after, before = text[m.end() :].split(), text[: m.start()].split()
        tail, head = wanted[len(bad.split()) :], wanted[: -len(bad.split())] if len(wanted) > len(bad.split()) else []
        spelled = bool(tail) and after[: len(tail)] == tail and wanted[: len(bad.split())] == bad.split() or bool(head) and before[-len(head) :] == head and wanted[len(head) :] == bad.split()
        repeats = bool(wanted) and after[:1] == wanted[-1:] and wanted[-1] in TYPES.split("|")
        if inside or spelled:
            continue
        out.append(text[at : m.start()])
        out.append(" ".join(wanted[:-1]) if repeats else correct)
        at = m.end()
    return "".join(out) + text[at:]


def corrected(text: str, pairs: list[tuple[str, str]]) -> str:
    """Ordered corrections; a pair whose correction holds the mistake is applied with the same guards."""
    for bad, good in pairs:
        text = replace_guarded(text, bad, good)
    return text
