"""Unit and channel mentions in transcripts, with tolerance for misheard words.  One pass of Python for each batch of rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FuzzyWord:
    """A word to look for: exact, by an alias, or at most ``distance`` edits away; never one of ``reject``."""

    word: str
    distance: int = 1
    aliases: tuple[str, ...] = ()
    reject: tuple[str, ...] = ()


@dataclass(frozen=True)
class UnitWords:
    types: tuple[FuzzyWord, ...]
    prefixes: tuple[FuzzyWord, ...] = field(default=())


TOKEN = re.compile(r"[A-Z]+|\d+")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return min(row[-1], most + 1)


def match_word(token: str, words: tuple[FuzzyWord, ...]) -> FuzzyWord | None:
    """The word that a token stands for: exact first, then an alias, then the nearest within its distance."""
    for w in words:
        if token == w.word:
            return w
    for w in words:
        if token in w.aliases:
            return w
    near = [(edits(token, w.word, w.distance), i, w) for i, w in enumerate(words) if token not in w.reject and len(token) >= 3]
    near = [n for n in near if n[0] <= n[2].distance]
    return min(near)[2] if near else None


def find_units(text: str, words: UnitWords) -> list[tuple[str, str, int, int]]:
    """(unit, as said, start, end) for each mention: a type and a number of up to three digits after it, with the prefix before it if there is one."""
    up = text.upper()
    tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(up)]
    used: set[int] = set()
    found = []
    for exact in (True, False):
        for i in range(len(tokens) - 1):
            kind = match_word(tokens[i][0], words.types)
            number = tokens[i + 1][0]
            if kind is None or (tokens[i][0] == kind.word) != exact or {i, i + 1} & used or not number.isdigit() or len(number) > 3:
                continue
            prefix = match_word(tokens[i - 1][0], words.prefixes) if i and i - 1 not in used else None
            first = i - 1 if prefix else i
            used.update(range(first, i + 2))
            name = " ".join(x for x in (prefix.word if prefix else "", kind.word, number.lstrip("0") or "0") if x)
            found.append((name, up[tokens[first][1] : tokens[i + 1][2]], tokens[first][1], tokens[i + 1][2]))
    return sorted(found, key=lambda f: f[2])


def corrected(text: str, found: list[tuple[str, str, int, int]]) -> str:
    """The text with each mention in its plain spelling; replaced from the right so that places stay valid."""
    for name, _, start, end in sorted(found, key=lambda f: -f[2]):
        text = text[:start] + name + text[end:]
    return text


def unit_mentions(transcripts: DataFrame, words: UnitWords) -> DataFrame:
    """call_id, unit, said, start, stop: a row for each mention in ``transcripts`` (call_id, transcript)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, *hit) for i, text in zip(rows["call_id"], rows["transcript"]) for hit in find_units(text or "", words)]
            yield pd.DataFrame(out, columns=["call_id", "unit", "said", "start", "stop"])

    return transcripts.select("call_id", "transcript").mapInPandas(run, "call_id bigint, unit string, said string, start bigint, stop bigint")
