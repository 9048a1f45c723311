"""Many words in one pass over a text: an Aho-Corasick automaton, compiled once in each worker.

Keyword lists and category lists are configuration, so their size is the caller's;
they travel with the plan.  Positions and contexts count bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, sliced

AROUND = 50
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


@lru_cache(maxsize=1)
def _capitals() -> dict[int, str]:
    """Letters and their capitals, where those take as many bytes."""
    return {i: c.upper() for i in range(0x61, 0x2D30) if not (c := chr(i)).isupper() and c.upper() != c and len(c.upper()) == 1 and len(c.upper().encode()) == len(c.encode())}


def upper(text: str) -> str:
    """Upper case without any change of places: a letter whose capital is longer or shorter stays."""
    if text.isascii():
        return text.upper()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_capitals())
    return "ß".join(part.upper() for part in text.split("ß"))  # the only one of these that changes its length


def _bytes(text: str) -> str:
    """The text's UTF-8 bytes, as a string with a character for each."""
    return text.encode().decode("latin-1")


@lru_cache(maxsize=8)
def _compiled(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    """Words in upper case; each with its length in bytes and the keywords as written."""
    spelled: dict[str, list[str]] = {}
    for k in keywords:
        if k.strip():
            spelled.setdefault(_bytes(upper(k.strip())), []).append(k)
    found = ahocorasick.Automaton()
    for word, written in spelled.items():
        found.add_word(word, (len(word), tuple(written)))
    if len(found):
        found.make_automaton()
    return found


def find_keywords(text: str, keywords: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
    """(keyword as written, position, length) for all whole-word matches, whatever their case; those of one keyword do not overlap.

    A match begins and ends where an ASCII letter, digit or `_` meets anything else.
    """
    automaton = _compiled(keywords)
    if not len(automaton):
        return
    up = _bytes(upper(text))
    free: dict[tuple[str, ...], int] = {}
    for last, (length, written) in automaton.iter(up):
        start, stop = last + 1 - length, last + 1
        if (start > 0 and up[start - 1] in _WORD) == (up[start] in _WORD) or (stop < len(up) and up[stop] in _WORD) == (up[last] in _WORD) or start < free.get(written, 0):
            continue
        free[written] = stop
        for k in written:
            yield k, start, length


def context_of(raw: bytes, position: int, length: int, around: int = AROUND) -> bytes:
    """The match with ``around`` bytes on both sides; dots where that cuts the text."""
    start, stop = max(position - around, 0), min(position + length + around, len(raw))
    return (b"..." if start else b"") + raw[start:stop] + (b"..." if stop < len(raw) else b"")


def keyword_hits(transcripts: DataFrame, keywords: list[str], around: int = AROUND) -> DataFrame:
    """call_id, keyword, position, context (bytes): a row for each match in ``transcripts`` (call_id, transcript).

    Null and empty transcripts, and blank keywords, match nothing.  A keyword that is
    listed twice, or in two spellings, gives a row for each.
    """
    ship(transcripts.sparkSession)
    listed = tuple(keywords)
    kind = transcripts.schema["call_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, words, places, contexts = [], [], [], []
            for call, value in zip(batch.column("call_id").to_pylist(), batch.column("transcript")):
                text = value.as_py()
                if not text:
                    continue
                raw = text.encode()
                for keyword, position, length in find_keywords(text, listed):
                    ids.append(call)
                    words.append(keyword)
                    places.append(position)
                    contexts.append(context_of(raw, position, length, around))
            yield pa.record_batch([pa.array(ids, batch.schema.field("call_id").type), pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(contexts, pa.binary())], names=["call_id", "keyword", "position", "context"])

    return transcripts.select("call_id", "transcript").mapInArrow(run, f"call_id {kind}, keyword string, position long, context binary")


@lru_cache(maxsize=8)
def _grouped(groups: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, words in reversed(list(enumerate(groups, 1))):  # the first group of a word stays
        for w in words:
            found.add_word(w, i)
    found.make_automaton()
    return found


def least_group(text: str, groups: tuple[tuple[str, ...], ...]) -> int | None:
    """The number, from 1, of the first group that the text has a substring of."""
    least = None
    for _, number in _grouped(groups).iter(text):
        if least is None or number < least:
            least = number
            if least == 1:
                break
    return least


def first_group(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """`least_group` of each text; null texts have none."""

    @F.pandas_udf("int")
    def number(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else least_group(t, groups) for t in texts], dtype="Int32")

    return number(text)
