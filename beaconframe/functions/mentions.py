"""Corrections, units and channels in transcripts, with tolerance for misheard words.

The words are found by `fuzzy.Index` for all texts of an Arrow batch at once; what
is left for each text is to put its few candidates together.  A text without a
candidate before a number costs nothing more.  A line break ends what is said: no
mention goes on over it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import ship, sliced
from .automaton import upper
from .fuzzy import Index, Tokens, tokens_of
from .units import FuzzyWord


@dataclass(frozen=True)
class Shorthand:
    """A label that stands for a dispatch name, and a separator if there is one."""

    label: str
    dispatch: str
    separator: str = ""


@dataclass(frozen=True)
class Settings:
    types: tuple[FuzzyWord, ...] = ()
    prefixes: tuple[FuzzyWord, ...] = ()
    dispatches: tuple[FuzzyWord, ...] = ()
    separators: tuple[FuzzyWord, ...] = ()
    shorthands: tuple[Shorthand, ...] = ()
    corrections: tuple[FuzzyWord, ...] = ()


@dataclass
class Mention:
    """kind (unit or channel), first (prefix or dispatch name), second (type or separator), number, whether fuzzy, and how it was said."""

    kind: str
    first: str
    second: str
    number: str
    fuzzy: bool
    raw: list[str]

    @property
    def name(self) -> str:
        return " ".join(x for x in (self.first, self.second, self.number) if x)


_index = lru_cache(maxsize=16)(Index)


@lru_cache(maxsize=16)
def _pattern(first: tuple[FuzzyWord, ...], second: tuple[FuzzyWord, ...], digits: int, optional: bool) -> re.Pattern:
    either = lambda words: "|".join(re.escape(w.word) for w in words)
    head = f"({either(first)})[^\\S\n]+" if first else "()"
    head = f"(?:{head})?" if optional and first else head
    middle = f"({either(second)})[^\\S\n]+" if second else "()"
    return re.compile(rf"\b{head}{middle}(\d{{1,{digits}}})\b", re.ASCII)


class _Text:
    """One text's tokens and candidates, and which tokens are taken."""

    def __init__(self, up: str, tokens: Tokens, doc: int):
        at, base = tokens.of(doc), int(tokens.base[doc])
        self.offset, self.up = at.start, up
        self.spans = list(zip((tokens.start[at] - base).tolist(), (tokens.stop[at] - base).tolist()))
        self.taken: set[int] = set()
        self.said: dict[tuple, Mention] = {}

    def word(self, i: int) -> str:
        return self.up[slice(*self.spans[i])] if 0 <= i < len(self.spans) else ""

    def free(self, candidates: list, consumed: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Candidates with token numbers of this text, without those that reach into consumed spans."""
        gone = {i for i, (a, _) in enumerate(self.spans) if any(s <= a < e for s, e in consumed)} if consumed else set()
        moved = [(a - self.offset, b - self.offset, w, d) for a, b, w, d in candidates]
        return [c for c in moved if not gone & set(range(c[0], c[1] + 1))]

    def on_line(self, first: int, last: int) -> bool:
        """Whether there are such tokens, with no line break from the first to the last."""
        return last < len(self.spans) and "\n" not in self.up[self.spans[first][0] : self.spans[last][1]]

    def number(self, i: int, digits: int) -> str:
        word = self.word(i)
        return word if word.isdigit() and len(word) <= digits else ""

    def add(self, kind: str, first: str, second: str, number: str, raw: str, fuzzy: bool) -> None:
        m = self.said.setdefault((first, second, number), Mention(kind, first, second, number, fuzzy, []))
        if raw not in m.raw:
            m.raw.append(raw)


def _best(prefixes: list, last: int, taken: set[int]) -> tuple | None:
    """The nearest prefix that ends at a token, the first of equally near ones."""
    return min((p for p in prefixes if p[1] == last and not taken & set(range(p[0], p[1] + 1))), key=lambda p: p[3], default=None)


def units_of(text: _Text, types: list, prefixes: list, settings: Settings) -> list[Mention]:
    """Spelled exactly, then by candidates before a number of three digits at most; then exact ones take a misheard prefix before them."""
    rejects = {w.word: w.reject for w in settings.types}
    consumed = []
    for m in _pattern(settings.prefixes, settings.types, 3, True).finditer(text.up):
        before = text.up[: m.start(1) if m[1] else m.start(2)].rstrip(" ,.")
        if not any(before.endswith(r) for r in rejects[m[2]]):
            text.add("unit", m[1] or "", m[2], m[3], m[0], False)
            consumed.append(m.span())
    prefixes = [p for p in text.free(prefixes, consumed) if text.on_line(p[0], p[1] + 1)]
    for first, last, word, _ in text.free(types, consumed):
        name, number = settings.types[word].word, text.number(last + 1, 3)
        if not number or not text.on_line(first, last + 1) or text.taken & set(range(first, last + 2)) or text.word(first - 1) in rejects[name]:
            continue
        prefix = _best(prefixes, first - 1, text.taken)
        begin = prefix[0] if prefix else first
        text.add("unit", settings.prefixes[prefix[2]].word if prefix else "", name, number, text.up[text.spans[begin][0] : text.spans[last + 1][1]], True)
        text.taken.update(range(begin, last + 2))
    starts = {a: i for i, (a, _) in enumerate(text.spans)}
    for m in list(text.said.values()):
        at = starts.get(text.up.find(m.raw[0]))
        prefix = _best(prefixes, at - 1, text.taken) if at and not m.first and not m.fuzzy else None
        if prefix and (key := (settings.prefixes[prefix[2]].word, m.second, m.number)) not in text.said:
            text.said = {key if old is m else k: old for k, old in text.said.items()}
            begin = text.spans[prefix[0]][0]
            m.first, m.raw = key[0], [text.up[begin : begin + len(r)] for r in m.raw]  # as long as they were said without it
            text.taken.update(range(prefix[0], prefix[1] + 1))
    return list(text.said.values())


def _separator(word: str, settings: Settings) -> str:
    found = _index(settings.separators).match([word.encode()])[0][0] if word else -1
    return settings.separators[found].word if found >= 0 else ""


def channels_of(text: _Text, dispatches: list, settings: Settings) -> list[Mention]:
    """Dispatch name, separator if there are any, and a number of two digits at most; or a shorthand and its number."""
    consumed = []
    for m in _pattern(settings.dispatches, settings.separators, 2, False).finditer(text.up) if settings.dispatches else ():
        text.add("channel", m[1], m[2], m[3], m[0], False)
        consumed.append(m.span())
    for s in settings.shorthands:
        for gap in (r"[^\S\n]+", "-", ""):
            for m in re.finditer(rf"\b{re.escape(s.label)}{gap}(\d{{1,2}})\b", text.up, re.ASCII):
                text.add("channel", s.dispatch, s.separator, m[1], m[0], False)
                consumed.append(m.span())
    for first, last, word, _ in text.free(dispatches, consumed):
        between = _separator(text.word(last + 1), settings) if settings.separators else ""
        at = last + 2 if settings.separators else last + 1
        if (not settings.separators or between) and (number := text.number(at, 2)) and text.on_line(first, at):
            text.add("channel", settings.dispatches[word].word, between, number, text.up[text.spans[first][0] : text.spans[at][1]], True)
    return list(text.said.values())


def _byte_text(text: str) -> str:
    return upper(text).encode().decode("latin-1")


def _plain(text: str) -> str:
    return text.encode("latin-1").decode(errors="replace")


def corrected_texts(texts: list[str], settings: Settings) -> list[str]:
    """In upper case with the corrections applied, nearest first and without overlaps; a text without any stays as it is."""
    ups = [_byte_text(t) for t in texts]
    tokens = tokens_of([u.encode("latin-1") for u in ups])
    found = _index(settings.corrections).candidates(tokens) if settings.corrections else {}
    out = list(texts)
    for doc, candidates in found.items():
        chosen: list[tuple[int, int, int, int]] = []
        for c in sorted(candidates, key=lambda c: (c[3], c[0])):
            if not any(c[0] <= o[1] and o[0] <= c[1] for o in chosen):
                chosen.append(c)
        base, up = int(tokens.base[doc]), ups[doc]
        for first, last, word, _ in sorted(chosen, reverse=True):
            up = up[: int(tokens.start[first]) - base] + _byte_text(settings.corrections[word].word) + up[int(tokens.stop[last]) - base :]
        out[doc] = _plain(up)
    return out


def mentions_of(texts: list[str], settings: Settings) -> Iterator[tuple[int, list[Mention], str]]:
    """(place, mentions, text in upper case) of the texts with any."""
    ups = [_byte_text(t) for t in texts]
    tokens = tokens_of([u.encode("latin-1") for u in ups])
    find = lambda words, merge: _index(words).candidates(tokens, merge) if words else {}
    types, prefixes, dispatches = find(settings.types, 3), find(settings.prefixes, 3), find(settings.dispatches, 2)
    labels = [s.label for s in settings.shorthands]
    for doc, up in enumerate(ups):
        has_label = any(label in up for label in labels)
        if doc in types or doc in dispatches or has_label:
            units = units_of(_Text(up, tokens, doc), types[doc], prefixes.get(doc, []), settings) if doc in types else []
            channels = channels_of(_Text(up, tokens, doc), dispatches.get(doc, []), settings) if doc in dispatches or has_label else []
            if units or channels:
                yield doc, units + channels, up


def annotations_of(mentions: list[Mention], up: str) -> tuple[str, list[tuple[Mention, str, int, int]]]:
    """The text with each mention in its plain spelling; and (mention, text, start, end) by place in characters, the longer of those that overlap."""
    spans = sorted(((m, r, hit.start(), hit.end()) for m in mentions for r in m.raw for hit in re.finditer(re.escape(r), up)), key=lambda s: (s[2], -s[3]))
    out, done, at = [], "", 0
    for m, _, start, end in spans:
        if start < at:
            continue
        done += up[at:start]
        name = _byte_text(m.name)
        out.append((m, m.name, len(_plain(done)), len(_plain(done + name))))
        done, at = done + name, end
    return _plain(done + up[at:]), out


def mapped(transcripts: DataFrame, schema: str, rows_of: Callable[[list, list[str]], Iterator[tuple]]) -> DataFrame:
    """Rows (call_id and the columns of ``schema``) that ``rows_of`` makes of a batch's ids and texts."""
    ship(transcripts.sparkSession)
    kind = transcripts.schema["call_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = list(rows_of(batch.column("call_id").to_pylist(), [t or "" for t in batch.column("transcript").to_pylist()]))
            if rows:
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(columns[0], batch.schema.field("call_id").type), *[pa.array(c) for c in columns[1:]]], names=["call_id", *names])

    return transcripts.select("call_id", "transcript").mapInArrow(run, f"call_id {kind}, {schema}")


def corrected(transcripts: DataFrame, settings: Settings) -> DataFrame:
    """call_id, transcript with corrections; null texts as empty ones."""
    return mapped(transcripts, "transcript string", lambda ids, texts: zip(ids, corrected_texts(texts, settings)))


def mentions(transcripts: DataFrame, settings: Settings) -> DataFrame:
    """call_id, kind, first, second, number, fuzzy, raw: one row for each unit or channel that a transcript names, with the ways it was said."""

    def rows(ids, texts):
        for doc, found, _ in mentions_of(texts, settings):
            yield from ((ids[doc], m.kind, m.first, m.second, m.number, m.fuzzy, [_plain(r) for r in m.raw]) for m in found)

    return mapped(transcripts, "kind string, first string, second string, number string, fuzzy boolean, raw array<string>", rows)


def annotations(transcripts: DataFrame, settings: Settings) -> DataFrame:
    """call_id, kind, name, start, stop, fuzzy on the corrected transcript, in characters."""

    def rows(ids, texts):
        for doc, found, up in mentions_of(corrected_texts(texts, settings), settings):
            yield from ((ids[doc], m.kind, text, start, stop, m.fuzzy) for m, text, start, stop in annotations_of(found, up)[1])

    return mapped(transcripts, "kind string, name string, start long, stop long, fuzzy boolean", rows)
