"""Mentions in whole transcripts (F15 to F19): documents with a dispatcher's words, misheard by a letter, put in at a place of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mentions
from ..functions.fuzzy import Index, tokens_of
from ..functions.mentions import Settings
from ..functions.units import FuzzyWord as W
from ..sources.adapters import table
from .registry import query

TYPES = ["ENGINE", "MEDIC", "LADDER", "BATTALION", "RESCUE", "SQUAD", "TANKER"]
PLACES = ["YOUNGSTOWN", "LORDSTOWN", "BROOKFIELD", "MCDONALD", "WEATHERSFIELD"]
SETTINGS = Settings(
    types=tuple(W(t, 1) for t in TYPES),
    prefixes=(W("CITY", 1), W("COUNTY", 1)),
    dispatches=(W("VECC", 1, ("DECK",)), W("METRO", 1)),
    separators=(W("FIRE", 1), W("OPS", 0)),
    corrections=tuple(W(p, 1) for p in PLACES),
)


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _heard(words: list[str], step: int):
    """The word of a document, and what was heard: without one letter after the first."""
    n = F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words)).cast("int") + 1)
    at = (n % step).cast("int") + 1
    return word, F.lower(F.concat(F.left(word, at), F.substr(word, at + 2)))


def planted(spark, sf, said):
    """call_id, transcript: each whole document with ``said`` on a line of its own, somewhere in it."""
    d = table(spark, sf, "documents")
    at = (F.col("doc_id") * 37 % (F.length("text") + 1)).cast("int")
    return d.select(F.col("doc_id").alias("call_id"), F.concat(F.left("text", at), F.lit("\n"), said, F.lit("\n"), F.substr("text", at + 1)).alias("transcript"))


PLANTED = "d AS (SELECT doc_id AS call_id, text, doc_id * 37 % (length(text) + 1) AS place FROM documents)"
UNITS_SQL = f"""WITH {PLANTED} SELECT call_id, CASE call_id % 3 WHEN 0 THEN 'CITY' WHEN 1 THEN 'COUNTY' ELSE '' END AS prefix, list_extract({_listed(TYPES)}, CAST(call_id % {len(TYPES)} AS INT) + 1) AS type, CAST(call_id % 900 AS VARCHAR) AS number, place FROM d"""


def unit_said():
    """A number comes first, so that no word of the text before is read with the prefix."""
    _, heard = _heard(TYPES, 3)
    prefix = F.when(F.col("doc_id") % 3 == 0, "cty ").when(F.col("doc_id") % 3 == 1, "County, ").otherwise("respond ")
    return F.concat(F.lit("1. "), prefix, heard, F.lit("-"), (F.col("doc_id") % 900).cast("string"))


CANDIDATE_WORDS = (W("TIONER", 1), W("EDAND", 2, ("ING ED",)), W("THEREOF", 2), W("ONER AND", 2), W("AN", 0), W("EST", 1, ("LE LA",)))


@query(
    "f15_word_candidates",
    f"""WITH words(i, word, most, alias) AS (VALUES {", ".join(f"({i}, '{w.word.replace(' ', '')}', {w.distance}, '{(w.aliases or ('',))[0].replace(' ', '')}')" for i, w in enumerate(CANDIDATE_WORDS))}),
 t AS (SELECT doc_id AS call_id, regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+|[0-9]+') AS tokens FROM documents),
 s AS (SELECT call_id, tokens, unnest(range(len(tokens))) AS first FROM t),
 m AS (SELECT call_id, first, k, array_to_string(tokens[first + 1:first + k], '') AS merged FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE first + k <= len(tokens) AND len(list_filter(tokens[first + 1:first + k], lambda x: x SIMILAR TO '[0-9]+')) = 0),
 u AS (SELECT DISTINCT merged FROM m WHERE length(merged) <= 10),
 c AS (SELECT merged, word, CASE WHEN merged = word THEN -2 WHEN merged = alias THEN -1 ELSE levenshtein(merged, word) END AS d, i, most FROM u, words),
 b AS (SELECT merged, arg_min(i, struct_pack(d, i)) AS word, greatest(min(d), 0) AS distance FROM c WHERE d < 0 OR (most > 0 AND d <= most) GROUP BY merged)
 SELECT call_id, first, first + k - 1 AS last, word::BIGINT AS word, distance FROM m JOIN b USING (merged) QUALIFY row_number() OVER (PARTITION BY call_id, first ORDER BY k) = 1""",
)
def f15(spark, sf):
    """Every run of one to three words in the documents that a word list matches."""

    def rows(ids, texts):
        index = Index(CANDIDATE_WORDS)
        tokens = tokens_of([t.encode() for t in texts])
        for doc, found in index.candidates(tokens).items():
            base = tokens.of(doc).start
            yield from ((ids[doc], first - base, last - base, word, distance) for first, last, word, distance in found)

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.col("text").alias("transcript"))
    return mentions.mapped(d, "first long, last long, word long, distance long", rows)


@query(
    "f16_corrected_transcripts",
    f"""WITH {PLANTED}, u AS (SELECT call_id, place, replace(upper(replace(text, 'ß', chr(1))), chr(1), 'ß') AS up FROM d)
 SELECT call_id, left(up, place) || chr(10) || 'TOWARDS ' || list_extract({_listed(PLACES)}, CAST(call_id % {len(PLACES)} AS INT) + 1) || ' NOW' || chr(10) || substr(up, place + 1) AS said FROM u""",
)
def f16(spark, sf):
    _, heard = _heard(PLACES, 4)
    return mentions.corrected(planted(spark, sf, F.concat(F.lit("towards "), heard, F.lit(" now"))), SETTINGS).select("call_id", F.col("transcript").alias("said"))


@query("f17_unit_mentions", f"SELECT call_id, prefix, type, number, TRUE AS fuzzy FROM ({UNITS_SQL})")
def f17(spark, sf):
    found = mentions.mentions(planted(spark, sf, unit_said()), SETTINGS).where("kind = 'unit'")
    return found.select("call_id", F.col("first").alias("prefix"), F.col("second").alias("type"), "number", "fuzzy")


@query("f18_channel_mentions", f"WITH {PLANTED} SELECT call_id, CASE WHEN call_id % 2 = 0 THEN 'VECC' ELSE 'METRO' END AS dispatch, CASE WHEN call_id % 2 = 0 THEN 'FIRE' ELSE 'OPS' END AS separator, CAST(call_id % 90 AS VARCHAR) AS channel FROM d")
def f18(spark, sf):
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, "switch to deck, fir ").otherwise("switch to metr ops "), (F.col("doc_id") % 90).cast("string"))
    found = mentions.mentions(planted(spark, sf, said), SETTINGS).where("kind = 'channel'")
    return found.select("call_id", F.col("first").alias("dispatch"), F.col("second").alias("separator"), F.col("number").alias("channel"))


@query(
    "f19_annotations",
    f"""SELECT call_id, trim(prefix || ' ' || type || ' ' || number) AS name, place + 4 + CASE WHEN prefix = '' THEN length('respond ') ELSE 0 END AS start,
 place + 4 + CASE WHEN prefix = '' THEN length('respond ') ELSE 0 END + length(trim(prefix || ' ' || type || ' ' || number)) AS stop FROM ({UNITS_SQL})""",
)
def f19(spark, sf):
    """Places in characters of the transcript in which each mention has its plain spelling."""
    return mentions.annotations(planted(spark, sf, unit_said()), SETTINGS).where("kind = 'unit'").select("call_id", "name", "start", "stop")
