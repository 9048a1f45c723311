"""Text functions (F), JSON and arrays (N), maths and geometry (M)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import automaton, geo, signal, streets
from ..functions import text as tx
from ..sources.adapters import CALLS, calls, table
from ..sources.shared import ship
from .registry import query


#: A dispatcher's list: common and rare words, phrases, several spellings of one, and what no text has.
KEYWORDS = ["the", "The ", "of the", "idiot", "and", "la", "de", "der", "is", "en route", "fire", "copyright", "stand", "all rights reserved", "ing", "email"]
# Between two matches lies a piece without any; a match's place is the bytes before it.
HITS_SQL = (
    "keywords(keyword) AS (SELECT unnest(["
    + ", ".join(f"'{k}'" for k in KEYWORDS)
    + r"""])), split AS (SELECT doc_id, text, keyword, strlen(trim(keyword)) AS n, string_split_regex(upper(replace(text, 'ß', '§')), '\b' || upper(trim(keyword)) || '\b') AS p FROM documents, keywords),
 found AS (SELECT doc_id AS call_id, keyword, text, n, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + (i - 1) * n AS BIGINT) AS position FROM (SELECT *, unnest(range(1, len(p))) AS i FROM split))""".replace("\\", "\\")
)


def spoken(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.col("text").alias("transcript"))


@query("f01_keyword_hits", f"WITH {HITS_SQL} SELECT call_id, keyword, position FROM found")
def f01(spark, sf):
    return automaton.keyword_hits(spoken(spark, sf), KEYWORDS).select("call_id", "keyword", "position")


@query(
    "f02_keyword_context",
    f"""WITH {HITS_SQL}, b AS (SELECT *, hex(encode(text)) AS h, strlen(text) AS size, greatest(position - 50, 0) AS start, least(position + n + 50, strlen(text)) AS stop FROM found)
 SELECT call_id, keyword, position, CASE WHEN start > 0 THEN '2E2E2E' ELSE '' END || substr(h, 2 * start + 1, 2 * (stop - start)) || CASE WHEN stop < size THEN '2E2E2E' ELSE '' END AS context FROM b""",
)
def f02(spark, sf):
    """The bytes around each match, in hex."""
    return automaton.keyword_hits(spoken(spark, sf), KEYWORDS).withColumn("context", F.hex("context"))


@query("f03_whole_word", r"SELECT p_partkey AS id, regexp_matches(p_name, '(?i)\bring\b') AS found FROM part")
def f03(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_like("p_name", F.lit(tx.whole_word("ring"))).alias("found"))


NORMAL = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(replace(x, '&', ' AND ')), '([0-9])-([0-9])', '\1\2', 'g'), '[^A-Z0-9\s]', ' ', 'g'), '([A-Z])([0-9])', '\1 \2', 'g'), '([0-9])(ST|ND|RD|TH)\b', '\1~\2', 'g'), '([0-9])([A-Z])', '\1 \2', 'g'), '', ''), '~', ''), '\s+', ' ', 'g'))"


@query("f04_normalised_transcript", f"SELECT p_partkey AS id, {NORMAL} AS said FROM (SELECT p_partkey, p_name || ' & ' || p_brand || ' ' || p_partkey || 'TH ' || p_size || 'B-' || p_type AS x FROM part)")
def f04(spark, sf):
    x = F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("TH "), F.col("p_size").cast("string"), F.lit("B-"), "p_type")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normalise_transcript(x).alias("said"))


@query("f06_merged_house_number", r"SELECT p_partkey AS id, CASE WHEN length(p_size::VARCHAR) + length((p_partkey % 1000)::VARCHAR) BETWEEN 3 AND 6 THEN 'RESPOND ' || p_size || (p_partkey % 1000) || ' SOUTH ST' ELSE 'RESPOND TO ' || p_size || ', ' || (p_partkey % 1000) || ' SOUTH ST' END AS said FROM part")
def f06(spark, sf):
    x = F.concat(F.lit("RESPOND TO "), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_partkey") % 1000).cast("string"), F.lit(" SOUTH ST"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.merge_house_number(x).alias("said"))


@query("f07_phrases_removed", "SELECT doc_id AS call_id, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)of the', ' ', 'g'), '(?i)in\\.', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS n FROM documents")
def f07(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.length(tx.without_phrases(F.col("text"), ["of the", " in. "])).cast("bigint").alias("n"))


@query("f08_tones_only")
def f08(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), tx.tones_only(F.col("text")).alias("tones_only"))


WORDS = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))"


@query("f09_voice", f"SELECT conv_id, turn, {WORDS} >= 8 AS long_enough FROM conversations")
def f09(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.size(tx.words(F.col("text"))) >= 8).alias("long_enough"))


@query("f10_alert_voice")
def f10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.has_voice(F.col("text")).alias("voice"), tx.has_alert_voice(F.col("text")).alias("alert_voice"))


@query("f11_emergency_words", "SELECT doc_id AS call_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in tx.EMERGENCY))
def f11(spark, sf):
    return table(spark, sf, "documents").where(tx.has_emergency_word(F.col("text"))).select(F.col("doc_id").alias("call_id"))


@query("f12_edit_distance", "WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, levenshtein(x.a, y.a) AS d FROM n x JOIN n y ON left(x.a, 2) = left(y.a, 2) AND x.a < y.a")
def f12(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().withColumn("head", F.left("a", F.lit(2)))
    return n.join(n.withColumnRenamed("a", "b"), "head").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"))


@query("f14_tokens", "SELECT p_partkey AS id, array_to_string(regexp_extract_all(upper(p_name || p_partkey), '[A-Z]+|[0-9]+'), '|') AS tokens FROM part")
def f14(spark, sf):
    x = F.upper(F.concat("p_name", F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.regexp_extract_all(x, F.lit("([A-Z]+|[0-9]+)"), F.lit(1)), "|").alias("tokens"))


@query("f20_place_key", "SELECT p_partkey AS id, regexp_replace(trim(regexp_replace(regexp_replace(upper('the ' || p_name || '., ' || p_brand), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')), '^THE ', '') AS place FROM part")
def f20(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.place_key(F.concat(F.lit("the "), "p_name", F.lit("., "), "p_brand")).alias("place"))


@query("f21_canonical_street", "SELECT p_partkey AS id, upper(p_name) || CASE p_size % 3 WHEN 0 THEN ' N RD' WHEN 1 THEN ' SW AVE' ELSE ' BLVD' END AS street FROM part")
def f21(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, " North Road").when(F.col("p_size") % 3 == 1, " southwest Avenue, Apt 4").otherwise("-Boulevard")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.canonical_street(F.concat("p_name", kind)).alias("street"))


@query("f22_street_core", "SELECT p_partkey AS id, upper(p_name) AS core FROM part")
def f22(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.street_core(F.concat("p_name", F.lit(" North Road"))).alias("core"))


# Skeletons in SQL: of names s (lower case) the first letter and later consonants, repeats once.
SKELETONS = "letters AS (SELECT DISTINCT p_name AS s, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS x FROM part), bones AS (SELECT s, regexp_extract_all(left(x, 1) || regexp_replace(substr(x, 2), '[AEIOUY]', '', 'g'), '.') AS l FROM letters), skeletons AS (SELECT s, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF i = 1 OR l[i] <> l[i - 1]], '') AS skeleton FROM bones)"


@query("f23_skeleton", f"WITH {SKELETONS} SELECT s AS p_name, skeleton FROM skeletons")
def f23(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", streets.skeleton(F.col("p_name")).alias("skeleton"))


@query("f26_gazetteer_match")
def f26(spark, sf):
    """The best street of a gazetteer for each heard name."""
    p = table(spark, sf, "part")
    known = p.where("p_size > 25").select(F.upper("p_name").alias("street"))
    heard = p.where("p_size <= 25").select(F.regexp_replace(F.upper("p_name"), "T(?=[AEIOU])", "D").alias("said"))
    return streets.best_matches(heard, known).select("said", "street", F.round("score", 6).alias("score"))


@query("f34_digit_candidates", r"SELECT s_suppkey AS id, regexp_matches(s_suppkey || ' ' || s_name, '^\s*[0-9]+[A-Za-z]?\s+\S+') AS candidate FROM supplier")
def f34(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), tx.has_house_number(F.concat(F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_name"))).alias("candidate"))


@query("f35_highways", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'SR ' || p_size WHEN 1 THEN 'I ' || p_size ELSE 'US ' || p_size END AS road FROM part")
def f35(spark, sf):
    head = F.when(F.col("p_size") % 3 == 0, "State Route ").when(F.col("p_size") % 3 == 1, "interstate-").otherwise("US Hwy ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.highway(F.concat(head, F.col("p_size").cast("string"))).alias("road"))


@query("f36_state_of_region", "SELECT n_nationkey::BIGINT AS id, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'CANADA' THEN 'CA' END AS state FROM nation")
def f36(spark, sf):
    known = F.create_map(*[F.lit(x) for x in ("FRANCE", "FR", "CANADA", "CA")])
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.try_element_at(known, F.col("n_name")).alias("state"))


@query("f45_log_category")
def f45(spark, sf):
    heads = F.array(*[F.lit(h) for h in ("2024-01-01 10:00:00 api: ", "panic: ", "dirwatch error: ", "", "2024/01/01 10:00:00 user login ")])
    c = calls(spark, sf)
    return c.groupBy(tx.log_category(F.concat(F.element_at(heads, F.col("talkgroup_ref").cast("int")), F.lit("event "), F.col("k").cast("string"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("f46_snippet", "SELECT doc_id AS call_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def f46(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), tx.snippet(F.col("text")).alias("snippet"))


@query("f47_transcript_head", "SELECT doc_id AS call_id, left(COALESCE(text, ''), 400) AS head FROM documents")
def f47(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.left(F.coalesce("text", F.lit("")), F.lit(400)).alias("head"))


@query("f48_reply_parser", "SELECT event_id AS call_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def f48(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.lit("sorry {"))
    body = F.regexp_replace(raw, "^```(?:json)?\\s*|\\s*```$", "")
    return table(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.get_json_object(body, "$.k").cast("bigint").alias("k"))


# ------------------------------------------------------------------ JSON and arrays


@query("n01_array_elements", f"WITH {CALLS} SELECT call_id, list_extract(['Medic', 'Engine', ''], CAST(k % 3 AS INT) + 1) AS label FROM calls WHERE k % 4 < 3")
def n01(spark, sf):
    doc = F.when(F.col("k") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit('[{"id":"x","label":"none"},{"id":"'), F.col("k").cast("string"), F.lit('","label":"'), F.element_at(F.array(F.lit("Medic"), F.lit("Engine"), F.lit("")), (F.col("k") % 3).cast("int") + 1), F.lit('"}]')))
    c = calls(spark, sf).select("call_id", "k", F.from_json(F.nullif(doc, F.lit("")), "array<struct<id:string,label:string>>").alias("sets"))
    return c.select("call_id", F.get(F.filter("sets", lambda s: s["id"] == F.col("k").cast("string")), F.lit(0))["label"].alias("label")).where("label is not null")


@query("n02_tone_sequence_round_trip", f"WITH {CALLS} SELECT call_id, round(duration, 4) AS first, k AS second FROM calls")
def n02(spark, sf):
    tones = F.to_json(F.struct(F.array(F.struct(F.col("duration").alias("frequency")), F.struct(F.col("k").cast("double").alias("frequency"))).alias("tones")))
    parsed = F.from_json(tones, "struct<tones:array<struct<frequency:double>>>")
    return calls(spark, sf).select("call_id", parsed.alias("s")).select("call_id", F.round(F.get("s.tones", F.lit(0))["frequency"], 4).alias("first"), F.get("s.tones", F.lit(1))["frequency"].cast("bigint").alias("second"))


@query(
    "n03_distinct_units",
    "WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber * 1000000 + l_suppkey) AS place FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS call_id, string_agg(l_suppkey::VARCHAR, ',' ORDER BY place) AS units FROM f GROUP BY 1",
)
def n03(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("u"))
    return rows.select("call_id", F.array_join(F.array_distinct(F.transform("u", lambda x: x["l_suppkey"].cast("string"))), ",").alias("units"))


@query("n04_records_by_call", f"WITH {CALLS} SELECT unit_ref, talkgroup_ref, count(DISTINCT k) AS records, arg_max(duration, ts_ms * 100000 + call_id) AS latest FROM calls GROUP BY 1, 2")
def n04(spark, sf):
    return calls(spark, sf).groupBy("unit_ref", "talkgroup_ref").agg(F.count_distinct("k").alias("records"), F.max(F.struct("ts_ms", "call_id", "duration"))["duration"].alias("latest"))


@query("n05_json_system_test", "SELECT event_id AS call_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def n05(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select(F.col("event_id").alias("call_id"))


@query("n12_exploded_sources", "SELECT l_orderkey AS call_id, l_suppkey AS unit, l_linenumber AS place FROM lineitem WHERE l_suppkey > 0")
def n12(spark, sf):
    doc = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.to_json(F.collect_list(F.struct(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("pos")))).alias("j"))
    each = doc.select("call_id", F.explode(F.from_json("j", "array<struct<src:bigint,pos:int>>")).alias("s"))
    return each.where("s.src > 0").select("call_id", F.col("s.src").alias("unit"), F.col("s.pos").alias("place"))


@query("n13_wire_json", f"WITH {CALLS} SELECT call_id, '{{\"id\":' || call_id || ',\"talkgroup\":{{\"ref\":' || talkgroup_ref || '}},\"units\":[' || unit_ref || ']}}' AS wire FROM calls")
def n13(spark, sf):
    wire = F.struct(F.col("call_id").alias("id"), F.struct(F.col("talkgroup_ref").alias("ref")).alias("talkgroup"), F.array("unit_ref").alias("units"))
    return calls(spark, sf).select("call_id", F.to_json(wire).alias("wire"))


@query("n14_keyword_list_lookup", "SELECT p_partkey AS id, b.size AS words FROM part JOIN (SELECT p_brand, count(DISTINCT p_name) AS size FROM part GROUP BY 1) b USING (p_brand)")
def n14(spark, sf):
    p = table(spark, sf, "part")
    sizes = p.groupBy("p_brand").agg(F.count_distinct("p_name").alias("words"))
    return p.join(sizes, "p_brand").select(F.col("p_partkey").alias("id"), "words")


# ------------------------------------------------------------------ maths and geometry


@query("m01_hour_of_call", f"WITH {CALLS} SELECT call_id, ts_ms // 3600000 % 24 AS hour FROM calls")
def m01(spark, sf):
    return calls(spark, sf).select("call_id", F.expr("ts_ms div 3600000 % 24").alias("hour"))


@query("m02_day_start", f"WITH {CALLS} SELECT call_id, ts_ms // 86400000 * 86400000 AS day_ms FROM calls")
def m02(spark, sf):
    return calls(spark, sf).select("call_id", F.expr("ts_ms div 86400000 * 86400000").alias("day_ms"))


@query("m03_minute_bucket", f"WITH {CALLS} SELECT call_id, ts_ms // 60000 * 60000 AS bucket_ms FROM calls")
def m03(spark, sf):
    return calls(spark, sf).select("call_id", F.expr("ts_ms div 60000 * 60000").alias("bucket_ms"))


@query("m05_duration_ratio", "SELECT l_orderkey AS call_id, l_linenumber AS n, COALESCE(least(l_quantity, 20) / nullif(greatest(l_quantity, 20), 0) >= 0.5, FALSE) AS near FROM lineitem")
def m05(spark, sf):
    from ..operators.temporal import duration_ratio

    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("n"), duration_ratio(F.col("l_quantity"), F.lit(20.0)).alias("near"))


@query("m06_duration_similarity", "SELECT l_orderkey AS call_id, l_linenumber AS n, l_quantity > 0 AND (abs(l_quantity - 20) <= 0.4 OR abs(l_quantity - 20) <= greatest(l_quantity, 20) * 0.15) AS alike FROM lineitem")
def m06(spark, sf):
    from ..operators.temporal import similar_duration

    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("n"), similar_duration(F.col("l_quantity"), F.lit(20.0)).alias("alike"))


@query(
    "m08_best_cosine",
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT vec_id, list_cosine_similarity(a[greatest(s, 0) + 1 : 64 - greatest(-s, 0)], b[greatest(-s, 0) + 1 : 64 - greatest(s, 0)]) AS c FROM p, range(-10, 11) r(s)) SELECT vec_id, round(greatest(max(c), 0), 6) AS likeness FROM s GROUP BY 1""",
)
def m08(spark, sf):
    e = table(spark, sf, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(signal.best_cosine(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("m09_audio_hash", "SELECT doc_id AS call_id, sha256(text) AS hash FROM documents")
def m09(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("m10_pattern_signature", f"WITH {CALLS} SELECT call_id, sha256(system_ref || ':' || talkgroup_ref || ':ab:' || CAST(round(duration / 20) AS BIGINT) || ':' || CAST(round(k / 20) AS BIGINT)) AS signature FROM calls")
def m10(spark, sf):
    half = lambda c: F.round(c).cast("bigint").cast("string")
    parts = F.concat_ws(":", F.col("system_ref").cast("string"), F.col("talkgroup_ref").cast("string"), F.lit("ab"), half(F.col("duration") / 20), half(F.col("k") / 20))
    return calls(spark, sf).select("call_id", F.sha2(parts, 256).alias("signature"))


@query("m11_long_tone_signature", f"WITH {CALLS} SELECT call_id, sha256(system_ref || ':' || talkgroup_ref || ':long:' || CAST(round(duration / 20) AS BIGINT)) AS signature FROM calls")
def m11(spark, sf):
    parts = F.concat_ws(":", F.col("system_ref").cast("string"), F.col("talkgroup_ref").cast("string"), F.lit("long"), F.round(F.col("duration") / 20).cast("bigint").cast("string"))
    return calls(spark, sf).select("call_id", F.sha2(parts, 256).alias("signature"))


@query("m12_tolerance", f"WITH {CALLS} SELECT call_id, abs(duration - k) <= 10 AS within FROM calls")
def m12(spark, sf):
    return calls(spark, sf).select("call_id", (F.abs(F.col("duration") - F.col("k")) <= 10).alias("within"))


@query("m13_interval_overlap", "SELECT l_orderkey AS call_id, l_linenumber AS n, l_quantity <= 20 + 5.25 AND l_quantity + l_tax * 100 >= 20 - 0.25 AS overlaps FROM lineitem")
def m13(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("n"), ((F.col("l_quantity") <= 25.25) & (F.col("l_quantity") + F.col("l_tax") * 100 >= 19.75)).alias("overlaps"))


@query("m14_harmonics", f"WITH {CALLS} SELECT call_id, abs(duration / (k + 1) - 2) <= 0.14 AS second, abs(duration / (k + 1) - 3) <= 0.21 AS third FROM calls")
def m14(spark, sf):
    ratio = F.col("duration") / (F.col("k") + 1)
    return calls(spark, sf).select("call_id", (F.abs(ratio - 2) <= 0.14).alias("second"), (F.abs(ratio - 3) <= 0.21).alias("third"))


@query("m16_tone_segments")
def m16(spark, sf):
    """Tone segments of a clip for each channel and k: two tones whose pitches follow from them, between quiet noise; every third clip is faint."""
    import numpy as np

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(signal.RATE) / signal.RATE
        quiet = 0.01 * np.random.default_rng(1).standard_normal(signal.RATE)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                tones = [np.sin(2 * np.pi * (300 + 100 * r.talkgroup_ref) * t), np.sin(2 * np.pi * (900 + 5 * r.k) * t)]
                clip = np.concatenate([quiet, *tones, quiet]) * (0.05 if r.k % 3 == 0 else 0.5)
                out += [(r.talkgroup_ref, r.k, round(s["frequency"]), round(s["duration"], 2)) for s in signal.without_harmonics(signal.tone_segments(clip, signal.RATE))]
            yield pd.DataFrame(out, columns=["talkgroup_ref", "k", "frequency", "seconds"])

    return calls(spark, sf).select("talkgroup_ref", "k").distinct().mapInPandas(run, "talkgroup_ref bigint, k bigint, frequency bigint, seconds double")


@query("w17_removable_tones")
def w17(spark, sf):
    """Of a noisy clip for each channel and k, with two tones at once and a shorter one, the tones that removal cuts and the seconds it keeps."""
    import numpy as np

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(signal.RATE) / signal.RATE
        noise = 0.01 * np.random.default_rng(1).standard_normal(4 * signal.RATE)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                clip = noise.copy()
                clip[signal.RATE : 2 * signal.RATE] += 0.4 * np.sin(2 * np.pi * (400 + 100 * r.talkgroup_ref) * t) + 0.2 * np.sin(2 * np.pi * (1500 + 5 * r.k) * t)
                clip[3 * signal.RATE : 3 * signal.RATE + signal.RATE // 10] += 0.4 * np.sin(2 * np.pi * 2500 * t[: signal.RATE // 10])
                tones = signal.sustained_tones(clip, signal.RATE)
                kept = sum(b - a for a, b in signal.kept_spans(4.0, [(s["start"], s["end"]) for s in tones]))
                out += [(r.talkgroup_ref, r.k, round(s["frequency"]), round(s["duration"], 1), round(kept, 1)) for s in tones]
            yield pd.DataFrame(out, columns=["talkgroup_ref", "k", "frequency", "seconds", "kept_s"])

    return calls(spark, sf).select("talkgroup_ref", "k").distinct().mapInPandas(run, "talkgroup_ref bigint, k bigint, frequency bigint, seconds double, kept_s double")


PLACES = "c_custkey AS id, 40 + c_acctbal / 10000 AS lat, -80 + c_nationkey / 10.0 AS lon FROM customer"


def places(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (40 + F.col("c_acctbal") / 10000).alias("lat"), (-80 + F.col("c_nationkey") / 10).alias("lon"), "c_mktsegment")


@query("m21_haversine", f"WITH p AS (SELECT {PLACES}) SELECT id, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM (SELECT id, power(sin(radians(40.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.5)) * power(sin(radians(-79 - lon) / 2), 2) AS a FROM p)")
def m21(spark, sf):
    return places(spark, sf).select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(-79.0)), 3).alias("metres"))


@query("m22_flat_miles", f"WITH p AS (SELECT {PLACES}) SELECT id, round(69.0 * sqrt(power((-79 - lon) * cos(radians((lat + 40.5) / 2)), 2) + power(40.5 - lat, 2)), 6) AS miles FROM p")
def m22(spark, sf):
    return places(spark, sf).select("id", F.round(geo.flat_miles(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(-79.0)), 6).alias("miles"))


@query("m23_coverage", f"WITH p AS (SELECT {PLACES}) SELECT id, 69.0 * sqrt(power((-79 - lon) * cos(radians((lat + 40.5) / 2)), 2) + power(40.5 - lat, 2)) <= 30 OR 69.0 * sqrt(power((-80 - lon) * cos(radians((lat + 40) / 2)), 2) + power(40 - lat, 2)) <= 12 AS covered FROM p")
def m23(spark, sf):
    near = lambda lat, lon, r: geo.flat_miles(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= r
    return places(spark, sf).select("id", (near(40.5, -79.0, 30) | near(40.0, -80.0, 12)).alias("covered"))


@query("m24_scoped_radius", "SELECT s_suppkey AS id, round(least(greatest(abs(s_acctbal) / 500 * 0.75, 3), abs(s_acctbal) / 500), 6) AS radius FROM supplier")
def m24(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(geo.scoped_radius(F.abs(F.col("s_acctbal")) / 500), 6).alias("radius"))


@query("m25_radius_clamp", "SELECT s_suppkey AS id, least(greatest(s_acctbal / 100, 1), 50) AS radius FROM supplier")
def m25(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), geo.clamp(F.col("s_acctbal") / 100, F.lit(1.0), F.lit(50.0)).alias("radius"))


@query("m26_nearest_boundary", f"WITH p AS (SELECT {PLACES}), d AS (SELECT c_mktsegment AS layer, id, 69.0 * sqrt(power((-79 - lon) * cos(radians((lat + 40.5) / 2)), 2) + power(40.5 - lat, 2)) AS miles FROM p JOIN customer ON c_custkey = id) SELECT layer, min_by(id, miles) AS id, round(min(miles), 6) AS miles FROM d WHERE miles <= 50 GROUP BY 1")
def m26(spark, sf):
    miles = geo.flat_miles(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(-79.0))
    near = places(spark, sf).withColumn("miles", miles).where("miles <= 50")
    return near.groupBy(F.col("c_mktsegment").alias("layer")).agg(F.min(F.struct("miles", "id")).alias("m")).select("layer", "m.id", F.round("m.miles", 6).alias("miles"))


@query("m28_suppressed_pins", "SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' OR p_type LIKE '%ECON%' THEN NULL ELSE p_retailprice END AS lat, CASE WHEN p_type = 'SMALL' OR p_type LIKE '%ECON%' THEN 'failed' ELSE 'ok' END AS status FROM part")
def m28(spark, sf):
    unknown = (F.col("p_type") == "SMALL") | F.contains("p_type", F.lit("ECON"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(~unknown, F.col("p_retailprice")).alias("lat"), F.when(unknown, "failed").otherwise("ok").alias("status"))


@query("m29_composite_key", f"WITH {CALLS} SELECT call_id, (system_ref << 32) | talkgroup_ref AS key FROM calls")
def m29(spark, sf):
    return calls(spark, sf).select("call_id", F.shiftleft("system_ref", 32).bitwiseOR(F.col("talkgroup_ref")).alias("key"))


@query("m30_viewbox", f"WITH p AS (SELECT {PLACES}) SELECT id, round(lat - 7 / 69.0, 6) AS south, round(lon - 7 / (69.0 * greatest(cos(radians(lat)), 0.1)), 6) AS west FROM p")
def m30(spark, sf):
    box = geo.viewbox(F.col("lat"), F.col("lon"), F.lit(7.0))
    return places(spark, sf).select("id", F.round(box["south"], 6).alias("south"), F.round(box["west"], 6).alias("west"))
