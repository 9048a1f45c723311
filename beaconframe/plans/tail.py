"""The remaining operators: readers and sinks, words and labels, audio kernels, stream details."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import address, geo, nature, signal, streets, units
from ..functions import text as tx
from ..operators import temporal
from ..sources import files
from ..sources.adapters import CALLS, HOUR, MINUTE, TALKGROUPS, calls, last_moment, table, talkgroups
from ..sources.shared import new_folder, ship
from ..streaming import stateful
from ..streaming.sources import call_stream, run_available
from .joins import COOLDOWN
from .registry import query
from .streams import PENDING
from .text import SKELETONS

CHANNEL = ["system_ref", "talkgroup_ref"]


@query("s02_field_router", f"WITH {CALLS} SELECT call_id, k AS frequency, CASE WHEN talkgroup_ref > 2 THEN unit_ref END AS unit FROM calls")
def s02(spark, sf):
    form = F.create_map(F.lit("freq"), F.col("k").cast("string"), F.lit("source"), F.when(F.col("talkgroup_ref") > 2, F.col("unit_ref").cast("string")).otherwise("none"))
    route = lambda *names: F.coalesce(*[F.try_element_at(form, F.lit(n)).try_cast("bigint") for n in names])
    return calls(spark, sf).select("call_id", route("frequency", "freq").alias("frequency"), route("unit", "source").alias("unit"))


@query("s04_recorder_uploads", f"WITH {CALLS} SELECT talkgroup_ref AS talkgroup, count(*) AS calls FROM calls GROUP BY 1")
def s04(spark, sf):
    body = F.to_json(F.struct(F.col("talkgroup_ref").alias("talkgroup"), F.expr("ts_ms div 1000").alias("start_time")))
    return calls(spark, sf).select(files.parse_recorder(body)["talkgroup"].alias("talkgroup")).groupBy("talkgroup").agg(F.count(F.lit(1)).alias("calls"))


@query("s07_watched_folder", "SELECT doc_id AS call_id, text FROM documents")
def s07(spark, sf):
    """Files that arrive in a folder, as a stream."""
    path = new_folder(spark)
    table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), "text").write.json(path)
    return run_available(spark.readStream.schema("call_id bigint, text string").option("pathGlobFilter", "*.json").json(path))


@query("s09_ingest_variants", f"WITH {CALLS} SELECT call_id, talkgroup_ref AS talkgroup FROM calls")
def s09(spark, sf):
    """Three kinds of names, told apart by their form."""
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("tg"), F.col("talkgroup_ref"), F.lit(".json"))).when(F.col("k") % 3 == 1, F.concat(F.lit("/x/20240101/101010_P25_"), F.col("talkgroup_ref"), F.lit("_9.wav"))).otherwise(F.concat(F.lit("TO_"), F.col("talkgroup_ref"), F.lit("_FROM_9.mp3")))
    n = F.col("name")
    found = F.coalesce(F.regexp_extract(n, r"^tg(\d+)\.json$", 1).try_cast("bigint"), F.regexp_extract(n, r"TO_(\d+)_FROM", 1).try_cast("bigint"), files.parse_recorder_path(n)["talkgroup"])
    return calls(spark, sf).select("call_id", name.alias("name")).select("call_id", found.alias("talkgroup"))


@query("s11_folder_walk", "SELECT c_mktsegment AS folder, count(*) AS rows FROM customer GROUP BY 1")
def s11(spark, sf):
    path = new_folder(spark)
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("seg")).write.partitionBy("seg").parquet(path)
    found = spark.read.option("recursiveFileLookup", True).parquet(path)
    return found.groupBy(F.col("c_mktsegment").alias("folder")).agg(F.count(F.lit(1)).alias("rows"))


@query("s17_header_keys", "SELECT p_partkey AS id, lower(replace(replace(replace(p_name || '-' || p_brand, ' ', ''), '-', ''), '_', '')) AS key FROM part")
def s17(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace(F.concat("p_name", F.lit("-"), "p_brand"), "[ _-]", "")).alias("key"))


@query("s22_xml_sites", "SELECT s_suppkey AS site, s_nationkey::BIGINT AS county FROM supplier")
def s22(spark, sf):
    item = F.concat(F.lit("<site><id>"), F.col("s_suppkey").cast("string"), F.lit("</id><loc><county>"), F.col("s_nationkey").cast("string"), F.lit("</county></loc></site>"))
    return table(spark, sf, "supplier").select(F.from_xml(item, "id bigint, loc struct<county:bigint>").alias("x")).select(F.col("x.id").alias("site"), F.col("x.loc.county").alias("county"))


@query("s27_tone_sink", f"WITH {CALLS} SELECT 'set' || k % 4 AS tone_set, count(*) AS sent FROM calls GROUP BY 1")
def s27(spark, sf):
    path = new_folder(spark)

    def send(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    rows = call_stream(spark, sf).select("call_id", F.concat(F.lit("set"), F.col("k") % 4).alias("tone_set"))
    rows.writeStream.foreachBatch(send).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("call_id bigint, tone_set string").parquet(f"{path}/out").groupBy("tone_set").agg(F.count(F.lit(1)).alias("sent"))


@query("s28_client_push", f"WITH {CALLS} SELECT 'c' || c AS client, count(*) AS calls FROM calls, range(3) r(c) WHERE system_ref % 3 = c GROUP BY 1")
def s28(spark, sf):
    """Each client's matrix joined to the stream: a row for each call that a client hears."""
    matrix = spark.createDataFrame([(f"c{s % 3}", s) for s in range(8)], "client string, system_ref bigint")
    heard = run_available(call_stream(spark, sf).select("call_id", "system_ref").join(F.broadcast(matrix), "system_ref").select("client", "call_id"))
    return heard.groupBy("client").agg(F.count(F.lit(1)).alias("calls"))


@query("a48_health_snapshot", f"WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls) SELECT count(*) FILTER (ts_ms > t - 60000) AS last_minute, count(DISTINCT system_ref) AS systems, count(*) >= 1 AS ready FROM calls, m")
def a48(spark, sf):
    c = calls(spark, sf)
    return c.agg(F.count_if(F.col("ts_ms") > last_moment(c) - MINUTE).alias("last_minute"), F.count_distinct("system_ref").alias("systems"), (F.count(F.lit(1)) >= 1).alias("ready"))


@query("p40_purged_places", "SELECT s_suppkey AS id FROM supplier WHERE NOT (s_nationkey > 20 OR (s_suppkey % 7 = 0 AND s_acctbal < 5000))")
def p40(spark, sf):
    outside, conflict = F.col("s_nationkey") > 20, (F.col("s_suppkey") % 7 == 0) & (F.col("s_acctbal") < 5000)
    return table(spark, sf, "supplier").where(~(outside | conflict)).select(F.col("s_suppkey").alias("id"))


# ------------------------------------------------------------------ words and labels


MISHEARD = "regexp_replace(upper(p_name), '^(.)[AEIOU]', '\\1Y')"


@query("j23_fuzzy_streets", f"WITH {SKELETONS}, known AS (SELECT DISTINCT upper(p_name) AS street, skeleton FROM part JOIN skeletons ON s = p_name), said AS (SELECT DISTINCT {MISHEARD} AS said, skeleton FROM part JOIN skeletons ON s = p_name) SELECT said, COALESCE(max(street) FILTER (street = said), min(street)) AS street FROM said JOIN known USING (skeleton) GROUP BY said")
def j23(spark, sf):
    """Names with another vowel than their street's: it, or the least of the streets of its skeleton, is the nearest."""
    p = table(spark, sf, "part")
    known, said = p.select(F.upper("p_name").alias("street")), p.select(F.regexp_replace(F.upper("p_name"), "^(.)[AEIOU]", "$1Y").alias("said"))
    return streets.best_matches(said, known).select("said", "street")


@query("w04_nearest_neighbours", f"WITH {CALLS}, p AS (SELECT a.call_id, b.call_id AS other, abs(a.ts_ms - b.ts_ms) AS gap_ms FROM calls a JOIN calls b ON a.unit_ref = b.unit_ref AND a.call_id <> b.call_id AND abs(a.ts_ms - b.ts_ms) <= 7200000), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY gap_ms, other) AS n FROM p) SELECT call_id, other FROM r WHERE n = 1")
def w04(spark, sf):
    c = calls(spark, sf).select("call_id", "ts_ms", "unit_ref")
    return temporal.nearest_peers(c, ["unit_ref"], 2 * HOUR).select("call_id", F.col("peer").alias("other"))


@query("w10_chosen_candidates", "SELECT l_orderkey AS call_id, min(l_linenumber)::BIGINT AS first FROM lineitem GROUP BY 1")
def w10(spark, sf):
    """Greedy choice of spans that do not overlap, by distance and place: a fold over the sorted candidates."""
    spans = F.array_sort(F.collect_list(F.struct(F.lit(0).alias("distance"), F.col("l_linenumber").cast("bigint").alias("start"), (F.col("l_linenumber") + 2).cast("bigint").alias("stop"))))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(spans.alias("s"))
    free = lambda chosen, x: ~F.exists(chosen, lambda c: (x["start"] < c["stop"]) & (c["start"] < x["stop"]))
    chosen = F.aggregate("s", F.array().cast("array<struct<distance:int,start:bigint,stop:bigint>>"), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return rows.select("call_id", F.array_min(F.transform(chosen, lambda c: c["start"])).alias("first"))


@query("f05_cleaning_chain", "SELECT p_partkey AS id, 'RESPOND ' || upper(p_name) || ' ' || p_size AS said FROM part")
def f05(spark, sf):
    said = F.concat(F.lit("Thank you. respond, "), "p_name", F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normalise_transcript(tx.merge_house_number(tx.without_phrases(said, ["thank you."]))).alias("said"))


@query("f13_rune_distance", "WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT a, levenshtein(a, 'blue ring') AS d FROM n")
def f13(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.levenshtein("a", F.lit("blue ring")).cast("bigint").alias("d"))




@query("f25_street_scores")
def f25(spark, sf):
    """Scores of each street name against it with vowels changed, and against it without its third letter."""
    n = table(spark, sf, "part").select(F.upper("p_name").alias("a")).distinct()
    heard = F.array(F.regexp_replace("a", "(?<=[A-Z])([AEIOU])(?=[A-Z])", "E"), F.concat(F.left("a", F.lit(2)), F.substr("a", F.lit(4))))
    core = lambda c: F.regexp_replace(c, " ", "")
    return n.withColumn("b", F.explode(heard)).select("a", "b", F.round(streets.score(core("a"), core("b")), 6).alias("score"))


@query("f37_locality_names", "SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN 'Jefferson' WHEN 1 THEN 'Morgan' ELSE n_name END AS name FROM nation")
def f37(spark, sf):
    search = F.when(F.col("n_nationkey") % 3 == 0, "Jefferson Township, Ohio")
    city = F.when(F.col("n_nationkey") % 3 == 1, "Village of Morgan")
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(F.split_part(c, F.lit(","), F.lit(1)), r"(?i)\b(?:township|village|city|county|of)\b", "")), F.lit(""))
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.coalesce(bare(search), bare(city), bare(F.concat("n_name", F.lit(" County")))).alias("name"))


@query("f38_nature_tokens", "SELECT p_partkey AS id, upper(p_name) || ' ' || p_size AS tokens FROM part")
def f38(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(nature.tokens(F.concat("p_name", F.lit(" -- "), F.col("p_size").cast("string"))), " ").alias("tokens"))


@query("f39_term_matches", f"WITH {CALLS} SELECT call_id, k % 4 < 2 AS matches FROM calls")
def f39(spark, sf):
    token = F.element_at(F.array(*[F.lit(x) for x in ("FIRES", "FIRE", "FIRING", "CHAIR")]), (F.col("k") % 4).cast("int") + 1)
    return calls(spark, sf).select("call_id", nature.term_matches(token, F.lit("FIRE"), F.lit("OUT")).alias("matches"))


@query("f41_label_override", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS label FROM part")
def f41(spark, sf):
    """A label gives way to one with at least two points more, or to a complaint if it only names a response mode."""
    rule, model = F.when(F.col("p_size") > 25, 4).otherwise(1), F.lit(2)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(rule >= model + 2, F.col("p_brand")).otherwise(F.col("p_type")).alias("label"))


@query("f49_provider_names", f"WITH {CALLS} SELECT call_id, CASE talkgroup_ref WHEN 1 THEN 'Whisper' WHEN 2 THEN 'Azure' ELSE 'other' END AS provider FROM calls")
def f49(spark, sf):
    names = F.create_map(*[F.lit(x) for x in (1, "Whisper", 2, "Azure")])
    return calls(spark, sf).select("call_id", F.coalesce(F.try_element_at(names, F.col("talkgroup_ref").cast("int")), F.lit("other")).alias("provider"))


@query("f52_phrase_discovery", "SELECT p_brand AS label, count(DISTINCT p_name) AS phrases FROM part GROUP BY 1")
def f52(spark, sf):
    """What stands between cue words, as candidates for a label's phrases."""
    said = F.concat(F.lit("report of a "), "p_name", F.lit(" at the station"))
    found = F.regexp_extract(said, r"report of an? (.+?) (?:at|on|in)\b", 1)
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count_distinct(found).alias("phrases"))


@query("f55_stem_equality", f"WITH {CALLS} SELECT call_id, k % 3 = 0 AS equal FROM calls")
def f55(spark, sf):
    other = F.element_at(F.array(*[F.lit(x) for x in ("BURNING", "BURGLAR", "BURN")]), (F.col("k") % 3).cast("int") + 1)
    word = F.element_at(F.array(*[F.lit(x) for x in ("BURNINGS", "BURNERS", "BURNS")]), (F.col("k") % 3).cast("int") + 1)
    return calls(spark, sf).select("call_id", nature.stem_equal(word, other).alias("equal"))


@query("f57_edit_limits", "WITH n AS (SELECT p_partkey AS id, left(p_name, p_size % 8 + 1) AS a, left(p_name, p_size % 5) || 'q' || substr(p_name, p_size % 5 + 2, p_size % 7) AS b FROM part), m AS (SELECT *, length(a) AS x, length(b) AS y, len([i FOR i IN range(1, 5) IF starts_with(b, left(a, i)) AND length(a) >= i]) AS alike FROM n) SELECT id, (CASE WHEN x >= 7 OR y >= 7 THEN CASE WHEN alike = 4 THEN 3 ELSE 2 END WHEN abs(x - y) <= 1 AND ((x >= 5 AND y >= 5 AND alike >= 2) OR (x >= 4 AND y >= 4 AND alike >= 1)) THEN 2 ELSE 1 END)::BIGINT AS edits FROM m")
def f57(spark, sf):
    a = F.left("p_name", F.col("p_size") % 8 + 1)
    b = F.concat(F.left("p_name", F.col("p_size") % 5), F.lit("q"), F.substr("p_name", F.col("p_size") % 5 + 2, F.col("p_size") % 7))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), streets.edit_limit(a, b).cast("bigint").alias("edits"))


@query("f58_location_queries", "SELECT n_nationkey::BIGINT AS id, n_name || ', ' || r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey")
def f58(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat_ws(", ", F.nullif("n_name", F.lit("")), F.nullif("r_name", F.lit(""))).alias("query"))


@query("f59_highlighting", "SELECT p_partkey AS id, regexp_replace(p_name, '(?i)(ring)', '<mark>\\1</mark>', 'g') AS html FROM part")
def f59(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", "(?i)(ring)", "<mark>$1</mark>").alias("html"))


# ------------------------------------------------------------------ audio and geometry


@query("m15_harmonic_pruning")
def m15(spark, sf):
    """Tones left of a fundamental, its double and one more, for each k; removal depends on the order of visits."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k in rows["k"].tolist():
                base = {"start": 0.0, "end": 1.0, "duration": 1.0, "magnitude": 1.0}
                left = signal.without_harmonics([base | {"frequency": 300.0 + k}, base | {"frequency": 600.0 + 2 * k}, base | {"frequency": 777.0 + k / 3}])
                out.append((k, len(left)))
            yield pd.DataFrame(out, columns=["k", "tones"])

    return calls(spark, sf).select("k").distinct().mapInPandas(run, "k bigint, tones bigint")


@query("m31_wav_round_trip")
def m31(spark, sf):
    """Samples of a written and read WAV for each channel, and its hash."""
    import numpy as np

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(signal.RATE) / signal.RATE
        for rows in batches:
            out = []
            for ref in rows["talkgroup_ref"].tolist():
                x, rate = signal.pcm_of_wav(signal.wav_of_pcm(0.5 * np.sin(2 * np.pi * 100 * ref * t)))
                region = signal.paging_region(x, rate)
                out.append((ref, len(x), signal.pcm_hash(x), round(region[1] - region[0], 3)))
            yield pd.DataFrame(out, columns=["talkgroup_ref", "samples", "hash", "region_s"])

    return calls(spark, sf).select("talkgroup_ref").distinct().mapInPandas(run, "talkgroup_ref bigint, samples bigint, hash string, region_s double")


@query("m32_harmonic_rejection", f"WITH {CALLS} SELECT call_id, abs(duration / 50 - 2) <= 0.14 OR abs(duration / 50 - 3) <= 0.21 AS harmonic FROM calls")
def m32(spark, sf):
    hit = F.exists(F.array(F.lit(2.0), F.lit(3.0)), lambda n: F.abs(F.col("duration") / 50 - n) <= n * 0.07)
    return calls(spark, sf).select("call_id", hit.alias("harmonic"))


@query("g11_location_suggestions", "SELECT c_mktsegment AS tone_set, min_by(c_custkey, abs(c_acctbal - 5000) * 1000 + c_custkey / 1e9) AS place FROM customer WHERE abs(c_acctbal - 5000) <= 3000 GROUP BY 1")
def g11(spark, sf):
    near = table(spark, sf, "customer").where("abs(c_acctbal - 5000) <= 3000")
    return near.groupBy(F.col("c_mktsegment").alias("tone_set")).agg(F.min(F.struct(F.abs(F.col("c_acctbal") - 5000).alias("d"), "c_custkey"))["c_custkey"].alias("place"))


@query("g02_assigned_natures", f"WITH {CALLS} SELECT call_id, CASE WHEN k % 3 = 0 THEN 'FIRE' WHEN k % 3 = 1 THEN 'MODEL' ELSE 'UNKNOWN PROBLEM' END AS nature FROM calls")
def g02(spark, sf):
    by_phrase, by_model = F.when(F.col("k") % 3 == 0, "FIRE"), F.when(F.col("k") % 3 == 1, "MODEL")
    return calls(spark, sf).select("call_id", nature.with_fallback(F.coalesce(by_phrase, by_model)).alias("nature"))


@query("m23_home_ceiling_and_mutual_aid", "SELECT s_suppkey AS id, abs(s_acctbal) / 200 <= 30 OR s_nationkey IN (2, 3) AS covered FROM supplier")
def m23(spark, sf):
    miles = geo.flat_miles(F.lit(0.0), F.lit(0.0), F.abs(F.col("s_acctbal")) / 200 / 69, F.lit(0.0))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.round(miles, 9) <= 30) | F.col("s_nationkey").isin(2, 3)).alias("covered"))


# ------------------------------------------------------------------ stream details


@query("t04_stored_duplicates", f"WITH {CALLS}, l AS (SELECT *, lag(ts_ms) OVER w AS p, lag(duration) OVER w AS d FROM calls WINDOW w AS (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id)) SELECT call_id FROM l WHERE ts_ms - p <= 1800000 AND duration > 0 AND d > 0 AND (abs(duration - d) <= 0.4 OR abs(duration - d) <= greatest(duration, d) * 0.15)")
def t04(spark, sf):
    return temporal.prior_arrival(calls(spark, sf), CHANNEL, 30 * MINUTE).where("prior is not null").select("call_id")


@query("t08_linked_channels", f"WITH {CALLS} SELECT call_id, t AS heard_on FROM calls, LATERAL (SELECT talkgroup_ref AS t UNION ALL SELECT 2 WHERE talkgroup_ref = 1) x")
def t08(spark, sf):
    """Tones go to their own channel's state and to that of a linked one."""
    both = F.when(F.col("talkgroup_ref") == 1, F.array(F.col("talkgroup_ref"), F.lit(2).cast("bigint"))).otherwise(F.array("talkgroup_ref"))
    return run_available(call_stream(spark, sf).select("call_id", F.explode(both).alias("heard_on")))


@query("t13_restored_delays", PENDING.format(calls=CALLS).replace("x.system_ref, x.talkgroup_ref, x.call_id AS tone_call, v.voice AS voice_call", "x.call_id AS tone_call, v.voice AS voice_call"))
def t13(spark, sf):
    """Pending state as a stream keeps it in its checkpoint."""
    ship(spark)
    return run_available(stateful.pending_tones(call_stream(spark, sf).withColumn("has_tones", F.col("k") < 30), CHANNEL, 2 * HOUR)).select("tone_call", "voice_call")


@query("t22_bounded_queue", f"WITH {CALLS} SELECT call_id FROM calls")
def t22(spark, sf):
    """A bounded intake that drops nothing: the stream takes a file at a time."""
    from ..sources.adapters import epoch_ms

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    return run_available(raw.select(F.col("event_id").alias("call_id"), epoch_ms("ts").alias("ts_ms"))).select("call_id")


@query("t25_pre_alerts", COOLDOWN.format(calls=CALLS, keys="system_ref", fkeys="f.system_ref", okeys="o.system_ref", match="o.system_ref = f.system_ref", ms=3_600_000, where="k BETWEEN 30 AND 60"))
def t25(spark, sf):
    ship(spark)
    return run_available(stateful.cooldown(call_stream(spark, sf).where("k between 30 and 60"), ["system_ref"], HOUR))


@query("t26_combined_alerts", f"WITH {CALLS}, {TALKGROUPS} SELECT call_id, CASE WHEN k < 30 AND k % 10 = 1 THEN 'both' WHEN k < 30 THEN 'tone' ELSE 'keyword' END AS kind FROM calls JOIN talkgroups USING (talkgroup_ref) WHERE k < 30 OR k % 10 = 1")
def t26(spark, sf):
    tone, word = F.col("k") < 30, F.col("k") % 10 == 1
    kind = F.when(tone & word, "both").when(tone, "tone").otherwise("keyword")
    return run_available(call_stream(spark, sf).where(tone | word).join(F.broadcast(talkgroups(spark)), "talkgroup_ref").select("call_id", kind.alias("kind")))


@query("t35_mapping_queue", f"WITH {CALLS} SELECT call_id, k % 2 = 0 AS mapped FROM calls")
def t35(spark, sf):
    """As many calls at once as there are tasks."""
    return calls(spark, sf).select("call_id", (F.col("k") % 2 == 0).alias("mapped"))


@query("t01_micro_batches", f"WITH {CALLS} SELECT unit_ref, count(*) AS calls FROM calls GROUP BY 1")
def t01(spark, sf):
    return run_available(call_stream(spark, sf).select("unit_ref", "call_id")).groupBy("unit_ref").agg(F.count(F.lit(1)).alias("calls"))
