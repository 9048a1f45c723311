"""Further sources and sinks (S), text and address functions (F), audio (M, W), labels (G) and stream stages (T)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import address, geo, nature, signal, streets
from ..functions import text as tx
from ..operators import temporal, upserts
from ..sources.adapters import CALLS, DAY, HOUR, MINUTE, SYSTEMS, TALKGROUPS, calls, last_moment, systems, table, talkgroups
from ..sources.shared import new_folder, ship
from ..streaming.sources import call_stream, run_available
from .registry import query
from .text import SKELETONS


@query("s01_upload_fields", f"WITH {CALLS} SELECT call_id, system_ref AS system, talkgroup_ref AS talkgroup, k * 100 AS frequency FROM calls")
def s01(spark, sf):
    """Form fields by name; numbers that do not parse are absent."""
    body = F.to_json(F.struct(F.col("system_ref").cast("string").alias("system"), F.col("talkgroup_ref").cast("string").alias("talkgroup"), (F.col("k") * 100).cast("string").alias("frequency"), F.lit("x").alias("site")))
    form = F.from_json(body, "map<string,string>")
    field = lambda n: F.try_element_at(form, F.lit(n)).try_cast("bigint").alias(n)
    return calls(spark, sf).select("call_id", field("system"), field("talkgroup"), field("frequency"))


@query("s08_file_ingest", "SELECT count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def s08(spark, sf):
    """Files of one extension, found in all subfolders, with several records each."""
    path = new_folder(spark)
    filed = table(spark, sf, "documents").select("text", F.concat(F.lit("d"), F.pmod("doc_id", F.lit(20)).cast("string")).alias("d"))
    filed.write.partitionBy("d").option("lineSep", "\x01").text(path)
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("lineSep", "\x01").text(path)
    return found.agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes"))


@query("s15_tone_set_builder", "SELECT s_suppkey AS id, round(s_acctbal, 2) AS a, CASE WHEN s_suppkey % 2 = 0 THEN 10.0 ELSE 0.02 * 500 END::DOUBLE AS tolerance FROM supplier")
def s15(spark, sf):
    one = F.struct(F.struct(F.round("s_acctbal", 2).alias("frequency"), F.lit(0.6).alias("min")).alias("a"), F.when(F.col("s_suppkey") % 2 == 0, 10.0).otherwise(0.02).alias("tolerance"))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), one.alias("t"))
    return rows.select("id", F.col("t.a.frequency").alias("a"), F.when(F.col("t.tolerance") < 1, F.col("t.tolerance") * 500).otherwise(F.col("t.tolerance")).alias("tolerance"))


@query("s16_two_tone_config", "SELECT s_name AS label, floor(abs(s_acctbal)) AS a FROM supplier")
def s16(spark, sf):
    """Sections of an INI-like file, each with its tones."""
    path = new_folder(spark)
    block = F.concat(F.lit("["), "s_name", F.lit("]\natone = "), F.floor(F.abs(F.col("s_acctbal"))).cast("string"), F.lit("\n; note\n"))
    table(spark, sf, "supplier").select(block.alias("value")).write.text(path)
    section = spark.read.option("lineSep", "[").text(path).where("trim(value) <> ''")
    return section.select(F.split_part("value", F.lit("]"), F.lit(1)).alias("label"), F.regexp_extract("value", r"atone\s*=\s*([\d.]+)", 1).try_cast("double").alias("a"))


@query("s19_boundary_upsert", "SELECT c_mktsegment AS layer, c_nationkey::BIGINT AS geoid, min(c_custkey) AS id FROM customer GROUP BY 1, 2")
def s19(spark, sf):
    return upserts.first_by(table(spark, sf, "customer").withColumn("geoid", F.col("c_nationkey").cast("bigint")).withColumnsRenamed({"c_mktsegment": "layer", "c_custkey": "id"}), [F.col("layer"), F.col("geoid")], F.col("id"), "layer", "geoid", "id")


@query("s26_forwarded_calls", f"WITH {CALLS} SELECT talkgroup_ref, count(*) AS sent FROM calls WHERE system_ref IN (1, 3) GROUP BY 1")
def s26(spark, sf):
    """A sink for each micro-batch that forwards what the target may have."""
    path = new_folder(spark)

    def forward(batch, number: int) -> None:
        batch.where("system_ref in (1, 3)").select("talkgroup_ref", "call_id").write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream = call_stream(spark, sf).writeStream.foreachBatch(forward).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("talkgroup_ref bigint, call_id bigint").parquet(f"{path}/out").groupBy("talkgroup_ref").agg(F.count(F.lit(1)).alias("sent"))


@query("s30_dimension_graph", f"WITH {CALLS}, {SYSTEMS}, {TALKGROUPS} SELECT system_ref, system_label, string_agg(DISTINCT label, ',' ORDER BY label) AS channels FROM calls JOIN systems USING (system_ref) JOIN talkgroups USING (talkgroup_ref) GROUP BY 1, 2")
def s30(spark, sf):
    pairs = calls(spark, sf).select("system_ref", "talkgroup_ref").distinct().join(F.broadcast(talkgroups(spark)), "talkgroup_ref").join(F.broadcast(systems(spark, sf)), "system_ref")
    return pairs.groupBy("system_ref", "system_label").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("channels"))


@query("a40_merged_labels", "SELECT p_brand AS pin, COALESCE(string_agg(DISTINCT p_type, ', ' ORDER BY p_type) FILTER (p_size > 45), 'UNKNOWN PROBLEM') AS labels FROM part GROUP BY 1")
def a40(spark, sf):
    found = F.array_join(F.array_sort(F.collect_set(F.when(F.col("p_size") > 45, F.col("p_type")))), ", ")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("pin")).agg(F.coalesce(F.nullif(found, F.lit("")), F.lit(nature.UNKNOWN)).alias("labels"))


@query("f24_phonetic_keys", f"WITH {SKELETONS} SELECT s AS p_name, skeleton AS keys FROM skeletons WHERE length(skeleton) >= 2")
def f24(spark, sf):
    """Skeletons of a core and its singled forms; they fall together, as the oracle says."""
    keys = F.array_distinct(F.filter(F.transform(streets.singled(F.regexp_replace(F.upper("p_name"), " ", "")), streets.skeleton), lambda k: F.length(k) >= 2))
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", F.array_join(keys, "|").alias("keys")).where("keys <> ''")


@query("f27_corrected_addresses", "SELECT p_partkey AS id, (p_size + 100) || ' RED RING RD' AS address FROM part WHERE p_name = 'red ring'")
def f27(spark, sf):
    known = spark.createDataFrame([("RED RING",), ("BLUE BOLT",)], "street string")
    said = table(spark, sf, "part").where("p_name = 'red ring'").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).cast("string").alias("n"), F.lit("RAD RING").alias("heard"))
    best = streets.best_matches(said.select(F.col("heard").alias("said")), known).withColumnRenamed("said", "heard")
    return said.join(best, "heard").select("id", F.concat("n", F.lit(" "), "street", F.lit(" RD")).alias("address"))


@query("f42_canonical_label", "SELECT p_partkey AS id, CASE upper(p_type) WHEN 'ECONOMY' THEN 'E' WHEN 'SMALL' THEN 'S' ELSE upper(p_type) END AS label FROM part")
def f42(spark, sf):
    known = F.create_map(*[F.lit(x) for x in ("ECONOMY", "E", "SMALL", "S")])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.try_element_at(known, F.upper("p_type")), F.upper("p_type")).alias("label"))


@query("f44_sanitised_nature", f"WITH {CALLS} SELECT call_id, CASE k % 3 WHEN 0 THEN 'BURGLARY' WHEN 1 THEN '' ELSE 'FIRE' END AS nature FROM calls")
def f44(spark, sf):
    said = F.element_at(F.array(F.lit("burglar alarm drop"), F.lit("comes back to a red ford"), F.lit("fire at the mill")), (F.col("k") % 3).cast("int") + 1)
    label = F.element_at(F.array(F.lit("ALARM DROP MEDICAL"), F.lit("TRAFFIC"), F.lit("FIRE")), (F.col("k") % 3).cast("int") + 1)
    return calls(spark, sf).select("call_id", nature.sanitise(said, label).alias("nature"))


@query("f53_acceptable_phrases", "SELECT DISTINCT p_name AS phrase FROM part WHERE length(p_name) BETWEEN 4 AND 40 AND NOT contains(p_name, '.') AND NOT contains(upper(p_name), 'UNKNOWN') AND len(string_split(p_name, ' ')) <= 5")
def f53(spark, sf):
    p = F.col("p_name")
    fine = F.length(p).between(4, 40) & ~F.contains(p, F.lit(".")) & ~F.contains(F.upper(p), F.lit("UNKNOWN")) & (F.size(F.split(p, " ")) <= 5)
    return table(spark, sf, "part").where(fine).select(p.alias("phrase")).distinct()


@query("m07_energy_profiles")
def m07(spark, sf):
    """RMS profile of a clip for each channel: a tone that swells."""
    import numpy as np

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(signal.RATE) / signal.RATE
        for rows in batches:
            out = [(r.talkgroup_ref, [round(float(v), 4) for v in signal.energy_profile(t * np.sin(2 * np.pi * 400 * r.talkgroup_ref * t))]) for r in rows.itertuples()]
            yield pd.DataFrame(out, columns=["talkgroup_ref", "profile"])

    return calls(spark, sf).select("talkgroup_ref").distinct().mapInPandas(run, "talkgroup_ref bigint, profile array<double>")


@query("m27_coloured_boundaries")
def m27(spark, sf):
    """Adjacent nations (they share a region and their numbers are near), coloured in order on the driver: one row a nation."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), "n_regionkey")
    pairs = n.join(n.withColumnRenamed("id", "other"), "n_regionkey").where("id <> other and abs(id - other) <= 6")
    near: dict[int, set[int]] = {r.id: set() for r in n.orderBy("id").collect()}
    for r in pairs.collect():
        near[r.id].add(r.other)
    return spark.createDataFrame(sorted(geo.colours(near).items()), "id bigint, colour bigint")


@query("w05_first_later_voice", f"WITH {CALLS} SELECT a.call_id, (SELECT min_by(b.call_id, b.ts_ms) FROM calls b WHERE b.talkgroup_ref = a.talkgroup_ref AND b.system_ref = a.system_ref AND b.k > 60 AND b.ts_ms > a.ts_ms AND b.ts_ms <= a.ts_ms + 1200000) AS next_call FROM calls a")
def w05(spark, sf):
    return temporal.next_matching(calls(spark, sf), ["system_ref", "talkgroup_ref"], F.col("k") > 60, 1_200_000).select("call_id", "next_call")


@query("w18_kept_spans", "SELECT l_orderkey AS call_id, round(min(l_quantity) - 0.05, 4) AS first_gap_end FROM lineitem WHERE l_quantity > 0 GROUP BY 1 HAVING min(l_quantity) - 0.05 >= 0.3")
def w18(spark, sf):
    """What is left of a clip before its first tone: spans of tones are merged in order of their start."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for call, tones in zip(rows["call_id"], rows["tones"]):
                spans = signal.kept_spans(100.0, [(t["start"], t["stop"]) for t in tones])
                if spans and spans[0][0] == 0.0 and spans[0][1] < 100:
                    out.append((call, round(spans[0][1], 4)))
            yield pd.DataFrame(out, columns=["call_id", "first_gap_end"])

    tones = table(spark, sf, "lineitem").where("l_quantity > 0").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_tax") * 10).alias("stop"))).alias("tones"))
    return tones.mapInPandas(run, "call_id bigint, first_gap_end double")


@query("g07_inherited_pins", f"WITH {CALLS}, p AS (SELECT a.call_id, min_by(b.call_id, abs(a.ts_ms - b.ts_ms) * 1000000 + b.call_id) AS peer FROM calls a JOIN calls b ON a.system_ref = b.system_ref AND b.k >= 50 AND abs(a.ts_ms - b.ts_ms) <= 1200000 WHERE a.k < 50 GROUP BY 1) SELECT * FROM p")
def g07(spark, sf):
    c = calls(spark, sf).select("call_id", "ts_ms", "system_ref", "k")
    moment, peer = F.col("ts_ms") * 1_000_000, F.col("call_id")  # the twin's order: a gap's millisecond weighs as much as a million ids
    value = lambda key: F.struct(key.alias("key"), peer.alias("peer"))
    found = temporal.best_in_band(c, ["system_ref"], 1_200_000, F.col("k") >= 50, value(peer - moment), value(peer + moment), F.col("k") < 50)
    side = lambda c, key: F.when(F.col(c).isNotNull(), F.struct(key.alias("key"), F.col(f"{c}.peer")))
    best = F.least(side("back", F.col("back.key") + moment), side("ahead", F.col("ahead.key") - moment))
    return found.groupBy("call_id").agg(F.min(best).alias("b")).where("b is not null").select("call_id", "b.peer")


@query("g10_nature_backfill", "SELECT p_partkey AS call_id, CASE WHEN p_type = 'SMALL' THEN 'NEW' ELSE p_type END AS nature FROM part")
def g10(spark, sf):
    old, new = F.col("p_type"), F.when(F.col("p_type") == "SMALL", "NEW").otherwise("UNKNOWN")
    allowed = F.when(F.contains(new, F.lit("UNKNOWN")), F.lit(False)).otherwise(new != old)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("call_id"), F.when(allowed, new).otherwise(old).alias("nature"))


@query("t02_ingest_stages", f"WITH {CALLS} SELECT call_id, CASE WHEN talkgroup_ref = 5 THEN k % 5 + 1 ELSE talkgroup_ref END AS talkgroup_ref FROM calls WHERE talkgroup_ref <> 3 AND system_ref > 0")
def t02(spark, sf):
    """Blacklist, then patches for unknown channels, then validity, over a stream."""
    known = F.when(F.col("talkgroup_ref") == 5, F.col("k") % 5 + 1).otherwise(F.col("talkgroup_ref"))
    return run_available(call_stream(spark, sf).where("talkgroup_ref <> 3").select("call_id", known.alias("talkgroup_ref"), "system_ref").where("system_ref > 0").drop("system_ref"))


@query("t21_health_monitors", f"WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls) SELECT 'failures' AS monitor, count(*) FILTER (k % 10 = 0) AS n FROM calls, m WHERE ts_ms >= t - 86400000 UNION ALL SELECT 'silent', count(*) FROM (SELECT system_ref, talkgroup_ref FROM calls GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (duration > 400) = 0)")
def t21(spark, sf):
    from ..operators.stats import silent_channels

    c = calls(spark, sf)
    failures = c.where(F.col("ts_ms") >= last_moment(c) - DAY).agg(F.count_if(F.col("k") % 10 == 0).alias("n")).select(F.lit("failures").alias("monitor"), "n")
    return failures.unionByName(silent_channels(c, F.col("duration") > 400).agg(F.count(F.lit(1)).alias("n")).select(F.lit("silent").alias("monitor"), "n"))


@query("t27_merged_keyword_alerts", f"WITH {CALLS} SELECT unit_ref, string_agg(DISTINCT talkgroup_ref::VARCHAR, ',' ORDER BY talkgroup_ref::VARCHAR) AS keywords FROM calls GROUP BY 1")
def t27(spark, sf):
    stream = call_stream(spark, sf).select("unit_ref", F.col("talkgroup_ref").cast("string").alias("w")).dropDuplicates()
    return run_available(stream).groupBy("unit_ref").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("keywords"))


@query("t28_learned_tone_sets", f"WITH {CALLS} SELECT system_ref, CAST(round(duration / 50) AS BIGINT) AS a, count(DISTINCT call_id) AS calls FROM calls GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 3")
def t28(spark, sf):
    return calls(spark, sf).groupBy("system_ref", F.round(F.col("duration") / 50).cast("bigint").alias("a")).agg(F.count_distinct("call_id").alias("calls")).where("calls >= 3")


@query("t29_learned_units", f"WITH {CALLS} SELECT unit_ref, count(DISTINCT talkgroup_ref) AS labels, max(ts_ms) AS seen_ms FROM calls GROUP BY 1")
def t29(spark, sf):
    return calls(spark, sf).groupBy("unit_ref").agg(F.count_distinct("talkgroup_ref").alias("labels"), F.max("ts_ms").alias("seen_ms"))


@query("t32_missed_buffer", f"WITH {CALLS}, r AS (SELECT call_id, unit_ref, row_number() OVER (PARTITION BY unit_ref ORDER BY ts_ms DESC, call_id DESC) AS n, max(ts_ms) OVER () AS t, ts_ms FROM calls) SELECT call_id, unit_ref FROM r WHERE n <= 5 AND ts_ms >= t - 12 * 3600000")
def t32(spark, sf):
    c = calls(spark, sf)
    w = Window.partitionBy("unit_ref").orderBy(F.desc("ts_ms"), F.desc("call_id"))
    return c.where(F.col("ts_ms") >= last_moment(c) - 12 * HOUR).withColumn("n", F.row_number().over(w)).where("n <= 5").select("call_id", "unit_ref")


@query("t34_scheduled_pruning", f"WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls) SELECT talkgroup_ref, count(*) AS kept FROM calls, m WHERE ts_ms >= t - CASE talkgroup_ref WHEN 1 THEN 5 WHEN 2 THEN 14 ELSE 20 END * 86400000::BIGINT GROUP BY 1")
def t34(spark, sf):
    c = calls(spark, sf)
    days = F.when(F.col("talkgroup_ref") == 1, 5).when(F.col("talkgroup_ref") == 2, 14).otherwise(20)
    return c.where(F.col("ts_ms") >= F.lit(last_moment(c)) - days * DAY).groupBy("talkgroup_ref").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "w12_request_windows",
    f"""WITH RECURSIVE {CALLS}, f AS (SELECT unit_ref, min(ts_ms) AS s FROM calls GROUP BY 1 UNION ALL SELECT f.unit_ref, (SELECT min(ts_ms) FROM calls c WHERE c.unit_ref = f.unit_ref AND c.ts_ms > f.s + 172800000) FROM f WHERE f.s IS NOT NULL)
 SELECT f.unit_ref, s AS window_ms, count(*) AS requests, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected FROM f JOIN calls c ON c.unit_ref = f.unit_ref AND c.ts_ms >= s AND c.ts_ms <= s + 172800000 GROUP BY 1, 2""",
)
def w12(spark, sf):
    """Windows that open with the first request; two requests in each are allowed."""
    placed = temporal.anchored_windows(calls(spark, sf), ["unit_ref"], 48 * 60 * MINUTE)
    n = F.count(F.lit(1))
    return placed.groupBy("unit_ref", "window_ms").agg(n.alias("requests"), F.least(n, F.lit(2)).alias("allowed"), F.greatest(n - 2, F.lit(0)).alias("rejected"))




@query("s21_xml_talkgroups", "SELECT p_partkey AS ref, p_name AS label FROM part")
def s21(spark, sf):
    item = F.concat(F.lit("<tg><dec>"), F.col("p_partkey").cast("string"), F.lit("</dec><label>"), F.col("p_name"), F.lit("</label></tg>"))
    parsed = table(spark, sf, "part").select(F.from_xml(item, "dec bigint, label string").alias("x"))
    return parsed.select(F.col("x.dec").alias("ref"), "x.label")


@query("t37_bulk_tone_flags", "SELECT c_custkey AS talkgroup_ref, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN TRUE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal > 0 END AS detect FROM customer")
def t37(spark, sf):
    """Tone detection set on for all channels of some tags, and left as it is for the others; a customer is a channel, its segment the tag."""
    before = F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal") > 0)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("talkgroup_ref"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), True).otherwise(before).alias("detect"))


@query("n11_bulk_tag_flag", "SELECT c_custkey AS talkgroup_ref, c_mktsegment IN ('BUILDING', 'FURNITURE') AS detect FROM customer")
def n11(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("talkgroup_ref"), F.array_contains(F.array(F.lit("BUILDING"), F.lit("FURNITURE")), F.col("c_mktsegment")).alias("detect"))


@query("n06_delay_maps", "SELECT o_custkey AS system_ref, o_custkey || ':' || o_orderkey AS channel, CAST(o_orderkey % 60 AS INT) AS delay FROM orders")
def n06(spark, sf):
    """Each system's delays, one JSON map a system, by channel."""
    entry = F.struct(F.concat_ws(":", "o_custkey", "o_orderkey").alias("key"), (F.col("o_orderkey") % 60).cast("int").alias("value"))
    maps = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("system_ref")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("delays"))
    return maps.select("system_ref", F.explode(F.from_json("delays", "map<string,int>")).alias("channel", "delay"))


@query("t36_merged_successors", f"WITH {CALLS} SELECT talkgroup_ref, count(DISTINCT k) AS tone_sets, max(ts_ms) AS anchor_ms FROM calls GROUP BY 1")
def t36(spark, sf):
    """What waits and what came after it become one: the tone sets of both without repeats, and the later anchor."""
    side = lambda waits: calls(spark, sf).where(waits).groupBy("talkgroup_ref").agg(F.collect_set("k").alias("sets"), F.max("ts_ms").alias("anchor_ms"))
    both = side(F.col("k") < 50).unionByName(side(F.coalesce(F.col("k") >= 50, F.lit(True))))
    return both.groupBy("talkgroup_ref").agg(F.size(F.array_distinct(F.flatten(F.collect_list("sets")))).cast("bigint").alias("tone_sets"), F.max("anchor_ms").alias("anchor_ms"))
