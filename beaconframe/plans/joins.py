"""Joins (J) and window-like operators (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..operators.numbering import numbered
from ..sources.adapters import CALLS, SYSTEMS, TALKGROUPS, calls, systems, table, talkgroups
from .registry import query


@query("j01_not_delayed", "SELECT o_orderkey AS call_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j01(spark, sf):
    held = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(held, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("call_id"))


@query("j02_alerts_with_labels", f"WITH {CALLS}, {SYSTEMS}, {TALKGROUPS} SELECT call_id, system_label, label FROM calls LEFT JOIN systems USING (system_ref) LEFT JOIN talkgroups USING (talkgroup_ref) ORDER BY ts_ms DESC, call_id DESC LIMIT 500")
def j02(spark, sf):
    newest = calls(spark, sf).orderBy(F.desc("ts_ms"), F.desc("call_id")).limit(500)
    return newest.join(F.broadcast(systems(spark, sf)), "system_ref", "left").join(F.broadcast(talkgroups(spark)), "talkgroup_ref", "left").select("call_id", "system_label", "label")


@query("j03_transcripts_with_labels", f"WITH {CALLS}, {SYSTEMS} SELECT doc_id AS call_id, system_label FROM documents LEFT JOIN systems ON doc_id % 9 = system_ref WHERE NOT EXISTS (SELECT 1 FROM calls WHERE call_id = doc_id AND k = 3)")
def j03(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), (F.col("doc_id") % 9).alias("system_ref"))
    held = calls(spark, sf).where("k = 3").select("call_id")
    return d.join(held, "call_id", "left_anti").join(F.broadcast(systems(spark, sf)), "system_ref", "left").select("call_id", "system_label")


@query("j04_incidents_composite_key", f"WITH {CALLS}, {TALKGROUPS}, {SYSTEMS} SELECT call_id, label, system_label FROM calls LEFT JOIN talkgroups t ON calls.talkgroup_ref = t.talkgroup_ref AND (calls.system_ref + calls.talkgroup_ref) % 2 = t.talkgroup_ref % 2 LEFT JOIN systems USING (system_ref) WHERE k > 90")
def j04(spark, sf):
    t = talkgroups(spark).withColumn("odd", F.col("talkgroup_ref") % 2)
    c = calls(spark, sf).where("k > 90").withColumn("odd", (F.col("system_ref") + F.col("talkgroup_ref")) % 2)
    return c.join(F.broadcast(t), ["talkgroup_ref", "odd"], "left").join(F.broadcast(systems(spark, sf)), "system_ref", "left").select("call_id", "label", "system_label")


@query("j05_call_metadata", "SELECT o_orderkey AS call_id, o_orderstatus AS status, c_name AS talkgroup, n_name AS system, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS patches FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4")
def j05(spark, sf):
    patches = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("patches"))
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(patches, "o_orderkey", "left")
    return joined.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("talkgroup"), F.col("n_name").alias("system"), "patches")


@query("j06_single_call", "SELECT o_orderkey AS call_id, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS patches FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 77 GROUP BY 1")
def j06(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey = 77")
    li = table(spark, sf, "lineitem").where("l_orderkey = 77")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy(F.col("o_orderkey").alias("call_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("patches"))


@query("j07_to_delete", f"WITH {CALLS}, {SYSTEMS}, {TALKGROUPS} SELECT call_id FROM calls JOIN systems USING (system_ref) JOIN talkgroups USING (talkgroup_ref) WHERE keep_days > 0 AND ts_ms < 1706600000000 - keep_days * 86400000")
def j07(spark, sf):
    joined = calls(spark, sf).join(F.broadcast(systems(spark, sf)), "system_ref").join(F.broadcast(talkgroups(spark)), "talkgroup_ref")
    return joined.where(F.expr("keep_days > 0 and ts_ms < 1706600000000 - keep_days * 86400000")).select("call_id")


@query("j08_channel_counts", f"WITH {CALLS}, {TALKGROUPS} SELECT label, count(*) AS calls FROM calls JOIN talkgroups USING (talkgroup_ref) GROUP BY 1")
def j08(spark, sf):
    return calls(spark, sf).groupBy("talkgroup_ref").agg(F.count(F.lit(1)).alias("calls")).join(F.broadcast(talkgroups(spark)), "talkgroup_ref").select("label", "calls")


TONE_SETS = '[{"id":"0","label":"Medic"},{"id":"1","label":"Engine"},{"id":"2","label":""}]'


@query("j09_tone_set_label", f"WITH {CALLS}, s(id, label) AS (VALUES ('0', 'Medic'), ('1', 'Engine'), ('2', NULL)) SELECT call_id, label AS tone_set FROM calls LEFT JOIN s ON id = (k % 4)::VARCHAR")
def j09(spark, sf):
    sets = F.from_json(F.lit(TONE_SETS), "array<struct<id:string,label:string>>")
    found = F.get(F.filter(sets, lambda s: s["id"] == (F.col("k") % 4).cast("string")), F.lit(0))
    return calls(spark, sf).select("call_id", F.nullif(found["label"], F.lit("")).alias("tone_set"))


@query("j10_watched_channels", f"WITH {CALLS} SELECT DISTINCT talkgroup_ref, system_ref FROM calls c WHERE talkgroup_ref = 2 OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = c.unit_ref AND c_mktsegment = 'BUILDING')")
def j10(spark, sf):
    watched = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("unit_ref"), F.lit(True).alias("watched"))
    channels = calls(spark, sf).select("talkgroup_ref", "system_ref", "unit_ref").distinct()
    return channels.join(watched, "unit_ref", "left").where("talkgroup_ref = 2 or watched").select("talkgroup_ref", "system_ref").distinct()


@query("j11_missing_options", "SELECT n_nationkey::BIGINT AS key, 'default' AS value FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def j11(spark, sf):
    known = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(known, "n_nationkey", "left_anti").select(F.col("n_nationkey").cast("bigint").alias("key"), F.lit("default").alias("value"))


@query("j12_label_duplicates", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT min(p_partkey) FROM part GROUP BY p_name)")
def j12(spark, sf):
    p = table(spark, sf, "part")
    return p.withColumn("first", F.min("p_partkey").over(Window.partitionBy("p_name"))).where("p_partkey <> first").select(F.col("p_partkey").alias("id"))


@query("j13_denormalised_refs", f"WITH {CALLS}, {SYSTEMS} SELECT call_id, system_ref, system_label, region FROM calls JOIN systems USING (system_ref)")
def j13(spark, sf):
    return calls(spark, sf).join(F.broadcast(systems(spark, sf)), "system_ref").select("call_id", "system_ref", "system_label", "region")


@query("j14_source_unit", "SELECT o_orderkey AS call_id, (SELECT min_by(l_suppkey, (l_linenumber * 1000000 + l_suppkey)) FROM lineitem WHERE l_orderkey = o_orderkey) AS source FROM orders")
def j14(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("source"))
    return table(spark, sf, "orders").join(first, "o_orderkey", "left").select(F.col("o_orderkey").alias("call_id"), "source")


@query("j15_preference_alerts", f"WITH {CALLS}, {TALKGROUPS} SELECT DISTINCT unit_ref, c.talkgroup_ref FROM calls c WHERE COALESCE((SELECT alerts FROM talkgroups t WHERE t.talkgroup_ref = c.talkgroup_ref), TRUE)")
def j15(spark, sf):
    return calls(spark, sf).select("unit_ref", "talkgroup_ref").distinct().join(F.broadcast(talkgroups(spark)), "talkgroup_ref", "left").where(F.coalesce("alerts", F.lit(True))).select("unit_ref", "talkgroup_ref")


BAND = "a.talkgroup_ref = b.talkgroup_ref AND a.system_ref = b.system_ref AND a.call_id <> b.call_id AND abs(a.ts_ms - b.ts_ms) <= {w}"


@query("j16_band_self_join", f"WITH {CALLS} SELECT a.call_id, b.call_id AS other, abs(a.ts_ms - b.ts_ms) AS gap_ms FROM calls a JOIN calls b ON {BAND.format(w=120000)} WHERE a.duration > 0 AND b.duration > 0")
def j16(spark, sf):
    c = calls(spark, sf).where("duration > 0").select("call_id", "ts_ms", "system_ref", "talkgroup_ref")
    found = temporal.band_join(c, c, ["system_ref", "talkgroup_ref"], 120_000).where("call_id <> r_call_id")
    return found.select("call_id", F.col("r_call_id").alias("other"), F.abs(F.col("r_ts_ms") - F.col("ts_ms")).alias("gap_ms"))


@query(
    "j17_five_nearest",
    f"""WITH {CALLS}, p AS (SELECT a.call_id, b.call_id AS other, abs(a.ts_ms - b.ts_ms) AS gap_ms FROM calls a JOIN calls b ON {BAND.format(w=3600000)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY gap_ms, other) AS place FROM p) SELECT * FROM r WHERE place <= 5""",
)
def j17(spark, sf):
    c = calls(spark, sf).select("call_id", "ts_ms", "system_ref", "talkgroup_ref")
    return temporal.nearest_of_each(c, ["system_ref", "talkgroup_ref"], 3_600_000, 5).select("call_id", "other", "gap_ms", "place")


@query("j18_timestamp_probe", f"WITH {CALLS} SELECT a.call_id, b.call_id AS other FROM calls a JOIN calls b ON {BAND.format(w=600000)} WHERE least(a.duration, b.duration) / greatest(a.duration, b.duration) >= 0.5")
def j18(spark, sf):
    c = calls(spark, sf).select("call_id", "ts_ms", "system_ref", "talkgroup_ref", "duration")
    found = temporal.band_join(c, c, ["system_ref", "talkgroup_ref"], 600_000).where("call_id <> r_call_id")
    return found.where(temporal.duration_ratio(F.col("duration"), F.col("r_duration"))).select("call_id", F.col("r_call_id").alias("other"))


ALIKE = "(abs(duration - d) <= 0.4 OR abs(duration - d) <= greatest(duration, d) * 0.15)"


@query("j19_prior_arrival_dup", f"WITH {CALLS}, l AS (SELECT *, lag(ts_ms) OVER w AS p, lag(duration) OVER w AS d, lag(call_id) OVER w AS i FROM calls WINDOW w AS (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id)) SELECT call_id, CASE WHEN ts_ms - p <= 1800000 AND duration > 0 AND d > 0 AND {ALIKE} THEN i END AS prior FROM l")
def j19(spark, sf):
    return temporal.prior_arrival(calls(spark, sf), ["system_ref", "talkgroup_ref"], 1_800_000).select("call_id", "prior")


@query(
    "j20_peer_pin",
    f"""WITH {CALLS}, p AS (SELECT a.call_id, b.call_id AS peer, CASE WHEN b.k < 30 THEN 0 WHEN b.k < 60 THEN 1 ELSE 2 END AS rank, abs(a.ts_ms - b.ts_ms) AS gap_ms FROM calls a JOIN calls b ON a.system_ref = b.system_ref AND a.call_id <> b.call_id AND abs(a.ts_ms - b.ts_ms) <= 1200000),
    r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rank, gap_ms, peer) AS n FROM p) SELECT call_id, peer, gap_ms FROM r WHERE n = 1""",
)
def j20(spark, sf):
    c = calls(spark, sf).select("call_id", "ts_ms", "system_ref", "k")
    rank = F.when(F.col("k") < 30, 0).when(F.col("k") < 60, 1).otherwise(2)
    return temporal.nearest_peers(c, ["system_ref"], 1_200_000, rank)


@query("j21_site_by_frequency", f"WITH {CALLS}, p AS (SELECT call_id, s_suppkey AS site, row_number() OVER (PARTITION BY call_id ORDER BY s_suppkey) AS n FROM calls JOIN supplier ON abs(duration * 20 - s_acctbal) <= 10) SELECT call_id, site FROM p WHERE n = 1")
def j21(spark, sf):
    c = calls(spark, sf).select("call_id", (F.col("duration") * 20).alias("f")).withColumn("b", F.explode(F.sequence(F.floor(F.col("f") / 10) - 1, F.floor(F.col("f") / 10) + 1)))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("g"), F.floor(F.col("s_acctbal") / 10).alias("b"))
    return c.join(s, "b").where(F.abs(F.col("f") - F.col("g")) <= 10).groupBy("call_id").agg(F.min("site").alias("site"))


@query(
    "j22_boundary_overlap",
    """WITH b AS (SELECT c_custkey AS id, c_mktsegment AS layer, c_acctbal - 50 AS lo, c_acctbal + 50 AS hi FROM customer), m AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) AS n FROM b WHERE hi >= 1000 AND lo <= 3000)
    SELECT id, layer FROM m WHERE n <= 40""",
)
def j22(spark, sf):
    b = table(spark, sf, "customer").where((F.col("c_acctbal") + 50 >= 1000) & (F.col("c_acctbal") - 50 <= 3000)).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer"))
    return b.withColumn("n", F.row_number().over(Window.partitionBy("layer").orderBy("id"))).where("n <= 40").select("id", "layer")


@query("j24_reference_lookup", f"WITH {CALLS} SELECT call_id, n_regionkey::BIGINT AS region_id FROM calls LEFT JOIN nation ON n_nationkey = system_ref * 4")
def j24(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_regionkey").cast("bigint").alias("region_id"))
    return calls(spark, sf).withColumn("key", F.col("system_ref") * 4).join(F.broadcast(n), "key", "left").select("call_id", "region_id")


@query(
    "j25_first_known_patch",
    """WITH u AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS pos FROM lineitem)
    SELECT l_orderkey AS call_id, min_by(l_suppkey, pos) AS talkgroup, CAST(min(pos) - 1 AS BIGINT) AS pos FROM u JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 4000 GROUP BY 1""",
)
def j25(spark, sf):
    patches = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("patches"))
    known = table(spark, sf, "supplier").where("s_acctbal > 4000").select(F.col("s_suppkey").alias("patch"))
    each = patches.select("call_id", F.posexplode("patches").alias("pos", "patch")).join(F.broadcast(known) if known.count() <= 100_000 else known, "patch")
    return each.groupBy("call_id").agg(F.min(F.struct(F.col("pos").cast("bigint").alias("pos"), "patch")).alias("m")).select("call_id", F.col("m.patch").alias("talkgroup"), "m.pos")


@query(
    "j26_keyword_subscribers",
    """WITH l AS (SELECT DISTINCT p_brand AS list, p_name AS word FROM part WHERE p_size < 10), s AS (SELECT c_custkey AS who, 'Brand#' || (1 + c_custkey % 20) AS list FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT p.p_partkey AS call_id, count(DISTINCT who) AS users, string_agg(DISTINCT word, '|' ORDER BY word) AS words FROM part p JOIN l ON p.p_name = l.word JOIN s USING (list) GROUP BY 1""",
)
def j26(spark, sf):
    p = table(spark, sf, "part")
    lists = p.where("p_size < 10").select(F.col("p_brand").alias("list"), F.col("p_name").alias("word")).distinct()
    who = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("who"), F.concat(F.lit("Brand#"), 1 + F.col("c_custkey") % 20).alias("list"))
    users = who.groupBy("list").agg(F.count_distinct("who").alias("users"))  # a subscriber has one list, so those of several lists add up
    by_word = lists.join(users, "list").groupBy("word").agg(F.sum("users").alias("users"))  # a call has one word here
    return p.join(by_word, p.p_name == by_word.word).select(F.col("p_partkey").alias("call_id"), "users", F.col("word").alias("words"))


@query("j27_next_voice_call", f"WITH {CALLS} SELECT a.call_id, (SELECT min_by(b.call_id, b.ts_ms) FROM calls b WHERE b.system_ref = a.system_ref AND b.talkgroup_ref = a.talkgroup_ref AND b.duration >= 60 AND b.ts_ms > a.ts_ms AND b.ts_ms <= a.ts_ms + 7200000) AS next_call FROM calls a")
def j27(spark, sf):
    found = temporal.next_matching(calls(spark, sf), ["system_ref", "talkgroup_ref"], F.col("duration") >= 60, 7_200_000)
    return found.select("call_id", "next_call")


@query("j28_voice_transcript", f"WITH {CALLS} SELECT a.call_id, CASE WHEN duration >= 60 THEN call_id ELSE COALESCE((SELECT min_by(b.call_id, b.ts_ms) FROM calls b WHERE b.system_ref = a.system_ref AND b.talkgroup_ref = a.talkgroup_ref AND b.duration >= 60 AND b.ts_ms > a.ts_ms AND b.ts_ms <= a.ts_ms + 1200000), call_id) END AS voice_call FROM calls a")
def j28(spark, sf):
    found = temporal.next_matching(calls(spark, sf), ["system_ref", "talkgroup_ref"], F.col("duration") >= 60, 1_200_000)
    return found.select("call_id", F.when(F.col("duration") >= 60, F.col("call_id")).otherwise(F.coalesce("next_call", "call_id")).alias("voice_call"))


@query(
    "j29_unknown_references",
    """WITH o AS (SELECT DISTINCT l_suppkey * 2 AS ref FROM lineitem WHERE l_quantity > 45), bad AS (SELECT ref, row_number() OVER (ORDER BY ref) AS n FROM o WHERE ref NOT IN (SELECT s_suppkey FROM supplier)),
    free AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT ref FROM o)) SELECT ref, s_suppkey AS mapped FROM bad LEFT JOIN free USING (n)""",
)
def j29(spark, sf):
    refs = table(spark, sf, "lineitem").where("l_quantity > 45").select((F.col("l_suppkey") * 2).alias("ref")).distinct()
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref"))
    bad = numbered(refs.join(known, "ref", "left_anti"), ["ref"], "n")
    free = numbered(known.join(refs, "ref", "left_anti"), ["ref"], "n").select("n", F.col("ref").alias("mapped"))
    return bad.join(free, "n", "left").select("ref", "mapped")


@query("j30_failed_transcriptions", f"WITH {CALLS}, {SYSTEMS}, {TALKGROUPS} SELECT call_id, system_label, label FROM calls LEFT JOIN systems USING (system_ref) LEFT JOIN talkgroups USING (talkgroup_ref) WHERE k % 10 = 0 ORDER BY ts_ms DESC, call_id DESC LIMIT 100")
def j30(spark, sf):
    newest = calls(spark, sf).where("k % 10 = 0").orderBy(F.desc("ts_ms"), F.desc("call_id")).limit(100)
    return newest.join(F.broadcast(systems(spark, sf)), "system_ref", "left").join(F.broadcast(talkgroups(spark)), "talkgroup_ref", "left").select("call_id", "system_label", "label")


UNITS = "units(place, lo, hi, ref, label) AS (VALUES (1, 10, 19, 500, 'Engine'), (2, 15, 40, 7, 'Medic'), (3, 100, 149, 3, 'Chief'))"


@query("j31_unit_label", f"WITH {CALLS}, {UNITS}, m AS (SELECT call_id, label, row_number() OVER (PARTITION BY call_id ORDER BY place) AS n FROM calls JOIN units ON unit_ref BETWEEN lo AND hi OR unit_ref = ref) SELECT call_id, label FROM m WHERE n = 1")
def j31(spark, sf):
    units = spark.createDataFrame([(1, 10, 19, 500, "Engine"), (2, 15, 40, 7, "Medic"), (3, 100, 149, 3, "Chief")], "place int, lo bigint, hi bigint, ref bigint, label string")
    hit = F.col("unit_ref").between(F.col("lo"), F.col("hi")) | (F.col("unit_ref") == F.col("ref"))
    refs = calls(spark, sf).select("unit_ref").distinct().join(F.broadcast(units), hit).groupBy("unit_ref").agg(F.min_by("label", "place").alias("label"))
    return calls(spark, sf).join(refs, "unit_ref").select("call_id", "label")


# ------------------------------------------------------------------ windows


@query("w01_first_unit", "SELECT l_orderkey AS call_id, l_suppkey AS unit FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def w01(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("unit"))


@query("w02_prior_gap", f"WITH {CALLS} SELECT call_id, ts_ms - lag(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) AS gap_ms FROM calls")
def w02(spark, sf):
    return temporal.with_previous(calls(spark, sf), ["system_ref", "talkgroup_ref"]).select("call_id", (F.col("ts_ms") - F.col("previous.ts_ms")).alias("gap_ms"))


@query("w03_chained_duplicates", f"WITH {CALLS} SELECT call_id, COALESCE(ts_ms - lag(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) <= 600000, FALSE) AS duplicate FROM calls")
def w03(spark, sf):
    return temporal.chained_duplicates(calls(spark, sf), ["system_ref", "talkgroup_ref"], 600_000).select("call_id", "duplicate")


@query(
    "w06_sessions",
    f"""WITH {CALLS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > 3600000 THEN 1 ELSE 0 END AS opens FROM calls WINDOW w AS (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) AS session FROM g)
    SELECT system_ref, talkgroup_ref, CAST(session AS BIGINT) AS session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS calls FROM s GROUP BY 1, 2, 3""",
)
def w06(spark, sf):
    s = temporal.sessions(calls(spark, sf), ["system_ref", "talkgroup_ref"], 3_600_000)
    return s.groupBy("system_ref", "talkgroup_ref", "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("calls"))


COOLDOWN = """WITH RECURSIVE {calls}, o AS (SELECT call_id, ts_ms, {keys} FROM calls WHERE {where}),
 f AS (SELECT {keys}, min(ts_ms) AS ts_ms FROM o GROUP BY {keys} UNION ALL SELECT {fkeys}, (SELECT min(o.ts_ms) FROM o WHERE {match} AND o.ts_ms >= f.ts_ms + {ms}) FROM f WHERE f.ts_ms IS NOT NULL)
 SELECT {okeys}, o.call_id FROM f JOIN o ON {match} AND o.ts_ms = f.ts_ms"""


@query("w07_cooldown", COOLDOWN.format(calls=CALLS, keys="talkgroup_ref", fkeys="f.talkgroup_ref", okeys="o.talkgroup_ref", match="o.talkgroup_ref = f.talkgroup_ref", ms=7_200_000, where="k < 30"))
def w07(spark, sf):
    return temporal.fired(calls(spark, sf).where("k < 30"), ["talkgroup_ref"], 7_200_000)


@query("w08_repeat_suppression", COOLDOWN.format(calls=CALLS, keys="system_ref", fkeys="f.system_ref", okeys="o.system_ref", match="o.system_ref = f.system_ref", ms=14_400_000, where="k % 7 = 0"))
def w08(spark, sf):
    return temporal.fired(calls(spark, sf).where("k % 7 = 0"), ["system_ref"], 14_400_000)


@query(
    "w09_tone_runs",
    f"""WITH {CALLS}, b AS (SELECT *, CASE WHEN abs(duration - lag(duration) OVER w) > least(0.25 * duration, 30) OR k = 0 THEN 1 ELSE 0 END AS opens FROM calls WINDOW w AS (PARTITION BY unit_ref ORDER BY ts_ms, call_id)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY unit_ref ORDER BY ts_ms, call_id) AS run FROM b) SELECT unit_ref, CAST(run AS BIGINT) AS run, count(*) AS frames, round(avg(duration), 5) AS frequency FROM r GROUP BY 1, 2""",
)
def w09(spark, sf):
    w = temporal.arrival_order("unit_ref")
    opens = F.coalesce((F.abs(F.col("duration") - F.lag("duration").over(w)) > F.least(F.col("duration") * 0.25, F.lit(30.0))) | (F.col("k") == 0), F.col("k") == 0).cast("int")
    runs = calls(spark, sf).withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("unit_ref", "run").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("duration"), 5).alias("frequency"))


@query("w11_last_minute_counts", f"WITH {CALLS} SELECT call_id, count(*) OVER (PARTITION BY talkgroup_ref ORDER BY ts_ms // 1000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS calls FROM calls")
def w11(spark, sf):
    """The last 3,600 seconds, in whole seconds."""
    seconds = calls(spark, sf).withColumn("ts_ms", F.expr("ts_ms div 1000 * 1000"))
    return temporal.over_band(seconds, ["talkgroup_ref"], 3_599_000, 0, F.count(F.lit(1)), "calls").select("call_id", "calls")


@query("w13_missed_calls", f"WITH {CALLS}, r AS (SELECT call_id, unit_ref, row_number() OVER (PARTITION BY unit_ref ORDER BY ts_ms DESC, call_id DESC) AS n FROM calls) SELECT call_id, unit_ref FROM r WHERE n <= 5")
def w13(spark, sf):
    w = Window.partitionBy("unit_ref").orderBy(F.desc("ts_ms"), F.desc("call_id"))
    return calls(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 5").select("call_id", "unit_ref")


@query(
    "w14_first_a_then_b",
    f"""WITH {CALLS}, a AS (SELECT unit_ref, min(ts_ms) AS a_ms FROM calls WHERE duration BETWEEN 5 AND 12 GROUP BY 1)
    SELECT a.unit_ref, a_ms, min(ts_ms) AS b_ms FROM a LEFT JOIN calls c ON c.unit_ref = a.unit_ref AND c.duration BETWEEN 15 AND 33 AND c.ts_ms > a_ms GROUP BY 1, 2""",
)
def w14(spark, sf):
    rows = calls(spark, sf).groupBy("unit_ref").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "duration"))).alias("t"))
    firsts = rows.withColumn("a_ms", F.get(F.filter("t", lambda x: x["duration"].between(5, 12)), F.lit(0))["ts_ms"]).where("a_ms is not null")
    return firsts.select("unit_ref", "a_ms", F.get(F.filter("t", lambda x: x["duration"].between(15, 33) & (x["ts_ms"] > F.col("a_ms"))), F.lit(0))["ts_ms"].alias("b_ms"))


@query(
    "w15_closest_b",
    """WITH t AS (SELECT l_orderkey AS call_id, l_linenumber AS n, l_quantity AS start, l_quantity + l_tax * 100 AS stop, l_discount FROM lineitem), a AS (SELECT * FROM t WHERE n = 1), b AS (SELECT * FROM t WHERE n > 1)
    SELECT a.call_id, a.start, round(min(abs(b.start - a.stop)), 6) AS gap FROM a JOIN b ON a.call_id = b.call_id AND b.start - a.stop >= a.start - a.stop AND b.start - a.stop <= 0.5 GROUP BY 1, 2""",
)
def w15(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("stop"))
    tones = t.groupBy("call_id").agg(F.collect_list(F.struct("n", "start", "stop")).alias("t"))
    each = tones.select("call_id", "t", F.explode(F.filter("t", lambda x: x["n"] == 1)).alias("a"))
    gaps = F.transform(F.filter("t", lambda b: (b["n"] > 1) & (b["start"] - F.col("a.stop") >= F.col("a.start") - F.col("a.stop")) & (b["start"] - F.col("a.stop") <= 0.5)), lambda b: F.abs(b["start"] - F.col("a.stop")))
    return each.select("call_id", F.col("a.start").alias("start"), gaps.alias("g")).where(F.size("g") > 0).groupBy("call_id", "start").agg(F.round(F.min(F.array_min("g")), 6).alias("gap"))
