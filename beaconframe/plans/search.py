"""Predicates (P), ordering and paging (O), and channel settings (N07-N10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search
from ..sources.adapters import CALLS, DAY, MINUTE, SYSTEMS, TALKGROUPS, calls, epoch_ms, last_moment, systems, table, talkgroups
from .registry import query

NOW = "now AS (SELECT max(ts_ms) AS t FROM calls)"
COLUMNS = "call_id, ts_ms, system_ref, talkgroup_ref"


def some(frame):
    return frame.select("call_id", "ts_ms", "system_ref", "talkgroup_ref")


@query("p01_call_validity", f"WITH {CALLS} SELECT call_id, CASE WHEN talkgroup_ref < 2 THEN 'no talkgroup' WHEN system_ref < 1 THEN 'no system' WHEN k = 7 THEN 'no timestamp' WHEN duration <= 44 THEN 'no audio' END AS reason FROM calls")
def p01(spark, sf):
    c = calls(spark, sf)
    reason = search.invalid_reason(F.col("duration"), F.when(F.col("k") == 7, 0).otherwise(F.col("ts_ms")), F.col("system_ref"), F.col("talkgroup_ref") - 1)
    return c.select("call_id", reason.alias("reason"))


@query("p02_search_base", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE system_ref > 0 AND talkgroup_ref > 0 AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.call_id = calls.call_id AND d.k = 13)")
def p02(spark, sf):
    c = calls(spark, sf)
    return some(search.searchable(c, c.where("k = 13").select("call_id")))


@query("p03_search_channel", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE system_ref = 3 AND talkgroup_ref = 2")
def p03(spark, sf):
    return some(search.by_channel(calls(spark, sf), 3, 2))


@query("p03_search_talkgroup_without_system", f"WITH {CALLS} SELECT {COLUMNS} FROM calls")
def p03b(spark, sf):
    return some(search.by_channel(calls(spark, sf), None, 2))


@query("p04_search_group", f"WITH {CALLS}, {TALKGROUPS} SELECT {COLUMNS} FROM calls WHERE (system_ref, talkgroup_ref) IN (SELECT DISTINCT system_ref, talkgroup_ref FROM systems_x, talkgroups WHERE tag = 'ops')".replace("SELECT call_id", ", systems_x AS (SELECT DISTINCT system_ref FROM calls WHERE system_ref < 4) SELECT call_id", 1).replace(f"{TALKGROUPS} ,", f"{TALKGROUPS},"))
def p04(spark, sf):
    c = calls(spark, sf)
    members = c.where("system_ref < 4").select("system_ref").distinct().join(F.broadcast(talkgroups(spark).where("tag = 'ops'").select("talkgroup_ref")), how="cross")
    return some(search.by_group(c, members))


@query("p04_search_empty_group", f"WITH {CALLS} SELECT {COLUMNS} FROM calls")
def p04b(spark, sf):
    c = calls(spark, sf)
    return some(search.by_group(c, c.where("false")))


@query("p05_search_from_date", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE ts_ms >= 1704500000000")
def p05(spark, sf):
    c = calls(spark, sf)
    return some(search.since(c, 0, 1_704_500_000_000))


@query("p06_search_last_day", f"WITH {CALLS}, {NOW} SELECT {COLUMNS} FROM calls, now WHERE ts_ms >= t - 86400000")
def p06(spark, sf):
    c = calls(spark, sf)
    return some(search.since(c, last_moment(c)))


@query("p07_search_delay", f"WITH {CALLS}, {NOW} SELECT {COLUMNS} FROM calls, now WHERE ts_ms <= t - 2 * 60000")
def p07(spark, sf):
    c = calls(spark, sf)
    delay = search.delay_minutes(30, {1: 0, 2: 9}, {2: 5, 4: 2})
    return some(c.where(F.col("ts_ms") <= last_moment(c) - delay * MINUTE))


@query("p08_plausible_years", f"WITH {CALLS} SELECT call_id FROM calls WHERE ts_ms * (k + 1) < 253402300800000 AND ts_ms * (k + 1) >= -62135596800000")
def p08(spark, sf):
    ms = F.col("ts_ms") * (F.col("k") + 1)
    return calls(spark, sf).where(ms.between(-62_135_596_800_000, 253_402_300_799_999)).select("call_id")


@query("p09_unset_is_absent", f"WITH {CALLS} SELECT call_id, CASE WHEN k > 0 THEN k END AS frequency, CASE WHEN system_ref > 0 THEN system_ref END AS site FROM calls")
def p09(spark, sf):
    return calls(spark, sf).select("call_id", F.when(F.col("k") > 0, F.col("k")).alias("frequency"), F.when(F.col("system_ref") > 0, F.col("system_ref")).alias("site"))


@query("p10_transcript_search", "SELECT doc_id AS call_id FROM documents WHERE text ILIKE '%th_nd%'")
def p10(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").ilike("%th_nd%")).select(F.col("doc_id").alias("call_id"))


@query("p11_log_search", "SELECT doc_id AS log_id FROM documents WHERE contains(lower(text), lower('THE%'))")
def p11(spark, sf):
    return table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lower(F.lit("THE%")))).select(F.col("doc_id").alias("log_id"))


@query("p12_log_filters", f"WITH {CALLS} SELECT call_id AS log_id FROM calls WHERE talkgroup_ref = 2 AND system_ref IN (1, 2, 5) AND ts_ms > 0 AND ts_ms < 253402300800000")
def p12(spark, sf):
    return calls(spark, sf).where("talkgroup_ref = 2 and system_ref in (1, 2, 5) and ts_ms > 0 and ts_ms < 253402300800000").select(F.col("call_id").alias("log_id"))


@query("p13_transcript_filters", "SELECT o_orderkey AS call_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
def p13(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderdate >= date'1996-01-01' and o_orderdate < date'1997-01-01'").select(F.col("o_orderkey").alias("call_id"))


@query("p14_incident_pins", "SELECT s_suppkey AS call_id FROM supplier WHERE s_acctbal <> 0 AND s_nationkey NOT IN (0, 1, 2)")
def p14(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal <> 0 and s_nationkey not in (0, 1, 2)").select(F.col("s_suppkey").alias("call_id"))


@query("p15_blacklist", f"WITH {CALLS} SELECT call_id, list_contains(string_split('2,4', ','), talkgroup_ref::VARCHAR) AS blacklisted FROM calls")
def p15(spark, sf):
    return calls(spark, sf).select("call_id", F.array_contains(F.split(F.lit("2,4"), ","), F.col("talkgroup_ref").cast("string")).alias("blacklisted"))


LISTS = [("all", "*"), ("none", "[]"), ("empty", ""), ("some", '[{"id":1,"talkgroups":[2,4]},{"id":3,"talkgroups":"*"},{"id":5}]')]


def rights(spark):
    return search.rights_table(spark.createDataFrame(LISTS, "principal string, systems string"))


SOME = "(system_ref = 1 AND talkgroup_ref IN (2, 4)) OR system_ref IN (3, 5)"
for _name, _who, _where in (("p16_access_code", "some", SOME), ("p17_api_key", "all", "TRUE"), ("p18_downstream", "none", "FALSE"), ("p21_user_access", "empty", "TRUE")):

    @query(f"{_name}_rights", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE {_where}")
    def acl(spark, sf, who=_who):
        return some(search.permitted(calls(spark, sf), rights(spark), who))


@query("p19_system_access", f"WITH {CALLS} SELECT DISTINCT system_ref FROM calls WHERE system_ref IN (1, 3, 5)")
def p19(spark, sf):
    own = rights(spark).where("principal = 'some'").select("system_ref").distinct()
    return calls(spark, sf).select("system_ref").distinct().join(F.broadcast(own), "system_ref", "left_semi")


@query("p20_talkgroup_access", f"WITH {CALLS} SELECT DISTINCT system_ref, talkgroup_ref FROM calls WHERE {SOME}")
def p20(spark, sf):
    return search.permitted(calls(spark, sf).select("system_ref", "talkgroup_ref").distinct(), rights(spark), "some")


@query("p22_effective_access", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE {SOME}")
def p22(spark, sf):
    return some(search.permitted(search.permitted(calls(spark, sf), rights(spark), "all"), rights(spark), "some"))


@query(
    "p23_live_feed",
    f"WITH {CALLS} SELECT DISTINCT call_id FROM calls WHERE (system_ref, talkgroup_ref) IN (SELECT * FROM (VALUES (1, 2), (2, 3))) OR (system_ref, (talkgroup_ref % 5) + 1) IN (SELECT * FROM (VALUES (1, 2), (2, 3)))",
)
def p23(spark, sf):
    on = spark.createDataFrame([(1, 2), (2, 3)], "system_ref bigint, talkgroup_ref bigint")
    both = calls(spark, sf).select("call_id", "system_ref", F.explode(F.array("talkgroup_ref", F.col("talkgroup_ref") % 5 + 1)).alias("talkgroup_ref"))
    return both.join(F.broadcast(on), ["system_ref", "talkgroup_ref"], "left_semi").select("call_id").distinct()


@query("p24_all_off", f"WITH {CALLS} SELECT system_ref, NOT bool_or(k > 98) AS all_off FROM calls GROUP BY 1")
def p24(spark, sf):
    return calls(spark, sf).groupBy("system_ref").agg((~F.bool_or(F.col("k") > 98)).alias("all_off"))


@query("p25_alerts_enabled", f"WITH {CALLS}, {TALKGROUPS} SELECT call_id, COALESCE(alerts, TRUE) AS enabled FROM calls LEFT JOIN talkgroups USING (talkgroup_ref)")
def p25(spark, sf):
    return calls(spark, sf).join(F.broadcast(talkgroups(spark)), "talkgroup_ref", "left").select("call_id", F.coalesce("alerts", F.lit(True)).alias("enabled"))


@query("p26_tone_set_filter", f"WITH {CALLS} SELECT call_id, k % 4 = 0 OR list_has_any([k % 12, k % 5], [k % 4, 7]) AS matches FROM calls")
def p26(spark, sf):
    k = F.col("k")
    wanted = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 4, F.lit(7).cast("bigint")))
    return calls(spark, sf).select("call_id", ((F.size(wanted) == 0) | F.arrays_overlap(F.array(k % 12, k % 5), wanted)).alias("matches"))


@query("p27_unreviewed_nature", "SELECT p_partkey AS call_id, CAST(CASE WHEN p_type ILIKE '%ECONOMY%' THEN 0 ELSE 1 END AS BIGINT) AS place FROM part WHERE p_name <> '' AND p_size > 10 AND (p_type = '' OR p_type ILIKE '%o%')")
def p27(spark, sf):
    rows = table(spark, sf, "part").where((F.col("p_name") != "") & (F.col("p_size") > 10) & ((F.col("p_type") == "") | F.col("p_type").ilike("%o%")))
    place = F.when(F.col("p_type").ilike("%ECONOMY%"), 0).otherwise(1).cast("bigint")
    return rows.select(F.col("p_partkey").alias("call_id"), place.alias("place")).orderBy("place", "call_id")


@query("p28_catalogue_filter", "SELECT p_partkey AS ref FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#4' AND p_size < 40")
def p28(spark, sf):
    return table(spark, sf, "part").where("p_type = 'ECONOMY' and p_brand = 'Brand#4' and p_size < 40").select(F.col("p_partkey").alias("ref"))


@query("p29_transcription_decision", f"WITH {CALLS} SELECT call_id, CASE WHEN k > 50 AND duration - k < 2 THEN 'tone_only_remaining' WHEN talkgroup_ref = 2 THEN 'bypass' WHEN duration < 10 THEN 'duration_below_minimum' ELSE '' END AS reason FROM calls")
def p29(spark, sf):
    reason = F.when((F.col("k") > 50) & (F.col("duration") - F.col("k") < 2), "tone_only_remaining").when(F.col("talkgroup_ref") == 2, "bypass").when(F.col("duration") < 10, "duration_below_minimum").otherwise("")
    return calls(spark, sf).select("call_id", reason.alias("reason"))


VISIBLE = ("manual", "no_audio", "no_audio_received", "api_key_no_audio", "tone_detection_issue")


@query("p30_alert_visibility", f"WITH {CALLS} SELECT call_id, system_ref = 0 OR list_extract(['manual','no_audio','other','service','tone_detection_issue'], talkgroup_ref::INT) IN {VISIBLE} AS visible FROM calls")
def p30(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("manual", "no_audio", "other", "service", "tone_detection_issue")]), F.col("talkgroup_ref").cast("int"))
    return calls(spark, sf).select("call_id", ((F.col("system_ref") == 0) | kind.isin(*VISIBLE)).alias("visible"))


@query("p31_alert_search", "SELECT p_partkey AS alert FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2')")
def p31(spark, sf):
    return table(spark, sf, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ring brand#2"))).select(F.col("p_partkey").alias("alert"))


@query("p32_retention", f"WITH {CALLS}, {NOW}, {TALKGROUPS} SELECT call_id FROM calls JOIN talkgroups USING (talkgroup_ref), now WHERE NOT (COALESCE(NULLIF(keep_days, 0), NULLIF(system_ref % 3 * 4, 0), 0) > 0 AND ts_ms < t - COALESCE(NULLIF(keep_days, 0), NULLIF(system_ref % 3 * 4, 0), 0) * 86400000)")
def p32(spark, sf):
    c = calls(spark, sf)
    gone = search.is_expired(F.col("ts_ms"), last_moment(c), F.col("keep_days"), F.col("system_ref") % 3 * 4)
    return c.join(F.broadcast(talkgroups(spark)), "talkgroup_ref").where(~gone).select("call_id")


@query("p33_visible_channels", f"WITH {CALLS}, {TALKGROUPS} SELECT DISTINCT system_ref, talkgroup_ref, label FROM calls JOIN talkgroups USING (talkgroup_ref) WHERE {SOME}")
def p33(spark, sf):
    channels = calls(spark, sf).select("system_ref", "talkgroup_ref").distinct()
    return search.permitted(channels, rights(spark), "some").join(F.broadcast(talkgroups(spark)), "talkgroup_ref").select("system_ref", "talkgroup_ref", "label").orderBy("system_ref", "talkgroup_ref")


@query("p34_tone_only", f"WITH {CALLS} SELECT call_id, duration < 3 OR k = 0 OR (k = 1 AND duration < 20) AS tone_only FROM calls")
def p34(spark, sf):
    return calls(spark, sf).select("call_id", ((F.col("duration") < 3) | (F.col("k") == 0) | ((F.col("k") == 1) & (F.col("duration") < 20))).alias("tone_only"))


@query("p35_has_voice", f"WITH {CALLS} SELECT call_id, CASE WHEN k > 20 THEN k % 2 = 0 ELSE duration >= 5 END AS voice FROM calls")
def p35(spark, sf):
    return calls(spark, sf).select("call_id", F.when(F.col("k") > 20, F.col("k") % 2 == 0).otherwise(F.col("duration") >= 5).alias("voice"))


@query("p36_viewport", "SELECT c_custkey AS pin FROM customer WHERE c_acctbal BETWEEN 0 - 500 AND 5000 + 500 AND c_nationkey BETWEEN 3 AND 12")
def p36(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_acctbal").between(-500, 5500) & F.col("c_nationkey").between(3, 12)).select(F.col("c_custkey").alias("pin"))


@query("p37_severe_only", "SELECT o_orderkey AS feature FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def p37(spark, sf):
    return table(spark, sf, "orders").where(F.lower("o_orderpriority").isin("1-urgent", "2-high")).select(F.col("o_orderkey").alias("feature"))


@query("p38_valid_codes", f"WITH {CALLS}, {NOW} SELECT call_id AS code FROM calls, now WHERE talkgroup_ref = 1 AND (k = 0 OR ts_ms // 1000 > t // 1000 - 86400) AND (system_ref = 0 OR k < 50)")
def p38(spark, sf):
    c = calls(spark, sf)
    now = last_moment(c) // 1000
    return c.where((F.col("talkgroup_ref") == 1) & ((F.col("k") == 0) | (F.expr("ts_ms div 1000") > now - 86400)) & ((F.col("system_ref") == 0) | (F.col("k") < 50))).select(F.col("call_id").alias("code"))


@query("p39_backfill_change", "SELECT p_partkey AS call_id, CASE WHEN p_type = 'SMALL' THEN p_name <> '' WHEN p_type ILIKE '%UNK%' THEN FALSE ELSE p_type <> p_name END AS allowed FROM part")
def p39(spark, sf):
    allowed = F.when(F.col("p_type") == "SMALL", F.col("p_name") != "").when(F.col("p_type").ilike("%UNK%"), F.lit(False)).otherwise(F.col("p_type") != F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("call_id"), allowed.alias("allowed"))


@query("o01_search_page", f"WITH {CALLS} SELECT {COLUMNS}, row_number() OVER (ORDER BY ts_ms DESC, call_id DESC) AS place, TRUE AS has_more FROM (SELECT * FROM calls ORDER BY ts_ms DESC, call_id DESC LIMIT 200 OFFSET 40)")
def o01(spark, sf):
    found = search.page(calls(spark, sf), 200, 40)
    return found.select("call_id", "ts_ms", "system_ref", "talkgroup_ref", F.col("place").cast("bigint").alias("place"), "has_more")


@query("o02_visible_page", f"WITH {CALLS} SELECT {COLUMNS} FROM calls WHERE {SOME} ORDER BY ts_ms DESC, call_id DESC LIMIT 100 OFFSET 10")
def o02(spark, sf):
    return some(search.page(search.permitted(calls(spark, sf), rights(spark), "some"), 100, 10))


@query("o03_transcript_page", "SELECT doc_id AS call_id, left(text, 40) AS head FROM documents WHERE lang = 'fr' ORDER BY doc_id DESC LIMIT 50")
def o03(spark, sf):
    return table(spark, sf, "documents").where("lang = 'fr'").orderBy(F.desc("doc_id")).limit(50).select(F.col("doc_id").alias("call_id"), F.left("text", F.lit(40)).alias("head"))


@query("o04_log_page", f"WITH {CALLS} SELECT call_id AS log_id, CAST(20 + 101 AS BIGINT) AS total FROM (SELECT * FROM calls ORDER BY ts_ms DESC, call_id DESC LIMIT 100 OFFSET 20)")
def o04(spark, sf):
    found = search.page(calls(spark, sf), 100, 20)
    count = F.max("place").over(Window.partitionBy()) + F.when(F.col("has_more"), 1).otherwise(0) + 20
    return found.select(F.col("call_id").alias("log_id"), count.cast("bigint").alias("total"))


@query("o05_newest_alerts", f"WITH {CALLS} SELECT call_id, ts_ms FROM calls ORDER BY ts_ms DESC, call_id DESC LIMIT 1000")
def o05(spark, sf):
    return calls(spark, sf).orderBy(F.desc("ts_ms"), F.desc("call_id")).limit(1000).select("call_id", "ts_ms")


@query("o06_incidents_limit_first", f"WITH {CALLS} SELECT {COLUMNS} FROM (SELECT * FROM calls ORDER BY ts_ms DESC, call_id DESC LIMIT 300) WHERE {SOME}")
def o06(spark, sf):
    newest = calls(spark, sf).orderBy(F.desc("ts_ms"), F.desc("call_id")).limit(300)
    return some(search.permitted(newest, rights(spark), "some"))


@query("o07_pending_phrases", "SELECT p_name AS phrase, count(*) AS rejected, max(p_partkey) AS last_seen FROM part GROUP BY 1 ORDER BY rejected DESC, last_seen DESC LIMIT 20")
def o07(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.count(F.lit(1)).alias("rejected"), F.max("p_partkey").alias("last_seen")).orderBy(F.desc("rejected"), F.desc("last_seen")).limit(20)


@query("o08_backlog", f"WITH {CALLS}, {NOW} SELECT call_id, ts_ms FROM calls, now WHERE ts_ms >= t - 3 * 86400000 ORDER BY ts_ms, call_id LIMIT 1000")
def o08(spark, sf):
    c = calls(spark, sf)
    return c.where(F.col("ts_ms") >= last_moment(c) - 3 * DAY).orderBy("ts_ms", "call_id").limit(1000).select("call_id", "ts_ms")


@query("o09_custom_order", "SELECT p_partkey AS call_id FROM part ORDER BY CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END, p_partkey DESC LIMIT 25")
def o09(spark, sf):
    return table(spark, sf, "part").orderBy(F.when(F.col("p_type") == "SMALL", 0).otherwise(1), F.desc("p_partkey")).limit(25).select(F.col("p_partkey").alias("call_id"))


@query("o10_debug_listing", f"WITH {CALLS} SELECT {COLUMNS} FROM calls ORDER BY call_id DESC LIMIT 30")
def o10(spark, sf):
    return some(calls(spark, sf)).orderBy(F.desc("call_id")).limit(30)


@query("o11_newest_system_alerts", f"WITH {CALLS} SELECT call_id, ts_ms FROM calls WHERE k <> 3 ORDER BY ts_ms DESC, call_id DESC LIMIT 60")
def o11(spark, sf):
    return calls(spark, sf).where("k <> 3").orderBy(F.desc("ts_ms"), F.desc("call_id")).limit(60).select("call_id", "ts_ms")


@query("o12_review_queue", "SELECT doc_id AS call_id FROM documents WHERE n_chars > 500 ORDER BY doc_id DESC LIMIT 40 OFFSET 20")
def o12(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 500").orderBy(F.desc("doc_id")).offset(20).limit(40).select(F.col("doc_id").alias("call_id"))


@query("o13_dimension_order", f"WITH {SYSTEMS} SELECT system_ref, system_label, row_number() OVER (ORDER BY region, system_label) AS place FROM systems")
def o13(spark, sf):
    return systems(spark, sf).select("system_ref", "system_label", F.row_number().over(Window.orderBy("region", "system_label")).cast("bigint").alias("place"))


@query("o14_evidence_order", "SELECT l_orderkey AS call_id, l_partkey AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def o14(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("label"), F.row_number().over(w).cast("bigint").alias("place"))


@query("o15_catalogue_page", "SELECT p_partkey AS ref, p_name AS label FROM part WHERE p_size > 20 ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def o15(spark, sf):
    return table(spark, sf, "part").where("p_size > 20").orderBy("p_name", "p_partkey").offset(100).limit(50).select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("label"))


SETTINGS = "COALESCE(NULLIF(talkgroup_ref % 3, 0), NULLIF(system_ref % 4, 0), 7)"


@query("n07_effective_delay", f"WITH {CALLS} SELECT call_id, CASE WHEN unit_ref % 2 = 0 AND {SETTINGS} > 0 THEN {SETTINGS} ELSE COALESCE(NULLIF(k % 6, 0), 0) END AS delay FROM calls")
def n07(spark, sf):
    group = search.effective_delay(F.col("talkgroup_ref") % 3, F.col("system_ref") % 4, F.lit(7))
    user = search.effective_delay(F.col("k") % 6)
    return calls(spark, sf).select("call_id", F.when((F.col("unit_ref") % 2 == 0) & (group > 0), group).otherwise(user).cast("bigint").alias("delay"))


@query("n08_group_delay", f"WITH {CALLS} SELECT call_id, {SETTINGS} AS delay FROM calls")
def n08(spark, sf):
    return calls(spark, sf).select("call_id", search.effective_delay(F.col("talkgroup_ref") % 3, F.col("system_ref") % 4, F.lit(7)).cast("bigint").alias("delay"))


@query("n09_user_delay", f"WITH {CALLS} SELECT call_id, COALESCE(CASE WHEN system_ref = 1 AND talkgroup_ref = 2 THEN 4 END, CASE system_ref WHEN 1 THEN 3 WHEN 5 THEN 8 END, NULLIF(unit_ref % 3, 0), 0) AS delay FROM calls")
def n09(spark, sf):
    by_channel = F.from_json(F.lit('{"1:2":4,"2:2":0}'), "map<string,int>")
    by_system = F.from_json(F.lit('{"1":3,"5":8}'), "map<string,int>")
    delay = search.effective_delay(F.try_element_at(by_channel, F.concat_ws(":", F.col("system_ref").cast("string"), F.col("talkgroup_ref").cast("string"))), F.try_element_at(by_system, F.col("system_ref").cast("string")), F.col("unit_ref") % 3)
    return calls(spark, sf).select("call_id", delay.cast("bigint").alias("delay"))


@query("n10_call_delay", f"WITH {CALLS}, {TALKGROUPS} SELECT call_id, COALESCE(NULLIF(delay_min, 0), NULLIF(system_ref % 4, 0), 1) AS delay FROM calls JOIN talkgroups USING (talkgroup_ref)")
def n10(spark, sf):
    joined = calls(spark, sf).join(F.broadcast(talkgroups(spark)), "talkgroup_ref")
    return joined.select("call_id", search.effective_delay(F.col("delay_min"), F.col("system_ref") % 4, F.lit(1)).cast("bigint").alias("delay"))


@query("t12_released_calls", f"WITH {CALLS}, {NOW}, {TALKGROUPS} SELECT call_id FROM calls JOIN talkgroups USING (talkgroup_ref), now WHERE ts_ms + delay_min * 60000 <= t")
def t12(spark, sf):
    c = calls(spark, sf)
    return search.released(c.join(F.broadcast(talkgroups(spark)), "talkgroup_ref"), last_moment(c), F.col("delay_min")).select("call_id")


@query("m04_order_days", "SELECT o_orderkey AS call_id, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS ts_ms, hour(o_orderdate::TIMESTAMP)::BIGINT AS hour FROM orders")
def m04(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), epoch_ms("o_orderdate").alias("ts_ms"), F.hour("o_orderdate").cast("bigint").alias("hour"))
