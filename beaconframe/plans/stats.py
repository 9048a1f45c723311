"""Statistics queries (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import stats
from ..operators.numbering import numbered
from ..sources.adapters import CALLS, DAY, HOUR, SYSTEMS, TALKGROUPS, calls, last_moment, systems, table, talkgroups
from .registry import query

NOW = "now AS (SELECT max(ts_ms) AS t FROM calls)"


@query("a01_calls_per_minute", f"WITH {CALLS}, {NOW} SELECT ts_ms // 60000 * 60000 AS bucket_ms, count(*) AS calls FROM calls, now WHERE ts_ms >= t - 86400000 GROUP BY 1")
def a01(spark, sf):
    c = calls(spark, sf)
    return stats.per_minute(c, last_moment(c), minutes=24 * 60)


@query("a02_top_talkgroups", f"WITH {CALLS}, {NOW}, {TALKGROUPS} SELECT talkgroup_ref, COALESCE(NULLIF(label,''), 'TG ' || talkgroup_ref) AS label, count(*) AS calls FROM calls LEFT JOIN talkgroups USING (talkgroup_ref), now WHERE ts_ms >= t - 86400000 GROUP BY 1, 2 ORDER BY calls DESC, talkgroup_ref LIMIT 10")
def a02(spark, sf):
    c = calls(spark, sf)
    return stats.top_channels(c, talkgroups(spark), last_moment(c))


@query("a03_calls_by_hour", f"WITH {CALLS}, {NOW}, n AS (SELECT ts_ms // 3600000 % 24 AS hour, count(*) AS c FROM calls, now WHERE ts_ms >= t - 7 * 86400000 GROUP BY 1) SELECT h AS hour, COALESCE(c, 0) AS calls FROM range(24) r(h) LEFT JOIN n ON h = hour")
def a03(spark, sf):
    c = calls(spark, sf)
    return stats.by_hour_of_day(c, last_moment(c))


@query("a05_counters", f"WITH {CALLS}, {NOW} SELECT count(*) FILTER (ts_ms >= t // 86400000 * 86400000) AS today, count(*) FILTER (ts_ms >= t - 60000) AS last_minute, count(*) FILTER (ts_ms >= t - 3600000) AS last_hour FROM calls, now")
def a05(spark, sf):
    c = calls(spark, sf)
    return stats.counters(c, last_moment(c))


# The test texts are invented words, so each transcript is given one marker by its number.
MARKS = [words[0] for _, _, words in stats.CATEGORIES] + ["nothing", "fire alarm and gas leak", "STRUCTURE FIRE", "domestic dispute with smoke"]
MARK_SQL = "transcripts AS (SELECT doc_id AS call_id, text || ' ' || list_extract([" + ", ".join(f"'{m}'" for m in MARKS) + f"], CAST(doc_id % {len(MARKS)} AS INT) + 1) AS transcript FROM documents)"


def transcripts(spark, sf):
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("doc_id") % len(MARKS)).cast("int") + 1)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), F.concat("text", F.lit(" "), mark).alias("transcript"))


def category_sql(part: int) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{(name, parent)[part]}'" for name, parent, words in stats.CATEGORIES)
    return f"CASE {whens} END"


@query(
    "a06_incident_summary",
    f"""WITH {MARK_SQL}, l AS (SELECT lower(transcript) AS low FROM transcripts), k AS (SELECT {category_sql(1)} AS parent, {category_sql(0)} AS category FROM l),
    c AS (SELECT parent, category, count(*) AS calls FROM k WHERE category IS NOT NULL GROUP BY 1, 2)
    SELECT list_position([{", ".join(f"'{p}'" for p in stats.PARENTS)}], parent)::BIGINT AS place, parent, category, calls, CAST(sum(calls) OVER (PARTITION BY parent) AS BIGINT) AS parent_calls FROM c""",
)
def a06(spark, sf):
    return stats.incident_summary(transcripts(spark, sf))


@query(
    "a04_top_tone_sets",
    f"""WITH {CALLS}, {NOW}, {TALKGROUPS} SELECT 'set' || k % 12 AS tone_set, talkgroup_ref, label, count(*) AS dispatches FROM calls JOIN talkgroups USING (talkgroup_ref), now
    WHERE ts_ms >= t - 7 * 86400000 AND k % 3 = 0 GROUP BY 1, 2, 3 ORDER BY dispatches DESC, tone_set, talkgroup_ref LIMIT 10""",
)
def a04(spark, sf):
    c = calls(spark, sf)
    recent = c.where((F.col("ts_ms") >= last_moment(c) - 7 * DAY) & (F.col("k") % 3 == 0)).withColumn("tone_set", F.concat(F.lit("set"), F.col("k") % 12))
    found = recent.groupBy("tone_set", "talkgroup_ref").agg(F.count(F.lit(1)).alias("dispatches")).join(F.broadcast(talkgroups(spark)), "talkgroup_ref")
    return found.select("tone_set", "talkgroup_ref", "label", "dispatches").orderBy(F.desc("dispatches"), "tone_set", "talkgroup_ref").limit(10)


@query("a07_patch_list", "SELECT l_orderkey AS call_id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey, l_linenumber) AS patches FROM lineitem GROUP BY 1")
def a07(spark, sf):
    refs = F.array_sort(F.collect_list(F.struct("l_suppkey", "l_linenumber")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.array_join(F.transform(refs, lambda r: r["l_suppkey"].cast("string")), ",").alias("patches"))


@query("a08_boundary_marginals", "SELECT c_mktsegment AS layer, CAST(c_nationkey AS BIGINT) AS state, count(*) AS n, CAST(GROUPING(c_mktsegment) * 2 + GROUPING(c_nationkey) AS BIGINT) AS kind FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), (c_nationkey), ())")
def a08(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("layer"), F.col("c_nationkey").cast("bigint").alias("state"))
    return stats.marginals(rows, "layer", "state")


@query("a09_gazetteer_counts", "SELECT n_nationkey::BIGINT AS system_ref, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS places, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS streets FROM nation")
def a09(spark, sf):
    count = lambda t, key: table(spark, sf, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    both = count("customer", "c_nationkey").select("n_nationkey", F.lit("places").alias("what"), "n").unionByName(count("supplier", "s_nationkey").select("n_nationkey", F.lit("streets").alias("what"), "n"))
    pivoted = both.groupBy("n_nationkey").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("places", "streets")])
    return table(spark, sf, "nation").join(F.broadcast(pivoted), "n_nationkey", "left").select(F.col("n_nationkey").cast("bigint").alias("system_ref"), F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("streets", F.lit(0)).alias("streets"))


@query("a10_last_open_alert", f"WITH {CALLS} SELECT talkgroup_ref, max(ts_ms) AS last_ms FROM calls GROUP BY 1")
def a10(spark, sf):
    return calls(spark, sf).groupBy("talkgroup_ref").agg(F.max("ts_ms").alias("last_ms"))


@query("a11_silent_systems", f"WITH {CALLS}, {NOW}, {SYSTEMS}, l AS (SELECT system_ref, max(ts_ms) AS m FROM calls WHERE system_ref <> 5 GROUP BY 1) SELECT system_ref, system_label, (t - COALESCE(m, t - 365 * 86400000::BIGINT)) // 60000 AS silent_minutes FROM systems LEFT JOIN l USING (system_ref), now")
def a11(spark, sf):
    c = calls(spark, sf)
    return stats.last_heard(c.where("system_ref <> 5"), systems(spark, sf), last_moment(c))


@query("a12_failure_monitor", f"WITH {CALLS}, {NOW} SELECT talkgroup_ref, count(*) FILTER (k % 10 = 0) AS failed, count(*) AS calls FROM calls, now WHERE ts_ms >= t - 86400000 GROUP BY 1 HAVING count(*) FILTER (k % 10 = 0) >= 2")
def a12(spark, sf):
    c = calls(spark, sf)
    return c.where(F.col("ts_ms") >= last_moment(c) - DAY).groupBy("talkgroup_ref").agg(F.count_if(F.col("k") % 10 == 0).alias("failed"), F.count(F.lit(1)).alias("calls")).where("failed >= 2")


@query("a13_silent_channels", f"WITH {CALLS} SELECT talkgroup_ref, system_ref, count(*) AS calls, count(*) FILTER (duration > 400) AS tone_calls FROM calls GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (duration > 400) = 0")
def a13(spark, sf):
    return stats.silent_channels(calls(spark, sf), F.col("duration") > 400)


@query("a14_least_id_per_label", "SELECT p_name AS label, min(p_partkey) AS part FROM part GROUP BY 1")
def a14(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("part"))


@query("a15_greatest_ids", "SELECT 'customer' AS name, max(c_custkey) AS id FROM customer UNION ALL SELECT 'orders', max(o_orderkey) FROM orders UNION ALL SELECT 'part', max(p_partkey) FROM part")
def a15(spark, sf):
    one = lambda t, key: table(spark, sf, t).agg(F.max(key).alias("id")).select(F.lit(t).alias("name"), "id")
    return one("customer", "c_custkey").unionByName(one("orders", "o_orderkey")).unionByName(one("part", "p_partkey"))


@query("a16_hash_duplicates", "SELECT lang, sha256(text) AS audio_hash, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def a16(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("audio_hash")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


PHRASES = "phrases AS (SELECT upper(split_part(text, ' ', 1)) AS phrase, quality = 1 AND toxic = 0 AND d.doc_id % 7 = 0 AS accepted, d.doc_id % 5 AS system_ref, d.doc_id * 3600000 AS seen_ms FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
COUNTED = "counted AS (SELECT phrase, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(DISTINCT system_ref) AS systems, min(seen_ms) AS first_ms, max(seen_ms) AS last_ms FROM phrases GROUP BY 1)"


def counted_phrases(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = joined.select(tx.upper_letters(F.split_part("text", F.lit(" "), F.lit(1))).alias("phrase"), ((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("doc_id") % 7 == 0)).alias("accepted"), (F.col("doc_id") % 5).alias("system_ref"), (F.col("doc_id") * HOUR).alias("seen_ms"))
    return rows.groupBy("phrase").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_distinct("system_ref").alias("systems"), F.min("seen_ms").alias("first_ms"), F.max("seen_ms").alias("last_ms"))


@query("a17_phrase_counters", f"WITH {PHRASES}, {COUNTED} SELECT * FROM counted")
def a17(spark, sf):
    return counted_phrases(spark, sf)


def phrase_score(days):
    by_count = F.when(F.col("rejected") >= 10, 5).when(F.col("rejected") >= 5, 3).when(F.col("rejected") >= 3, 1).otherwise(0)
    by_system = F.when(F.col("systems") >= 3, 3).when(F.col("systems") >= 2, 2).otherwise(1)
    by_age = F.when(days >= 7, 2).when(days >= 3, 1).otherwise(0)
    return F.when(F.col("accepted") > 0, 0).otherwise(by_count + by_system + by_age).cast("bigint")


SCORE = """CASE WHEN accepted > 0 THEN 0 ELSE CASE WHEN rejected >= 10 THEN 5 WHEN rejected >= 5 THEN 3 WHEN rejected >= 3 THEN 1 ELSE 0 END
 + CASE WHEN systems >= 3 THEN 3 WHEN systems >= 2 THEN 2 ELSE 1 END + CASE WHEN (last_ms - first_ms) // 86400000 >= 7 THEN 2 WHEN (last_ms - first_ms) // 86400000 >= 3 THEN 1 ELSE 0 END END"""


@query("a18_phrase_confidence", f"WITH {PHRASES}, {COUNTED} SELECT phrase, CAST({SCORE} AS BIGINT) AS score FROM counted")
def a18(spark, sf):
    return counted_phrases(spark, sf).select("phrase", phrase_score(F.expr(f"(last_ms - first_ms) div {DAY}")).alias("score"))


@query("a19_phrases_to_add", f"WITH {PHRASES}, {COUNTED} SELECT phrase, rejected, systems FROM counted WHERE accepted = 0 AND rejected >= 5 AND systems >= 2 AND {SCORE} >= 7")
def a19(spark, sf):
    found = counted_phrases(spark, sf).withColumn("score", phrase_score(F.expr(f"(last_ms - first_ms) div {DAY}")))
    return found.where("accepted = 0 and rejected >= 5 and systems >= 2 and score >= 7").select("phrase", "rejected", "systems")


@query(
    "a20_tone_patterns",
    f"""WITH {CALLS}, s AS (SELECT *, sha256(concat_ws(':', system_ref, talkgroup_ref, 'ab', CAST(round(duration / 20) AS BIGINT), CAST(round(k / 20) AS BIGINT))) AS signature FROM calls)
    SELECT signature, count(DISTINCT unit_ref) AS units, count(*) AS calls, bool_or(k = 99) AS stacked, CASE WHEN count(DISTINCT unit_ref) >= 3 AND NOT bool_or(k = 99) THEN 'qualifies' ELSE 'partial' END AS state FROM s GROUP BY 1""",
)
def a20(spark, sf):
    half = lambda c: F.round(c).cast("bigint").cast("string")
    sig = F.sha2(F.concat_ws(":", F.col("system_ref").cast("string"), F.col("talkgroup_ref").cast("string"), F.lit("ab"), half(F.col("duration") / 20), half(F.col("k") / 20)), 256)
    agg = calls(spark, sf).groupBy(sig.alias("signature")).agg(F.count_distinct("unit_ref").alias("units"), F.count(F.lit(1)).alias("calls"), F.bool_or(F.col("k") == 99).alias("stacked"))
    return agg.withColumn("state", F.when((F.col("units") >= 3) & ~F.col("stacked"), "qualifies").otherwise("partial"))


@query("a21_unit_alias_consensus", "SELECT p_size::BIGINT AS unit, CASE count(DISTINCT upper(trim(p_name))) WHEN 0 THEN 'none' WHEN 1 THEN 'consistent' ELSE 'conflict' END AS state FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def a21(spark, sf):
    n = F.count_distinct(F.upper(F.trim("p_name")))
    return table(spark, sf, "part").where("trim(p_name) <> ''").groupBy(F.col("p_size").cast("bigint").alias("unit")).agg(F.when(n == 0, "none").when(n == 1, "consistent").otherwise("conflict").alias("state"))


@query(
    "a22_merged_keywords",
    """WITH w AS (SELECT p_brand, p_name AS word, p_partkey, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)
    SELECT p_brand AS call_id, string_agg(word, '|' ORDER BY p_partkey) AS keywords FROM w WHERE n = 1 GROUP BY 1""",
)
def a22(spark, sf):
    firsts = table(spark, sf, "part").groupBy("p_brand", F.lower("p_name").alias("folded")).agg(F.min(F.struct("p_partkey", "p_name")).alias("f"))
    return firsts.groupBy(F.col("p_brand").alias("call_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["p_name"]), "|").alias("keywords"))


@query("a23_merged_tone_sets", f"WITH {CALLS} SELECT talkgroup_ref, system_ref, string_agg(DISTINCT 'set' || k % 12, ',' ORDER BY 'set' || k % 12) AS tone_sets FROM calls GROUP BY 1, 2")
def a23(spark, sf):
    return calls(spark, sf).groupBy("talkgroup_ref", "system_ref").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("set"), F.col("k") % 12))), ",").alias("tone_sets"))


@query(
    "a24_users_by_keyword_set",
    f"""WITH {CALLS}, u AS (SELECT unit_ref, string_agg(DISTINCT talkgroup_ref::VARCHAR, ',' ORDER BY talkgroup_ref::VARCHAR) AS words FROM calls WHERE k < 5 GROUP BY 1)
    SELECT words, count(*) AS users, string_agg(unit_ref::VARCHAR, ',' ORDER BY unit_ref) AS who FROM u GROUP BY 1""",
)
def a24(spark, sf):
    sets = calls(spark, sf).where("k < 5").groupBy("unit_ref").agg(F.array_join(F.array_sort(F.collect_set(F.col("talkgroup_ref").cast("string"))), ",").alias("words"))
    return sets.groupBy("words").agg(F.count(F.lit(1)).alias("users"), F.array_join(F.transform(F.array_sort(F.collect_list("unit_ref")), lambda u: u.cast("string")), ",").alias("who"))


@query("a25_alert_groups", f"WITH {CALLS} SELECT CASE WHEN k % 3 = 0 THEN 'set' || k % 12 ELSE 'tg' || talkgroup_ref END AS alert_group, count(DISTINCT call_id) AS calls, max(ts_ms) AS latest_ms FROM calls GROUP BY 1")
def a25(spark, sf):
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("set"), F.col("k") % 12)).otherwise(F.concat(F.lit("tg"), F.col("talkgroup_ref")))
    return calls(spark, sf).groupBy(name.alias("alert_group")).agg(F.count_distinct("call_id").alias("calls"), F.max("ts_ms").alias("latest_ms")).orderBy(F.desc("latest_ms"), "alert_group")


@query("a26_fullest_alert", "SELECT l_orderkey AS call_id, arg_max(l_linenumber, l_quantity * 100 - l_linenumber)::BIGINT AS alert FROM lineitem GROUP BY 1")
def a26(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.max_by("l_linenumber", F.col("l_quantity") * 100 - F.col("l_linenumber")).cast("bigint").alias("alert"))


@query("a27_duplicate_emails", "SELECT lower(trim(p_name)) AS email, count(*) AS users FROM part GROUP BY 1 HAVING count(*) > 1")
def a27(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("email")).agg(F.count(F.lit(1)).alias("users")).where("users > 1")


@query("a28_connections_per_user", f"WITH {CALLS} SELECT unit_ref, count(*) AS connections FROM calls GROUP BY 1")
def a28(spark, sf):
    return calls(spark, sf).groupBy("unit_ref").agg(F.count(F.lit(1)).alias("connections"))


@query("a29_users_per_group", "SELECT c_mktsegment AS user_group, count(*) AS users FROM customer GROUP BY 1")
def a29(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("user_group")).agg(F.count(F.lit(1)).alias("users"))


@query("a30_classification_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def a30(spark, sf):
    return table(spark, sf, "orders").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "filled"), ("O", "skipped"), ("P", "failed"))])


@query("a31_catalogue_count", "SELECT count(*) AS n FROM part WHERE p_type IN ('ECONOMY','SMALL') AND p_size <= 25")
def a31(spark, sf):
    return table(spark, sf, "part").where("p_type in ('ECONOMY','SMALL') and p_size <= 25").agg(F.count(F.lit(1)).alias("n"))


@query("a32_talkgroups_by_category", "SELECT p_type AS category, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1")
def a32(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda p: p.cast("string")), ",").alias("members"))


@query("a33_tone_seconds", "SELECT l_orderkey AS call_id, round(sum(l_quantity), 6) AS seconds FROM lineitem GROUP BY 1")
def a33(spark, sf):
    tones = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.collect_list("l_quantity").alias("d"))
    return tones.select("call_id", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 6).alias("seconds"))


@query("a34_tone_extent", "SELECT l_orderkey AS call_id, round(CASE WHEN max(l_tax) > 0 THEN max(l_tax) ELSE sum(l_discount) END, 6) AS seconds FROM lineitem GROUP BY 1")
def a34(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.round(F.when(F.max("l_tax") > 0, F.max("l_tax")).otherwise(F.sum("l_discount")), 6).alias("seconds"))


@query(
    "a35_running_mean",
    """SELECT l_orderkey AS call_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity)), lambda a, x: (a + x) / 2), 6) AS mean FROM lineitem GROUP BY 1""",
)
def a35(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    return rows.select("call_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: (a + x["l_quantity"]) / 2), 6).alias("mean"))


@query("a36_median", f"WITH {CALLS} SELECT talkgroup_ref, round(median(duration), 6) AS median FROM calls GROUP BY 1")
def a36(spark, sf):
    return calls(spark, sf).groupBy("talkgroup_ref").agg(F.round(F.median("duration"), 6).alias("median"))


@query("a37_next_order", "SELECT s_suppkey AS ref, CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS place FROM supplier")
def a37(spark, sf):
    last = table(spark, sf, "nation").agg(F.max("n_nationkey")).collect()[0][0]
    return numbered(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref")), ["ref"], "n").select("ref", (F.col("n") + last).alias("place"))


@query("a38_geocode_outcomes", f"WITH {CALLS} SELECT CASE WHEN k < 10 THEN 'error' WHEN k < 40 THEN 'miss' ELSE 'hit' END AS outcome, count(*) AS n FROM calls GROUP BY 1")
def a38(spark, sf):
    outcome = F.when(F.col("k") < 10, "error").when(F.col("k") < 40, "miss").otherwise("hit")
    return calls(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("a41_filter_options", "SELECT c_nationkey::BIGINT AS system_ref, min_by(c_name, c_custkey) AS label FROM customer GROUP BY 1")
def a41(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("system_ref")).agg(F.min_by("c_name", "c_custkey").alias("label"))


@query("a42_group_map", f"WITH {CALLS}, {TALKGROUPS} SELECT tag, system_ref, string_agg(DISTINCT talkgroup_ref::VARCHAR, ',' ORDER BY talkgroup_ref::VARCHAR) AS refs FROM calls JOIN talkgroups USING (talkgroup_ref) GROUP BY 1, 2")
def a42(spark, sf):
    joined = calls(spark, sf).join(F.broadcast(talkgroups(spark)), "talkgroup_ref")
    return joined.groupBy("tag", "system_ref").agg(F.array_join(F.array_sort(F.collect_set(F.col("talkgroup_ref").cast("string"))), ",").alias("refs"))


@query("a43_tag_map", f"WITH {CALLS}, {TALKGROUPS} SELECT tag, count(DISTINCT system_ref) AS systems, count(DISTINCT talkgroup_ref) AS channels FROM calls JOIN talkgroups USING (talkgroup_ref) GROUP BY 1")
def a43(spark, sf):
    joined = calls(spark, sf).join(F.broadcast(talkgroups(spark)), "talkgroup_ref").groupBy("tag", "system_ref", "talkgroup_ref").count()
    return joined.groupBy("tag").agg(F.count_distinct("system_ref").alias("systems"), F.count_distinct("talkgroup_ref").alias("channels"))


@query("a44_category_status", f"WITH {CALLS} SELECT system_ref, CASE WHEN bool_and(k > 0) THEN 'On' WHEN bool_or(k > 0) THEN 'Partial' ELSE 'Off' END AS status FROM calls WHERE talkgroup_ref = 1 GROUP BY 1")
def a44(spark, sf):
    on = F.col("k") > 0
    return calls(spark, sf).where("talkgroup_ref = 1").groupBy("system_ref").agg(F.when(F.bool_and(on), "On").when(F.bool_or(on), "Partial").otherwise("Off").alias("status"))


@query("a45_search_bias", "SELECT s_nationkey::BIGINT AS system_ref, greatest(max(s_acctbal), 30) AS radius, min_by(s_name, s_suppkey) AS city FROM supplier WHERE s_acctbal <> 0 GROUP BY 1")
def a45(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal <> 0").groupBy(F.col("s_nationkey").cast("bigint").alias("system_ref")).agg(F.greatest(F.max("s_acctbal"), F.lit(30.0)).alias("radius"), F.min_by("s_name", "s_suppkey").alias("city"))


@query("a46_first_period_per_day", f"WITH {CALLS}, r AS (SELECT ts_ms // 86400000 AS day, call_id, ts_ms, row_number() OVER (PARTITION BY ts_ms // 86400000 ORDER BY ts_ms, call_id) AS n FROM calls) SELECT day, call_id, ts_ms FROM r WHERE n = 1 ORDER BY day LIMIT 3")
def a46(spark, sf):
    firsts = calls(spark, sf).groupBy(F.expr(f"ts_ms div {DAY}").alias("day")).agg(F.min(F.struct("ts_ms", "call_id")).alias("f"))
    return firsts.select("day", "f.call_id", "f.ts_ms").orderBy("day").limit(3)


@query("a47_queue_position", f"WITH {CALLS} SELECT call_id, talkgroup_ref, row_number() OVER (PARTITION BY talkgroup_ref ORDER BY ts_ms DESC, call_id DESC) AS place FROM calls WHERE k = 1")
def a47(spark, sf):
    w = Window.partitionBy("talkgroup_ref").orderBy(F.desc("ts_ms"), F.desc("call_id"))
    return calls(spark, sf).where("k = 1").select("call_id", "talkgroup_ref", F.row_number().over(w).cast("bigint").alias("place"))
