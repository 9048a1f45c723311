"""Set-like operators (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upserts
from ..sources.adapters import CALLS, DAY, calls, last_moment, table
from .registry import query

NOW = "now AS (SELECT max(ts_ms) AS t FROM calls)"
SCOPES = "w AS (SELECT p_partkey AS place, p_name AS name, p_brand AS value FROM part WHERE p_size <= 25), n AS (SELECT p_partkey AS place, upper(p_name) AS name, p_type AS value FROM part WHERE p_size > 25 AND p_name LIKE '%i%')"


def scopes(spark, sf):
    p = table(spark, sf, "part")
    wide = p.where("p_size <= 25").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_brand").alias("value"))
    narrow = p.where("p_size > 25 and p_name like '%i%'").select(F.col("p_partkey").alias("place"), F.upper("p_name").alias("name"), F.col("p_type").alias("value"))
    return wide, narrow


@query("u01_scoped_first_wins", f"WITH {SCOPES}, b AS (SELECT 0 AS s, * FROM w UNION ALL SELECT 1, * FROM n), r AS (SELECT name, value, row_number() OVER (PARTITION BY upper(trim(name)) ORDER BY s, place) AS k FROM b) SELECT name, value FROM r WHERE k = 1")
def u01(spark, sf):
    return upserts.scoped(*scopes(spark, sf), F.upper(F.trim("name")), False, "name", "value")


@query("u02_scoped_override", f"WITH {SCOPES}, b AS (SELECT 0 AS s, * FROM w UNION ALL SELECT 1, * FROM n), r AS (SELECT name, value, row_number() OVER (PARTITION BY upper(name) ORDER BY s DESC, place) AS k FROM b) SELECT name, value FROM r WHERE k = 1")
def u02(spark, sf):
    return upserts.scoped(*scopes(spark, sf), F.upper("name"), True, "name", "value").orderBy("name")


@query("u03_scoped_places", f"WITH {SCOPES}, b AS (SELECT 0 AS s, * FROM w UNION ALL SELECT 1, * FROM n), r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY s DESC, place) AS k FROM b) SELECT name, value FROM r WHERE k = 1")
def u03(spark, sf):
    return upserts.scoped(*scopes(spark, sf), F.col("name"), True, "name", "value")


@query("u04_limited_layers", "(SELECT 'county' AS layer, c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 50) UNION ALL (SELECT 'place', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 25)")
def u04(spark, sf):
    a = table(spark, sf, "customer").orderBy("c_custkey").limit(50).select(F.lit("county").alias("layer"), F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, sf, "supplier").orderBy("s_suppkey").limit(25).select(F.lit("place").alias("layer"), F.col("s_suppkey").alias("id")))


@query("u05_distinct_lists", "SELECT DISTINCT props FROM events")
def u05(spark, sf):
    return table(spark, sf, "events").select("props").distinct()


@query("u06_normalised_emails", "SELECT lower(trim(p_name)) AS email, min(p_partkey) AS first_id FROM part GROUP BY 1")
def u06(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("email")).agg(F.min("p_partkey").alias("first_id"))


@query("u07_merged_units", "SELECT s_suppkey AS ref, s_name AS label FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u07(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_name").alias("label"))
    return upserts.insert_ignore(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("label")), ["ref"])


@query("u08_insert_ignore", "SELECT n_nationkey::BIGINT AS ref FROM nation UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def u08(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("ref"))
    return upserts.insert_ignore(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref")), ["ref"])


@query(
    "u09_upsert_hits",
    f"WITH {CALLS}, b AS (SELECT s_suppkey AS key, s_name AS value, 1::BIGINT AS hits, 0::BIGINT AS used FROM supplier UNION ALL SELECT unit_ref, call_id::VARCHAR, 1, ts_ms * 100000 + call_id FROM calls) SELECT key, arg_max(value, used) AS value, CAST(sum(hits) AS BIGINT) AS hits, max(used) AS used FROM b GROUP BY 1",
)
def u09(spark, sf):
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"), F.lit(1).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("used"))
    hits = calls(spark, sf).select(F.col("unit_ref").alias("key"), F.col("call_id").cast("string").alias("value"), (F.col("ts_ms") * 100_000 + F.col("call_id")).alias("used"))
    return upserts.upsert_hits(old, hits, "key")


@query("u10_upsert_misses", f"WITH {CALLS} SELECT unit_ref AS key, talkgroup_ref AS provider, count(*) AS misses, max(ts_ms) AS used FROM calls GROUP BY 1, 2")
def u10(spark, sf):
    return calls(spark, sf).groupBy(F.col("unit_ref").alias("key"), F.col("talkgroup_ref").alias("provider")).agg(F.count(F.lit(1)).alias("misses"), F.max("ts_ms").alias("used"))


@query("u11_replace_by_scope", f"WITH {CALLS} SELECT system_ref, COALESCE(NULLIF(talkgroup_ref, 1), 0) AS scope, arg_max(call_id, ts_ms * 100000 + call_id) AS call_id FROM calls GROUP BY 1, 2")
def u11(spark, sf):
    scope = F.coalesce(F.nullif("talkgroup_ref", F.lit(1)), F.lit(0))
    return calls(spark, sf).groupBy("system_ref", scope.cast("bigint").alias("scope")).agg(F.max(F.struct("ts_ms", "call_id"))["call_id"].alias("call_id"))


@query(
    "u12_sync_actions",
    """WITH a AS (SELECT s_suppkey AS ref, s_nationkey AS v FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey AS ref, CASE WHEN s_suppkey % 5 = 0 THEN 99 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 4 <> 0)
    SELECT COALESCE(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'insert' WHEN b.ref IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.ref = b.ref WHERE a.ref IS NULL OR b.ref IS NULL OR a.v <> b.v""",
)
def u12(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("v"))
    wanted = s.where("ref % 4 <> 0").withColumn("v", F.when(F.col("ref") % 5 == 0, 99).otherwise(F.col("v")))
    return upserts.sync_actions(s.where("ref % 3 <> 0"), wanted, ["ref"], ["v"])


@query("u13_patch_union", f"WITH {CALLS} SELECT call_id, array_to_string(list_distinct([talkgroup_ref]), ',') || CASE WHEN k % 5 + 1 <> talkgroup_ref THEN ',' || (k % 5 + 1) ELSE '' END AS patches FROM calls")
def u13(spark, sf):
    both = F.array_union(F.array("talkgroup_ref"), F.array(F.col("k") % 5 + 1))
    return calls(spark, sf).select("call_id", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("patches"))


for _name, _days in (("u14_alert_retention", 5), ("u15_log_retention", 14), ("u16_call_retention", 20)):

    @query(_name, f"WITH {CALLS}, {NOW} SELECT call_id FROM calls, now WHERE ts_ms >= t - {_days} * 86400000::BIGINT")
    def keep(spark, sf, days=_days):
        c = calls(spark, sf)
        return c.where(F.col("ts_ms") >= last_moment(c) - days * DAY).select("call_id")


@query("u17_delete_by_ids", "SELECT o_orderkey AS call_id FROM orders WHERE o_orderkey NOT IN (SELECT o_custkey FROM orders)")
def u17(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("call_id")).join(o.select(F.col("o_custkey").alias("call_id")), "call_id", "left_anti")


@query("u18_delete_duplicates", f"WITH {CALLS}, d AS (SELECT call_id, ts_ms - lag(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) AS gap FROM calls) SELECT call_id FROM d WHERE gap IS NULL OR gap > 600000")
def u18(spark, sf):
    from ..operators.temporal import chained_duplicates

    return chained_duplicates(calls(spark, sf), ["system_ref", "talkgroup_ref"], 600_000).where("not duplicate").select("call_id")


@query("u19_pruned_phrases", "SELECT p_brand AS label, string_agg(DISTINCT upper(trim(p_name)), '|' ORDER BY upper(trim(p_name))) AS phrases FROM part WHERE length(trim(p_name)) BETWEEN 3 AND 9 GROUP BY 1")
def u19(spark, sf):
    lists = table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.collect_list("p_name").alias("x"))
    fit = F.filter(F.transform("x", lambda p: F.upper(F.trim(p))), lambda p: F.length(p).between(3, 9))
    return lists.select("label", F.array_join(F.array_sort(F.array_distinct(fit)), "|").alias("phrases")).where("phrases <> ''")


@query("u20_merged_phrases", "SELECT p_brand AS label, string_agg(DISTINCT upper(p_name), '|' ORDER BY upper(p_name)) AS phrases FROM part WHERE p_size < 10 OR length(p_name) > 8 GROUP BY 1")
def u20(spark, sf):
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.collect_set(F.when(F.col("p_size") < 10, F.upper("p_name"))).alias("old"), F.collect_set(F.when(F.length("p_name") > 8, F.upper("p_name"))).alias("new"))
    return rows.select("label", F.array_join(F.array_sort(F.array_union("old", "new")), "|").alias("phrases")).where("phrases <> ''")
