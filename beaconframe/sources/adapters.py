"""The model's tables, read from the general test tables, and the same as SQL.

calls: events, one a call.  Channels are the event types (talkgroups 1 to 5), a
system is the user id modulo 8, the unit is the user, k comes from the JSON
payload.  Units of a call: the line items of an order.  Transcripts: documents.
Times are epoch milliseconds, read from zone-free timestamps, so no session zone
has a say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("click", "error", "purchase", "signup", "view")
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        epoch_ms("ts").alias("ts_ms"),
        F.pmod("user_id", F.lit(8)).alias("system_ref"),
        F.array_position(kind, F.col("event_type")).alias("talkgroup_ref"),
        F.col("user_id").alias("unit_ref"),
        F.col("value").alias("duration"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


CALLS = """calls AS (SELECT event_id AS call_id, epoch_us(ts) // 1000 AS ts_ms, user_id % 8 AS system_ref,
  CAST(list_position(['click','error','purchase','signup','view'], event_type) AS BIGINT) AS talkgroup_ref,
  user_id AS unit_ref, value AS duration, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def last_moment(frame: DataFrame, column: str = "ts_ms") -> int:
    """The explicit `as of`: the latest time in the table."""
    return frame.agg(F.max(column)).collect()[0][0] or 0


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_ref, label, region of the eight systems."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.where("n_nationkey < 8").join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("system_ref"), F.col("n_name").alias("system_label"), F.col("r_name").alias("region"))


SYSTEMS = "systems AS (SELECT CAST(n_nationkey AS BIGINT) AS system_ref, n_name AS system_label, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 8)"


def talkgroups(spark: SparkSession) -> DataFrame:
    """talkgroup_ref, label, tag, whether alerts are on (null: not set), retention and delay settings (0: not set)."""
    rows = [(1, "CLICK", "ops", None, 0, 0), (2, "ERROR", "fire", True, 3, 5), (3, "PURCHASE", "ems", False, 10, 0), (4, "SIGNUP", "ops", True, 0, 2), (5, "VIEW", "law", None, 25, 0)]
    return spark.createDataFrame(rows, "talkgroup_ref bigint, label string, tag string, alerts boolean, keep_days bigint, delay_min bigint")


TALKGROUPS = "talkgroups(talkgroup_ref, label, tag, alerts, keep_days, delay_min) AS (SELECT CAST(a AS BIGINT), b, c, d, CAST(e AS BIGINT), CAST(f AS BIGINT) FROM (VALUES (1,'CLICK','ops',NULL,0,0),(2,'ERROR','fire',TRUE,3,5),(3,'PURCHASE','ems',FALSE,10,0),(4,'SIGNUP','ops',TRUE,0,2),(5,'VIEW','law',NULL,25,0)) v(a,b,c,d,e,f))"
