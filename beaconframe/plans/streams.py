"""Streaming operators (T), run over what is there; their batch twins are the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..sources.adapters import CALLS, HOUR, MINUTE, TALKGROUPS, calls, talkgroups
from ..sources.shared import ship
from ..streaming import stateful, timers
from ..streaming.sources import call_stream, run_available, run_timed
from .joins import COOLDOWN
from .registry import query

CHANNEL = ["system_ref", "talkgroup_ref"]


@query("t03_arrival_duplicates", f"WITH {CALLS} SELECT system_ref, talkgroup_ref, call_id, COALESCE(ts_ms - lag(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) <= 600000, FALSE) AS duplicate FROM calls")
def t03(spark, sf):
    ship(spark)
    return run_available(stateful.arrival_duplicates(call_stream(spark, sf), CHANNEL, 10 * MINUTE))


@query("t05_evicted_state", f"""WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls), l AS (SELECT unit_ref, ts_ms, lead(ts_ms) OVER (PARTITION BY unit_ref ORDER BY ts_ms, call_id) AS next_ms FROM calls)
 SELECT unit_ref, ts_ms AS last_ms FROM l, m WHERE COALESCE(next_ms, t) - ts_ms > 7200000""")
def t05(spark, sf):
    """When a unit's state went: twice the window of an hour after its last call, by a timer; state younger than that at the end of the table stays."""
    found = run_timed(timers.arrivals(call_stream(spark, sf), ["unit_ref"], HOUR))
    return found.where("kind = 'evicted'").select("unit_ref", F.col("ts_ms").alias("last_ms"))


#: Calls stand for tones, claims and voice; hours for the reference's seconds, as the table has a call every few minutes.
SETTINGS = {"links": {1: {2}, 2: {1}}, "window_ms": 12 * HOUR, "orphan_ms": 6 * HOUR, "wait_ms": 90 * MINUTE, "link_ms": 3 * HOUR}


def tone_events(spark, sf):
    kind = F.when(F.col("k") < 30, "tone").when(F.col("k") < 40, "lock").otherwise("voice")
    channel = F.col("talkgroup_ref")
    return call_stream(spark, sf).select("system_ref", F.when(channel == 2, 1).otherwise(channel).cast("bigint").alias("book"), channel.alias("channel"), kind.alias("kind"), "call_id", "ts_ms", "at", (F.col("duration") / 10).alias("voice_s"))


def settled_tones(spark, sf):
    return run_timed(timers.tone_book(tone_events(spark, sf), ["system_ref", "book"], **SETTINGS))


@query("t09_tone_book")
def t09(spark, sf):
    """Tones that a voice call took, over linked channels, successor slots and parked short calls."""
    return settled_tones(spark, sf).where("kind = 'attached'").select("system_ref", "book", "tone_call", "voice_call", "at_ms")


@query("t10_orphaned_tones")
def t10(spark, sf):
    """Tones that nobody followed, with those that waited behind them and those that later tones replaced."""
    return settled_tones(spark, sf).where("kind <> 'attached'").select("system_ref", "book", "kind", "tone_call", "at_ms")


@query("t11_parked_short_calls")
def t11(spark, sf):
    """Short calls that got tones after their wait, since no longer call came."""
    done = settled_tones(spark, sf).where("kind = 'attached'")
    return done.join(calls(spark, sf).select(F.col("call_id").alias("voice_call"), "duration"), "voice_call").where("duration < 50").select("voice_call", "tone_call", "at_ms")


@query("t06_without_duplicates", f"WITH {CALLS}, d AS (SELECT system_ref, talkgroup_ref, call_id, ts_ms - lag(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) AS gap FROM calls) SELECT system_ref, talkgroup_ref, call_id FROM d WHERE gap IS NULL OR gap > 600000")
def t06(spark, sf):
    ship(spark)
    return run_available(stateful.arrival_duplicates(call_stream(spark, sf), CHANNEL, 10 * MINUTE).where("not duplicate").drop("duplicate"))


PENDING = """WITH {calls}, c AS (SELECT *, k < 30 AS has_tones FROM calls), o AS (SELECT *, row_number() OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY ts_ms, call_id) AS n FROM c),
 g AS (SELECT *, sum(CASE WHEN NOT has_tones THEN 1 ELSE 0 END) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM o),
 b AS (SELECT *, lead(ts_ms) OVER (PARTITION BY system_ref, talkgroup_ref ORDER BY n) AS next_ms, COALESCE(run, 0) AS r FROM g),
 v AS (SELECT system_ref, talkgroup_ref, r, max(call_id) FILTER (NOT has_tones) AS voice FROM b GROUP BY 1, 2, 3),
 x AS (SELECT b.*, bool_or(next_ms - ts_ms > 7200000) OVER (PARTITION BY system_ref, talkgroup_ref, r ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM b WHERE has_tones)
 SELECT x.system_ref, x.talkgroup_ref, x.call_id AS tone_call, v.voice AS voice_call FROM x JOIN v USING (system_ref, talkgroup_ref, r) WHERE NOT broken AND v.voice IS NOT NULL"""


@query("t07_pending_tones", PENDING.format(calls=CALLS))
def t07(spark, sf):
    ship(spark)
    return run_available(stateful.pending_tones(call_stream(spark, sf).withColumn("has_tones", F.col("k") < 30), CHANNEL, 2 * HOUR))


@query("t14_alert_cooldown", COOLDOWN.format(calls=CALLS, keys="talkgroup_ref", fkeys="f.talkgroup_ref", okeys="o.talkgroup_ref", match="o.talkgroup_ref = f.talkgroup_ref", ms=7_200_000, where="k < 30"))
def t14(spark, sf):
    ship(spark)
    return run_available(stateful.cooldown(call_stream(spark, sf).where("k < 30"), ["talkgroup_ref"], 2 * HOUR))


@query("t15_once_per_call", f"WITH {CALLS} SELECT DISTINCT call_id FROM calls")
def t15(spark, sf):
    return run_available(call_stream(spark, sf).select("call_id").dropDuplicates())


@query("t16_pager_claims", f"WITH {CALLS} SELECT DISTINCT unit_ref, talkgroup_ref FROM calls")
def t16(spark, sf):
    return run_available(call_stream(spark, sf).select("unit_ref", "talkgroup_ref").dropDuplicates())


@query("t17_recent_alerts", f"WITH {CALLS} SELECT DISTINCT system_ref, k FROM calls")
def t17(spark, sf):
    """Alerts kept apart for an hour of event time; over one batch that is one row for each alert."""
    return run_available(call_stream(spark, sf).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["system_ref", "k"]).select("system_ref", "k"))


@query("t18_rolling_counts", f"WITH {CALLS}, w AS (SELECT talkgroup_ref, (ts_ms // 1800000 - i) * 1800000 AS start_ms FROM calls, range(2) r(i)), m AS (SELECT max(ts_ms) AS t FROM calls) SELECT talkgroup_ref, start_ms, count(*) AS calls FROM w, m WHERE start_ms + 3600000 <= t GROUP BY 1, 2")
def t18(spark, sf):
    counted = call_stream(spark, sf).withWatermark("at", "0 seconds").groupBy(F.window("at", "1 hour", "30 minutes").alias("w"), "talkgroup_ref").agg(F.count(F.lit(1)).alias("calls"))
    return run_available(counted.select("talkgroup_ref", F.unix_millis("w.start").alias("start_ms"), "calls"))


@query("t19_silences", f"WITH {CALLS}, l AS (SELECT system_ref, lag(ts_ms) OVER (PARTITION BY system_ref ORDER BY ts_ms, call_id) AS start_ms, ts_ms AS end_ms FROM calls) SELECT * FROM l WHERE end_ms - start_ms > 7200000")
def t19(spark, sf):
    ship(spark)
    return run_available(stateful.monitor(call_stream(spark, sf), ["system_ref"], 2 * HOUR))


@query("t20_key_silences", f"WITH {CALLS}, l AS (SELECT unit_ref, lag(ts_ms) OVER (PARTITION BY unit_ref ORDER BY ts_ms, call_id) AS start_ms, ts_ms AS end_ms FROM calls) SELECT * FROM l WHERE end_ms - start_ms > 86400000")
def t20(spark, sf):
    ship(spark)
    return run_available(stateful.monitor(call_stream(spark, sf), ["unit_ref"], 24 * HOUR))


@query("t23_keyword_alerts", f"WITH {CALLS}, {TALKGROUPS} SELECT call_id, label, tag FROM calls JOIN talkgroups USING (talkgroup_ref) WHERE alerts AND k % 10 = 1")
def t23(spark, sf):
    return run_available(call_stream(spark, sf).where("k % 10 = 1").join(F.broadcast(talkgroups(spark).where("alerts")), "talkgroup_ref").select("call_id", "label", "tag"))


@query("t24_tone_alert_rows", f"WITH {CALLS} SELECT call_id, 'set' || (k + i) % 12 AS tone_set FROM calls, range(2) r(i)")
def t24(spark, sf):
    sets = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.concat(F.lit("set"), (F.col("k") + i) % 12))
    return run_available(call_stream(spark, sf).select("call_id", F.explode(sets).alias("tone_set")))


@query("t30_expired_flags", f"WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls) SELECT call_id FROM calls, m WHERE ts_ms + k * 86400000 <= t")
def t30(spark, sf):
    from ..sources.adapters import last_moment

    c = calls(spark, sf)
    return c.where(F.col("ts_ms") + F.col("k") * 86_400_000 <= last_moment(c)).select("call_id")


@query("t31_backlog_on_connect", f"WITH {CALLS}, m AS (SELECT max(ts_ms) AS t FROM calls) SELECT call_id FROM calls, m WHERE ts_ms BETWEEN t - (5 + 600) * 60000 AND t - 5 * 60000")
def t31(spark, sf):
    from ..sources.adapters import last_moment

    c = calls(spark, sf)
    now = last_moment(c)
    return c.where(F.col("ts_ms").between(now - 605 * MINUTE, now - 5 * MINUTE)).select("call_id")


@query("t33_rate_limit", f"WITH RECURSIVE {CALLS}, f AS (SELECT unit_ref, min(ts_ms) AS s FROM calls GROUP BY 1 UNION ALL SELECT f.unit_ref, (SELECT min(ts_ms) FROM calls c WHERE c.unit_ref = f.unit_ref AND c.ts_ms >= f.s + 86400000) FROM f WHERE f.s IS NOT NULL) SELECT f.unit_ref, s AS window_ms, count(*) AS calls, count(*) > 3 AS limited FROM f JOIN calls c ON c.unit_ref = f.unit_ref AND c.ts_ms >= s AND c.ts_ms < s + 86400000 GROUP BY 1, 2")
def t33(spark, sf):
    """Fixed windows that open with the first call after the last one closed."""
    c = calls(spark, sf)
    placed = temporal.anchored_windows(c, ["unit_ref"], 86_399_999)
    return placed.groupBy("unit_ref", "window_ms").agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) > 3).alias("limited"))


@query("t33_login_lockouts")
def t33b(spark, sf):
    """Whether each attempt met a block: six failures block a unit for a day; a success in between clears the count."""
    attempts = call_stream(spark, sf).select("unit_ref", "call_id", "ts_ms", "at", (F.col("k") < 80).alias("failed"))
    return run_timed(timers.lockouts(attempts, ["unit_ref"], 6, 24 * HOUR))
