"""Activity statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import first_group
from ..sources.adapters import DAY, HOUR, MINUTE
from ..sources.shared import ship

# Incident categories in the order they are tried, each with its parent and the substrings that mark it.
CATEGORIES = (
    ("Structure Fire", "Fire", ("structure fire", "working fire", "house fire", "garage fire", "apartment fire", "residential fire", "commercial fire", "warehouse fire", "fully involved", "smoke showing", "basement fire", "attic fire", "kitchen fire", "bedroom fire", "office fire")),
    ("Brush / Wildland", "Fire", ("brush fire", "grass fire", "wildland", "barn fire", "field fire")),
    ("Vehicle Fire", "Fire", ("vehicle fire", "car fire", "truck fire")),
    ("Fire Alarm", "Fire", ("fire alarm", "alarm activation", "fire investigation", "rekindle", "dumpster fire")),
    ("Fire (General)", "Fire", ("smoke", "flames", "burning")),
    ("Carbon Monoxide", "Hazmat", ("carbon monoxide", "co alarm")),
    ("Gas Leak", "Hazmat", ("gas leak", "natural gas", "propane", "ammonia")),
    ("Chemical / Spill", "Hazmat", ("hazmat", "chemical", "spill", "unknown substance", "fumes", "strange odor", "unknown odor")),
    ("Cardiac / Breathing", "Medical / EMS", ("cardiac", "not breathing", "chest pain", "respiratory", "cpr", "stopped breathing")),
    ("Trauma / Injury", "Medical / EMS", ("trauma", "injured", "bleeding", "laceration", "fracture")),
    ("Overdose / Substance", "Medical / EMS", ("overdose", "narcan", "bad drugs", "intoxicated")),
    ("General Medical", "Medical / EMS", ("squad", "patient", "medical", "ems", "ambulance", "sick", "medication", "pass out", "stomach pain")),
    ("Violent Crime", "Crime", ("shooting", "shots fired", "shot fired", "gunshot", "armed", "assault", "battery", "robbery", "homicide", "stabbing", "weapon", "gun")),
    ("Property Crime", "Crime", ("stolen", "theft", "burglary", "larceny", "shoplifting", "breaking in", "vandalism")),
    ("Suspicious", "Crime", ("suspicious", "warrant")),
    ("MVA / Crash", "Traffic", ("accident", "crash", "collision", "mva", "rollover")),
    ("Traffic Stop / Plate", "Traffic", ("traffic stop", "plate", "registered to", "comes back to", "return clean", "registered owner")),
    ("Road Hazard", "Traffic", ("erratic", "speeding", "road blocked", "wires down", "broken down", "broke down")),
    ("Domestic", "Disturbance", ("domestic",)),
    ("Disturbance", "Disturbance", ("disturbance", "argument", "fighting", "irate", "unwanted", "trespass", "refusing", "wilding out", "attacking")),
)
PARENTS = ("Fire", "Hazmat", "Medical / EMS", "Crime", "Traffic", "Disturbance")


def per_minute(calls: DataFrame, as_of: int, minutes: int = 60) -> DataFrame:
    """Calls by minute over the last ``minutes``; minutes without calls have no row."""
    recent = calls.where(F.col("ts_ms") >= as_of - minutes * MINUTE)
    return recent.groupBy(F.expr(f"ts_ms div {MINUTE} * {MINUTE}").alias("bucket_ms")).agg(F.count(F.lit(1)).alias("calls"))


def top_channels(calls: DataFrame, channels: DataFrame, as_of: int, hours: int = 24, most: int = 10) -> DataFrame:
    """The busiest channels; one without a label is named after its reference."""
    counted = calls.where(F.col("ts_ms") >= as_of - hours * HOUR).groupBy("talkgroup_ref").agg(F.count(F.lit(1)).alias("calls"))
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("TG "), F.col("talkgroup_ref").cast("string")))
    return counted.join(F.broadcast(channels), "talkgroup_ref", "left").select("talkgroup_ref", name.alias("label"), "calls").orderBy(F.desc("calls"), "talkgroup_ref").limit(most)


def by_hour_of_day(calls: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Calls by hour of the day, with a row for each of the 24 hours."""
    hours = calls.sparkSession.range(24).select(F.col("id").alias("hour"))
    counted = calls.where(F.col("ts_ms") >= as_of - days * DAY).groupBy(F.expr(f"ts_ms div {HOUR} % 24").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(F.broadcast(counted), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("calls"))


def counters(calls: DataFrame, as_of: int) -> DataFrame:
    """Calls today, in the last minute and in the last hour, in one pass."""
    since = lambda ms: F.count_if(F.col("ts_ms") >= ms)
    return calls.agg(since(as_of // DAY * DAY).alias("today"), since(as_of - MINUTE).alias("last_minute"), since(as_of - HOUR).alias("last_hour"))


def category_number(lower_text: Column) -> Column:
    """The number, from 1, of the first category that the lower-case text has a substring of, or null."""
    return first_group(lower_text, tuple(words for _, _, words in CATEGORIES))


def incident_summary(transcripts: DataFrame) -> DataFrame:
    """place, parent, category, calls of each, and the parent's calls; parents without calls have no row."""
    ship(transcripts.sparkSession)
    counted = transcripts.select(category_number(F.lower("transcript")).alias("number")).where("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("calls"))
    of = lambda part: F.element_at(F.array(*[F.lit(c[part]) for c in CATEGORIES]), F.col("number"))
    named = counted.select(of(1).alias("parent"), of(0).alias("category"), "calls")
    order = F.array_position(F.array(*[F.lit(p) for p in PARENTS]), F.col("parent"))
    total = named.groupBy("parent").agg(F.sum("calls").alias("parent_calls"))
    return named.join(F.broadcast(total), "parent").select(order.alias("place"), "parent", "category", "calls", "parent_calls")


def marginals(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by both columns, by each of them, and in all, in one pass."""
    return rows.groupingSets([(first, second), (first,), (second,), ()], first, second).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("kind"))


def silent_channels(calls: DataFrame, has_tones: Column, least: int = 5) -> DataFrame:
    """Channels with ``least`` calls or more and no tones in any."""
    return calls.groupBy("talkgroup_ref", "system_ref").agg(F.count(F.lit(1)).alias("calls"), F.count_if(has_tones).alias("tone_calls")).where((F.col("calls") >= least) & (F.col("tone_calls") == 0))


def last_heard(calls: DataFrame, systems: DataFrame, as_of: int, never_days: int = 365) -> DataFrame:
    """Minutes since each system's last call; one that never had any counts as ``never_days``."""
    last = calls.groupBy("system_ref").agg(F.max("ts_ms").alias("last_ms"))
    silent = F.expr(f"({as_of} - coalesce(last_ms, {as_of - never_days * DAY})) div {MINUTE}")
    return systems.join(last, "system_ref", "left").select("system_ref", "system_label", silent.alias("silent_minutes"))
