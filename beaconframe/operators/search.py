"""Call search: predicates, access lists, delays, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import DAY, MINUTE


def searchable(calls: DataFrame, delayed: DataFrame | None = None) -> DataFrame:
    """Calls whose references are set and that are not held back."""
    found = calls.where("system_ref > 0 and talkgroup_ref > 0 and call_id >= 0")
    return found.join(delayed, "call_id", "left_anti") if delayed is not None else found


def by_channel(calls: DataFrame, system: int | None = None, talkgroup: int | None = None) -> DataFrame:
    """Equality on system and talkgroup; the talkgroup counts only together with a system."""
    if system is None:
        return calls
    found = calls.where(F.col("system_ref") == system)
    return found if talkgroup is None else found.where(F.col("talkgroup_ref") == talkgroup)


def by_group(calls: DataFrame, members: DataFrame, empty_is_all: bool = True) -> DataFrame:
    """Calls whose (system, talkgroup) is among ``members``; without members, by default, all calls."""
    if empty_is_all and members.isEmpty():
        return calls
    return calls.join(members.select("system_ref", "talkgroup_ref").distinct(), ["system_ref", "talkgroup_ref"], "left_semi")


def since(calls: DataFrame, as_of: int, start: int | None = None, descending: bool = True) -> DataFrame:
    """From ``start`` on; without one, the last day, but all of time in ascending order."""
    if start is not None:
        return calls.where(F.col("ts_ms") >= start)
    return calls.where(F.col("ts_ms") >= as_of - DAY) if descending else calls


def delay_minutes(user: int, systems: dict[int, int], talkgroups: dict[int, int], default: int = 0) -> int:
    """The delay of a search: the least of the talkgroups' positive delays, else of the systems', else the user's, else the default."""
    for found in ([d for d in talkgroups.values() if d > 0], [d for d in systems.values() if d > 0], [user] if user > 0 else []):
        if found:
            return min(found)
    return default


def effective_delay(*settings: Column) -> Column:
    """The first setting that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(s, F.lit(0)) for s in settings], F.lit(0))


def page(calls: DataFrame, limit: int, offset: int = 0, descending: bool = True) -> DataFrame:
    """A page in time order with a total order by id, and whether more rows follow."""
    order = [F.desc("ts_ms"), F.desc("call_id")] if descending else [F.asc("ts_ms"), F.asc("call_id")]
    rows = calls.orderBy(*order).offset(offset).limit(limit + 1)
    from pyspark.sql import Window

    numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def permitted(calls: DataFrame, rights: DataFrame, principal: str) -> DataFrame:
    """Calls that the principal's rights cover; a right without a talkgroup covers its system, one without a system everything."""
    own = rights.where(F.col("principal") == principal).select(F.col("system_ref").alias("s"), F.col("talkgroup_ref").alias("t"))
    match = (F.col("s").isNull() | (F.col("s") == F.col("system_ref"))) & (F.col("t").isNull() | (F.col("t") == F.col("talkgroup_ref")))
    return calls.join(F.broadcast(own), match, "left_semi")  # one principal's list


def rights_table(lists: DataFrame) -> DataFrame:
    """(principal, system_ref, talkgroup_ref) from JSON access lists; null means all.

    '*', '' and null give everything; a system's talkgroups may be '*', missing or a list.
    """
    kind = "array<struct<id:bigint,talkgroups:string>>"
    parsed = lists.select("principal", F.coalesce("systems", F.lit("")).alias("systems"))
    everything = parsed.where("systems in ('*', '')").select("principal", F.lit(None).cast("bigint").alias("system_ref"), F.lit(None).cast("bigint").alias("talkgroup_ref"))
    entry = parsed.where("systems not in ('*', '')").select("principal", F.explode(F.from_json("systems", kind)).alias("e"))
    wild = F.coalesce(F.col("e.talkgroups"), F.lit("*")) == "*"
    refs = F.when(wild, F.array(F.lit(None).cast("bigint"))).otherwise(F.from_json("e.talkgroups", "array<bigint>"))
    some = entry.select("principal", F.col("e.id").alias("system_ref"), F.explode(refs).alias("talkgroup_ref"))
    return everything.unionByName(some)


def invalid_reason(audio_bytes: Column, ts_ms: Column, system: Column, talkgroup: Column) -> Column:
    """Why a call is not accepted: the last reason that holds, or null."""
    return F.when(talkgroup < 1, "no talkgroup").when(system < 1, "no system").when(ts_ms == 0, "no timestamp").when(audio_bytes <= 44, "no audio")


def is_expired(ts_ms: Column, as_of: int, *days: Column) -> Column:
    """Whether a call is past its retention: the first setting other than 0 holds; all 0 keeps for ever."""
    keep = effective_delay(*days).cast("bigint")
    return (keep > 0) & (ts_ms < F.lit(as_of) - keep * DAY)


def released(calls: DataFrame, as_of: int, delay: Column) -> DataFrame:
    return calls.where(F.col("ts_ms") + delay * MINUTE <= as_of)
