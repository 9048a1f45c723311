"""Set-like operators: scoped unions, upserts as rewrites, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[Column], order: Column, *columns: str) -> DataFrame:
    """One row for each key: the first by ``order``.  Partial aggregation, so a hot key is no burden."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    least = F.min(F.struct(order.alias("o"), *columns)).alias("m")
    return rows.groupBy(*named).agg(least).select(*[F.col(f"m.{c}").alias(c) for c in columns])


def scoped(wide: DataFrame, narrow: DataFrame, key: Column, narrow_wins: bool, *columns: str) -> DataFrame:
    """Union of system-wide and channel rows, one for each key: the first wins, or with ``narrow_wins`` the channel's."""
    both = wide.withColumn("scope", F.lit(0)).unionByName(narrow.withColumn("scope", F.lit(1)))
    place = F.struct((-F.col("scope") if narrow_wins else F.col("scope")).alias("s"), "place")
    return first_by(both, [key], place, *columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert_hits(old: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Latest value, number of hits and last use of each key; ``old`` has key, value, hits, used and ``hits`` key, value, used."""
    both = old.select(key, "value", "hits", "used").unionByName(hits.select(key, "value", F.lit(1).cast("bigint").alias("hits"), "used"))
    return both.groupBy(key).agg(F.max(F.struct("used", "value"))["value"].alias("value"), F.sum("hits").alias("hits"), F.max("used").alias("used"))


def sync_actions(old: DataFrame, wanted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What makes ``old`` equal ``wanted``: a row and an action (insert, update, delete) for each key that differs."""
    a = old.select(*keys, F.struct(*columns).alias("was"))
    b = wanted.select(*keys, F.struct(*columns).alias("new"))
    joined = a.join(b, keys, "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("new")), "update")
    return joined.withColumn("action", action).where("action is not null").select(*keys, "action")
