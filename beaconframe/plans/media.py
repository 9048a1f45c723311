"""Files with structure of their own (S06, S18): made from the tables, stored, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..operators import tonesets
from ..operators.geometry import points_in_rings
from ..sources import shapes, tags
from ..sources.adapters import CALLS, KINDS, calls, table
from ..sources.shared import ship, written
from .registry import query


@query(
    "s06_tagged_calls",
    f"""WITH {CALLS} SELECT call_id, NULLIF(unit_ref, 0) AS unit_ref, CASE WHEN unit_ref > 0 AND k % 3 > 0 THEN 'Unité ' || k END AS unit_label, ts_ms, CASE WHEN k > 9 THEN 154000000 + k * 12500 END AS frequency,
 'County ' || system_ref AS system_label, talkgroup_ref, list_extract([{", ".join(f"'{k}'" for k in KINDS)}], talkgroup_ref) AS talkgroup_label, CASE WHEN k % 2 = 0 THEN [k + 100, k + 200] END AS patches FROM calls""",
)
def s06(spark, sf):
    """Each call as a file with a tag, in a table of binaries; versions and encodings by turns."""
    ship(spark)
    k = F.col("k")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("talkgroup_ref").cast("int"))
    title = F.concat(F.col("talkgroup_ref").cast("string"), F.lit(' "'), kind, F.lit('"'), F.when(k % 2 == 0, F.concat(F.lit(" ["), k + 100, F.lit(","), k + 200, F.lit(",-1]"))).otherwise(""))
    artist = F.concat(F.col("unit_ref").cast("string"), F.when(k % 3 > 0, F.concat(F.lit(" Unité "), k)).otherwise(""))
    frequency = F.when(k > 9, 154_000_000 + k * 12_500).otherwise(0)
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS")
    comment = F.concat(F.lit("Date:"), stamp, F.lit(";System:County "), F.col("system_ref"), F.lit(";Frequency:"), frequency, F.lit(";"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("call_id", "title", "artist", "comment")))
            data = [tags.write_tag({"title": t, "artist": a, "comment": c}, b"\xff\xfb" * 20, 3 + i % 2, (0, 1, 3)[i % 3] if i % 2 else i % 2) for i, t, a, c in rows]
            yield pa.record_batch([pa.array([str(i) for i in b.column("call_id").to_pylist()]), pa.array(data, pa.binary())], names=["path", "content"])

    files = written(calls(spark, sf).select("call_id", title.alias("title"), artist.alias("artist"), comment.alias("comment")).mapInArrow(run, "path string, content binary"))
    return tags.tagged_calls(files).withColumn("path", F.col("path").cast("bigint")).withColumnRenamed("path", "call_id")


# A boundary of each customer: an L of two boxes to the north and the east of its place, and a smaller ring beside it.
L_SQL = "SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS geoid, c_name AS name, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state, 40 + c_acctbal / 10000 AS y, -80 + c_nationkey / 10.0 AS x, 0.01 + c_custkey % 5 / 1000.0 AS s FROM customer"


#: Customers whose boundaries of one nation go into one pair of files.
PART = 25_000


def boundary_files(spark, sf):
    """Pairs of files with the boundaries of a nation's customers, a pair for each PART of customer numbers."""
    ship(spark)
    c = table(spark, sf, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / PART).alias("part"), "c_custkey", "c_name", (40 + F.col("c_acctbal") / 10000).alias("y"), (-80 + F.col("c_nationkey") / 10.0).alias("x"), (0.01 + F.col("c_custkey") % 5 / 1000.0).alias("s"))

    def run(key, rows):
        import pandas as pd

        made = []
        for r in rows.itertuples():
            x, y, s = r.x, r.y, r.s
            ring = [(x, y), (x, y + 2 * s), (x + s, y + 2 * s), (x + s, y + s), (x + 2 * s, y + s), (x + 2 * s, y), (x, y)]
            made.append(({"GEOID": f"{r.c_custkey:07d}", "NAME": r.c_name, "STATEFP": str(key[0])}, [[(x - s, y), (x - s, y + s), (x - 2 * s, y), (x - s, y)], ring]))
        shp, dbf = shapes.write_shapes(made, {"STATEFP": 2, "GEOID": 12, "NAME": 40})
        return pd.DataFrame([(f"nation_{key[0]}_{key[1]}", shp, dbf)], columns=["stem", "shp", "dbf"])

    return written(c.groupBy("c_nationkey", "part").applyInPandas(run, "stem string, shp binary, dbf binary"))


@query("s18_boundaries", f"WITH l AS ({L_SQL}) SELECT geoid, name, state, y AS min_lat, x AS min_lon, y + 2 * s AS max_lat, x + 2 * s AS max_lon, 7 AS points FROM l")
def s18(spark, sf):
    return shapes.features(boundary_files(spark, sf)).select("geoid", "name", "state", "min_lat", "min_lon", "max_lat", "max_lon", F.size("ring").alias("points"))


@query("s18_one_state", f"WITH l AS ({L_SQL}) SELECT geoid, name FROM l WHERE state = '03'")
def s18b(spark, sf):
    """The state filter, which is the feature: other states' shapes are not decoded."""
    return shapes.features(boundary_files(spark, sf), "3").select("geoid", "name")


@query(
    "s18_points_in_boundaries",
    f"""WITH l AS ({L_SQL}), p AS (SELECT s_suppkey AS id, 40 + s_acctbal / 10000 AS lat, -80 + s_nationkey / 10.0 + s_suppkey % 7 * 0.003 AS lon FROM supplier)
 SELECT id, geoid FROM p JOIN l ON lon >= x AND lat >= y AND ((lon < x + 2 * s AND lat < y + s) OR (lon < x + s AND lat < y + 2 * s))""",
)
def s18c(spark, sf):
    points = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (40 + F.col("s_acctbal") / 10000).alias("lat"), (-80 + F.col("s_nationkey") / 10.0 + F.col("s_suppkey") % 7 * 0.003).alias("lon"))
    return points_in_rings(points, shapes.features(boundary_files(spark, sf)))


# Clips: for each channel and k a file with two tones of a second, 300 + 100 * channel Hz and 900 + 5 * k Hz, between quiet noise.
# Sets: one a customer; all frequencies are multiples of 5 Hz and no tolerance is, so what is heard a little off decides nothing.
CLIPS_SQL = f"WITH {CALLS}, clips AS (SELECT DISTINCT talkgroup_ref * 1000 + k AS clip_id, 300 + 100 * talkgroup_ref AS fa, 900 + 5 * k AS fb FROM calls)"
SETS_SQL = """sets AS (SELECT c_custkey AS set_id, c_custkey % 4 AS kind, 400 + c_custkey * 5 % 500 AS a, 900 + c_custkey * 35 % 500 AS b, CASE WHEN c_custkey % 2 = 0 THEN 7.5 ELSE 12.5 END AS hz, c_custkey % 11 > 0 AS short_enough FROM customer)"""
HELD_SQL = f"""{CLIPS_SQL}, {SETS_SQL}, held AS (SELECT clip_id, set_id, kind FROM clips JOIN sets ON short_enough AND CASE kind
 WHEN 3 THEN abs(fa - b) <= hz OR abs(fb - b) <= hz WHEN 2 THEN abs(fa - a) <= hz OR abs(fb - a) <= hz ELSE abs(fa - a) <= hz AND abs(fb - b) <= hz END)"""


def clips(spark, sf):
    """clip_id, wav: stored as binaries."""
    ship(spark)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = np.arange(signal.RATE) / signal.RATE
        quiet = 0.01 * np.random.default_rng(1).standard_normal(signal.RATE // 2)
        for b in batches:
            ids = b.column("clip_id").to_pylist()
            waves = [[0.5 * np.sin(2 * np.pi * hz * t) for hz in (300 + 100 * (i // 1000), 900 + 5 * (i % 1000))] for i in ids]
            yield pa.record_batch([b.column("clip_id"), pa.array([signal.wav_of_pcm(np.concatenate([quiet, *w, quiet])) for w in waves], pa.binary())], names=["clip_id", "wav"])

    return written(calls(spark, sf).select((F.col("talkgroup_ref") * 1000 + F.col("k")).alias("clip_id")).distinct().mapInArrow(run, "clip_id bigint, wav binary"))


def tone_sets(spark, sf):
    """Pairs (kinds 0 and 1), first tones only (2) and long tones (3); every eleventh asks for shorter tones than any clip has."""
    n = F.col("c_custkey")
    most = F.when(n % 11 > 0, 0.0).otherwise(0.5)
    spec = lambda hz: F.struct(hz.cast("double").alias("frequency"), F.lit(0.6).alias("min"), most.alias("max"))
    a, b = spec(400 + n * 5 % 500), spec(900 + n * 35 % 500)
    kind = n % 4
    tolerance = F.when(n % 4 == 0, 0.015).when(n % 2 == 0, 7.5).when(n % 4 == 1, 0.025).otherwise(12.5)
    return table(spark, sf, "customer").select(n.alias("set_id"), F.when(kind < 3, a).alias("a"), F.when(kind < 2, b).alias("b"), F.when(kind == 3, b).alias("long"), tolerance.alias("tolerance"))


@query("m19_tone_set_match", f"{HELD_SQL} SELECT clip_id, set_id, kind < 2 AS pair FROM held")
def m19(spark, sf):
    found = tonesets.matched_sets(tonesets.detected_tones(clips(spark, sf)), tone_sets(spark, sf))
    return found.select("clip_id", "set_id", F.col("second").isNotNull().alias("pair"))


@query("m20_all_matches", f"{HELD_SQL} SELECT clip_id, count(set_id) AS matches FROM clips LEFT JOIN held USING (clip_id) GROUP BY 1")
def m20(spark, sf):
    stored = clips(spark, sf)
    found = tonesets.matched_sets(tonesets.detected_tones(stored), tone_sets(spark, sf)).groupBy("clip_id").agg(F.count(F.lit(1)).alias("matches"))
    return stored.select("clip_id").join(found, "clip_id", "left").select("clip_id", F.coalesce("matches", F.lit(0)).alias("matches"))


@query("m33_known_tone_sets", f"{CLIPS_SQL}, {SETS_SQL} SELECT clip_id, EXISTS (SELECT 1 FROM sets WHERE kind < 2 AND abs(fa - a) <= 12 AND abs(fb - b) <= 12) AS known FROM clips")
def m33(spark, sf):
    """Whether the two tones of a clip are a set already."""
    tones = tonesets.detected_tones(clips(spark, sf))
    side = lambda i: F.max(F.when(F.col("place") == i, F.col("frequency")))
    candidates = tones.groupBy(F.col("clip_id").alias("candidate_id")).agg(side(0).alias("a_hz"), side(1).alias("b_hz"))
    return tonesets.known_sets(candidates, tone_sets(spark, sf), 12.0).select(F.col("candidate_id").alias("clip_id"), "known")
