"""From recorded clips to the tone sets that they hold: clips are binaries in a table, tones are rows, and matching is a join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..sources.shared import ship

#: Width in Hz of the frequency bands that tones and sets meet in.
BAND_HZ = 10.0
#: Longest gap in seconds between the end of the first tone and the start of the second.
GAP_S = 0.5


def detected_tones(clips: DataFrame) -> DataFrame:
    """clip_id, place, frequency, start, end, duration, magnitude: the tones, without harmonics, of ``clips`` (clip_id, wav).

    A clip that is null or no WAV file has none.
    """
    ship(clips.sparkSession)
    kind = clips.schema["clip_id"].dataType.simpleString()
    names = ("frequency", "start", "end", "duration", "magnitude")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for clip, wav in zip(batch.column("clip_id").to_pylist(), batch.column("wav")):
                data = wav.as_buffer().to_pybytes() if wav.is_valid else b""
                if data[:4] == b"RIFF" and len(data) > 44:
                    tones = signal.without_harmonics(signal.tone_segments(*signal.pcm_of_wav(data)))
                    rows += [(clip, i, *(t[n] for n in names)) for i, t in enumerate(tones)]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(columns[0], batch.schema.field("clip_id").type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=["clip_id", "place", *names])

    return clips.select("clip_id", "wav").mapInArrow(run, f"clip_id {kind}, place int, " + ", ".join(f"`{n}` double" for n in names))


def tolerance_hz(tolerance: Column) -> Column:
    """A tolerance below one is a share of 500 Hz."""
    return F.when(tolerance < 1, tolerance * 500).otherwise(tolerance)


def _band(frequency: Column) -> Column:
    return F.floor(frequency / BAND_HZ)


def _in_band(tones: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """Tones that fit one side (a, b or long) of a set in frequency and duration: each set is dealt to the bands that it reaches, each tone lies in one."""
    spec = F.col(side)
    wide = sets.where(spec.isNotNull()).select("set_id", spec.alias("spec"), tolerance_hz(F.col("tolerance")).alias("hz"))
    reach = F.sequence(_band(F.col("spec.frequency") - F.col("hz")), _band(F.col("spec.frequency") + F.col("hz")))
    found = tones.withColumn("band", _band(F.col("frequency"))).join(wide.withColumn("band", F.explode(reach)), "band")
    most = F.coalesce(F.nullif("spec.max", F.lit(0.0)), F.lit(float("inf")))
    fits = (F.abs(F.col("frequency") - F.col("spec.frequency")) <= F.col("hz")) & (F.col("duration") >= F.coalesce("spec.min", F.lit(0.0))) & (F.col("duration") <= most)
    return found.where(fits).select("clip_id", "set_id", F.struct("start", "place", "end", "duration").alias(side))


def matched_sets(tones: DataFrame, sets: DataFrame) -> DataFrame:
    """clip_id, set_id, first (the tone that matched first), second (the b tone nearest after it, null for other sets): a row for each set that a clip holds.

    ``sets``: set_id, a, b, long (each a struct of frequency, min, max in seconds; max
    null or 0 for none) and tolerance.  A set of a and b needs an a tone, and a b tone
    that starts no earlier and at most half a second after its end; of several b tones
    the one with the least gap counts, the first of equal ones.  A long tone counts only
    where a set has neither a nor b.  A set without any tone matches nothing.
    """
    pairs = sets.where("a is not null and b is not null")
    single = sets.where("(a is null) <> (b is null)").withColumn("one", F.coalesce("a", "b"))
    long = sets.where("a is null and b is null").withColumn("one", F.col("long"))
    gap = F.col("b.start") - F.col("a.end")
    both = _in_band(tones, pairs, "a").join(_in_band(tones, pairs, "b"), ["clip_id", "set_id"])
    both = both.where((F.col("b.start") >= F.col("a.start")) & (gap >= -F.col("a.duration")) & (gap <= GAP_S))
    nearest = both.groupBy("clip_id", "set_id").agg(F.min(F.struct("a", F.abs(gap).alias("gap"), F.col("b"))).alias("m")).select("clip_id", "set_id", F.col("m.a").alias("first"), F.col("m.b").alias("second"))
    alone = _in_band(tones, single.unionByName(long), "one").groupBy("clip_id", "set_id").agg(F.min("one").alias("first"))
    return nearest.unionByName(alone.withColumn("second", F.lit(None).cast(nearest.schema["second"].dataType)))


def known_sets(candidates: DataFrame, sets: DataFrame, hz: float) -> DataFrame:
    """``candidates`` (candidate_id, a_hz, b_hz; b_hz null for a long tone) with ``known``: whether a set has the same tones within ``hz``."""
    of_kind = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct(F.col("a.frequency").alias("x"), F.col("b.frequency").alias("y")))
    have = sets.select(F.coalesce(of_kind, F.when(F.col("a").isNull() & F.col("b").isNull(), F.struct(F.col("long.frequency").alias("x"), F.lit(None).cast("double").alias("y")))).alias("s")).where("s.x is not null").select("s.*").distinct()
    dealt = have.withColumn("band", F.explode(F.sequence(_band(F.col("x") - hz), _band(F.col("x") + hz))))
    alike = (F.abs(F.col("a_hz") - F.col("x")) <= hz) & F.coalesce(F.abs(F.col("b_hz") - F.col("y")) <= hz, F.col("b_hz").isNull() & F.col("y").isNull())
    hits = candidates.withColumn("band", _band(F.col("a_hz"))).join(dealt, "band").where(alike).select("candidate_id").distinct()
    return candidates.join(hits.withColumn("known", F.lit(True)), "candidate_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
