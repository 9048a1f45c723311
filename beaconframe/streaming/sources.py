"""Streams of calls, and running a stream over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import KINDS, epoch_ms
from ..sources.shared import new_folder


def call_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as a stream of files: call_id, ts_ms, at (a timestamp), system_ref, talkgroup_ref, unit_ref, duration, k."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    ms = epoch_ms("ts")
    return raw.select(
        F.col("event_id").alias("call_id"), ms.alias("ts_ms"), F.timestamp_millis(ms).alias("at"), F.pmod("user_id", F.lit(8)).alias("system_ref"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).alias("talkgroup_ref"), F.col("user_id").alias("unit_ref"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def run_timed(stream: DataFrame) -> DataFrame:
    """`run_available` for operators with timers."""
    from .timers import rocks_store

    with rocks_store(stream.sparkSession):
        return run_available(stream)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all input there is, and return what it wrote."""
    spark = stream.sparkSession
    target = new_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out")
