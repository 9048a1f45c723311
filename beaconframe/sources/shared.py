"""What executors need from the driver: this package, and a folder that all of them see."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._package_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where the session names none, one of our own on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="frames-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A new folder name under ``shared_root``.  It goes with the session."""
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there, so that what comes after sees the same rows however often it is computed."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts handed on at once within a worker, in bytes; bounds a worker's memory.
SLICE_BYTES = 2_000_000


def sliced(batches: Iterator[pa.RecordBatch], column: str = "transcript") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        start, total = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if total and total + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if batch.num_rows:
            yield batch.slice(start)
