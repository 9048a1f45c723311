"""Shared helpers of the text operators.

Every operator works on a frame with at least ``doc_id`` (any type that casts to
long) and ``text`` (string).  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, ship

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
#: Texts handed on at once within a worker, in characters; bounds a worker's memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the written table.

    This cuts the lineage: later actions reread the table and a lost executor
    costs no recomputation.  The files go when the session's JVM ends.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slim(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text only, null texts as empty ones; workers can then import this package."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about SLICE_CHARS characters, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


#: A key of more than one in so many rows is hot; there are no more hot keys than this.
HOT_SHARE = 2_000


def hot_join(rows: DataFrame, keys: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys``, one row for each key with how many of the ``total`` rows have it (``weight``): hot keys by broadcast, HOT_SHARE rows at most, so none of them meets in one task."""
    hot = F.col(weight) > F.lit(total // HOT_SHARE)
    return rows.join(keys.where(~hot), on).unionByName(rows.join(F.broadcast(keys.where(hot)), on))


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than SPACES, without a Python worker."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``docs`` as one column `row`, beside ``more``: no column of theirs can clash with ours."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def named(column: str, of: str = "") -> Column:
    """A column by its exact name, whatever characters that has."""
    quoted = column.replace("`", "``")
    return F.col(f"{of}.`{quoted}`" if of else f"`{quoted}`").alias(column)


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of packed rows again; those in ``changed`` are replaced."""
    return [changed[c].alias(c) if c in changed else named(c, "row") for c in columns]
