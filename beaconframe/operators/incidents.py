"""From transcripts to incidents: what is said, where, and whether that makes a record to map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.locations import FIELDS, Gazetteer, locations
from .stats import CATEGORIES, category_number


def processed(transcripts: DataFrame, known: Gazetteer) -> DataFrame:
    """call_id, status, the location's fields, category and notes: one row for each row of ``transcripts`` (call_id, transcript), whose ids are different.

    status: skipped for a blank or null transcript, ok for one with an address that no
    guard rejects, failed for the others.  A failed transcript keeps its text, in upper
    case, as notes and has no address, so that it can be tried again; what was found
    beside the address stays.
    """
    found = locations(transcripts, known)
    rows = transcripts.select("call_id", "transcript").join(found, "call_id", "left")
    blank = F.coalesce(F.trim(F.regexp_replace("transcript", r"\s+", " ")), F.lit("")) == ""
    good = F.col("address").isNotNull() & F.col("rejected").isNull()
    status = F.when(blank, "skipped").when(good, "ok").otherwise("failed")
    name = F.try_element_at(F.array(*[F.lit(c[0]) for c in CATEGORIES]), category_number(F.lower("transcript")))
    return rows.select(
        "call_id",
        status.alias("status"),
        *[F.when(good, F.col(f)).alias(f) if f == "address" else F.col(f) for f in FIELDS],
        F.when(~blank, name).alias("category"),
        F.when(status == "failed", F.upper("transcript")).alias("notes"),
    )


def new_incidents(saved: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` that are ok and whose call has no incident in ``saved`` yet: call_id, address, category."""
    return found.where("status = 'ok'").select("call_id", "address", "category").join(saved.select("call_id"), "call_id", "left_anti")
