"""Locations in whole transcripts (F30 to F33): documents with a dispatcher's sentence put in at a place of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import address, locations
from ..operators import incidents
from ..sources.adapters import table
from ..sources.shared import ship, sliced, written
from .mentions import planted
from .registry import query

STREETS = ["WESTBROOK DRIVE", "BUSHNELL CAMPBELL ROAD", "LEMOYNE AVENUE", "KIRK ROAD", "NORTH HAZELWOOD AVENUE", "GIBSON STREET", "MCGUFFEY ROAD"]
PLACES = ["WICKLIFFE FIREHOUSE", "VALLEY VIEW MANOR KENNEL"]
KNOWN = locations.Gazetteer(tuple(STREETS), tuple(PLACES))


@query(
    "f30_location_screen",
    rf"""SELECT doc_id AS call_id, regexp_matches(up, '\b(?:{address.TYPES})\b') OR regexp_matches(up, '{address.ROUTES}') OR regexp_matches(up, '{address.HINTS}') OR regexp_matches(up, '\b\d{{2,6}} [A-Z]{{3,}}') AS located
 FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS up FROM documents)""",
)
def f30(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), address.may_have_location(F.col("text")).alias("located"))


def _street(step: int, bare: bool = False):
    names = [s.rsplit(" ", 1)[0] if bare else s for s in STREETS]
    return F.lower(F.element_at(F.array(*[F.lit(s) for s in names]), ((F.col("doc_id") + step) % len(names)).cast("int") + 1))


def _number():
    return (F.col("doc_id") % 8000 + 1000).cast("string")


def said():
    n = F.col("doc_id") % 6
    kinds = [
        F.concat(F.lit("respond to "), _number(), F.lit(" "), _street(0), F.lit(" apartment 4b.")),
        F.concat(_number(), F.lit(" "), _street(0, True), F.lit(" crosses of "), _street(1, True), F.lit(" and "), _street(2), F.lit(" for a fall.")),
        F.concat(_street(0), F.lit(" and "), _street(1, True), F.lit(" for a crash.")),
        F.concat(_number(), F.lit(" state route 88 between "), _street(0), F.lit(" and "), _street(1), F.lit(".")),
        F.concat(F.lit("call at the wickliffe firehouse, room 12.")),
        F.concat(F.lit("off of "), _street(0), F.lit(", smoke.")),
    ]
    out = F.when(n == 0, kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        out = out.when(n == i, k)
    return out


NAMES = "STRUCT_PACK(s := [" + ", ".join(f"'{s}'" for s in STREETS) + "])"
SAID_SQL = f"""d AS (SELECT doc_id AS call_id, CAST(doc_id % 8000 + 1000 AS VARCHAR) AS number, doc_id % 6 AS kind, {NAMES}.s AS s FROM documents),
 p AS (SELECT call_id, number, kind, list_extract(s, CAST(call_id % 7 AS INT) + 1) AS a, list_extract(s, CAST((call_id + 1) % 7 AS INT) + 1) AS b, list_extract(s, CAST((call_id + 2) % 7 AS INT) + 1) AS c FROM d)"""


@query(
    "f31_rule_extraction",
    f"""WITH {SAID_SQL} SELECT call_id, CASE kind WHEN 0 THEN number || ' ' || a WHEN 1 THEN number || ' ' || a WHEN 2 THEN a || ' & ' || b WHEN 3 THEN number || ' SR 88' WHEN 5 THEN a END AS address,
 CASE kind WHEN 1 THEN b WHEN 3 THEN a END AS cross_1, CASE kind WHEN 1 THEN c WHEN 3 THEN b END AS cross_2, CASE kind WHEN 0 THEN 'APARTMENT 4B' WHEN 4 THEN 'ROOM 12' END AS apartment, CASE kind WHEN 4 THEN 'WICKLIFFE FIREHOUSE' END AS place FROM p""",
)
def f31(spark, sf):
    """Street names without their type are completed from the gazetteer."""
    return locations.locations(planted(spark, sf, said()), KNOWN).select("call_id", *locations.FIELDS)


def doubtful():
    """Numbers before or near a street, most of them no house numbers."""
    n, small, street = F.col("doc_id") % 7, (F.col("doc_id") % 90 + 10).cast("string"), _street(0, True)
    kinds = [
        F.concat(_number(), F.lit(" "), street, F.lit(".")),
        F.concat(small, F.lit(" "), street, F.lit(", "), small, F.lit("-year-old male.")),
        F.concat(F.lit("engine "), small, F.lit(" "), street, F.lit(".")),
        F.concat(F.lit("time "), _number(), F.lit(" "), street, F.lit(".")),
        F.concat(F.lit("pulse of "), small, F.lit(" "), street, F.lit(".")),
        F.concat(street, F.lit(" and "), _street(1, True), F.lit(", disregard.")),
        F.concat(F.lit("plate number abc "), _number(), F.lit(" "), street, F.lit(".")),
    ]
    out = F.when(n == 0, kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        out = out.when(n == i, k)
    return out


@query(
    "f32_address_guards",
    f"""WITH {SAID_SQL} SELECT call_id, CASE WHEN call_id % 7 = 5 THEN a || ' & ' || b WHEN call_id % 7 IN (0, 3, 6) THEN number || ' ' || a ELSE (call_id % 90 + 10) || ' ' || a END AS address,
 CASE call_id % 7 WHEN 2 THEN 'unit' WHEN 3 THEN 'time' WHEN 4 THEN 'vitals' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'plate' WHEN 1 THEN (CASE WHEN len(string_split(a, ' ')) > 1 THEN NULL END) END AS rejected FROM p""",
)
def f32(spark, sf):
    """What the extractor finds for an address, and why it is none; null: it is kept."""
    return locations.locations(planted(spark, sf, doubtful()), KNOWN).where("address is not null").select("call_id", "address", "rejected")


SHAPES = """CASE c_custkey % 7 WHEN 0 THEN c_custkey || ' ' || c_mktsegment || ' RD' WHEN 1 THEN 'YEAH ' || c_name WHEN 2 THEN left(c_mktsegment, 3) || ' ' || (c_custkey % 9000 + 100) WHEN 3 THEN 'MEDIC ' || c_custkey WHEN 4 THEN c_mktsegment || ' ' || c_mktsegment || ' ' || c_mktsegment WHEN 5 THEN left(c_mktsegment, 2) ELSE c_name END"""


@query(
    "f33_implausible_addresses",
    rf"""WITH a AS (SELECT c_custkey AS id, {SHAPES} AS address FROM customer), u AS (SELECT *, upper(address) AS up, string_split(upper(address), ' ') AS w FROM a)
 SELECT id, address, regexp_matches(up, '{address.NOISE}') AS noise, regexp_matches(up, '^[A-Z]{{2,3}}[ -]?\d{{3,4}}$|^\d{{3,4}}[ -]?[A-Z]{{2,3}}$') AS plate, regexp_matches(up, '^\W*{address.UNIT_WORDS}\W+\d{{1,4}}\W*$') AS unit,
 length(trim(address)) < 3 OR NOT regexp_matches(up, '[A-Z]') OR (len(w) = 3 AND w[1] = w[2] AND w[2] = w[3]) AS malformed FROM u""",
)
def f33(spark, sf):
    kind = F.expr(SHAPES)
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), kind.alias("address"))
    tests = {"noise": address.is_noise, "plate": address.is_plate, "unit": address.is_unit, "malformed": address.is_malformed}
    return a.select("id", "address", *[test(F.col("address")).alias(name) for name, test in tests.items()])


# The pipeline: every eleventh transcript is blank, and a sentence without an address fails.
STATUS_SQL = f"""{SAID_SQL}, g AS (SELECT *, CASE WHEN call_id % 11 = 0 THEN 'skipped' WHEN kind = 4 THEN 'failed' ELSE 'ok' END AS status,
 CASE kind WHEN 0 THEN number || ' ' || a WHEN 1 THEN number || ' ' || a WHEN 2 THEN a || ' & ' || b WHEN 3 THEN number || ' SR 88' WHEN 5 THEN a END AS said FROM p)"""


def incident_rows(spark, sf):
    whole = planted(spark, sf, said())
    blank = F.when(F.col("call_id") % 11 == 0, " \n ").otherwise(F.col("transcript"))
    return incidents.processed(whole.withColumn("transcript", blank), KNOWN)


@query("g01_incident_status", f"WITH {STATUS_SQL} SELECT call_id, status, CASE WHEN status = 'ok' THEN said END AS address FROM g")
def g01(spark, sf):
    return incident_rows(spark, sf).select("call_id", "status", "address")


@query("g03_fallback_records", f"WITH {STATUS_SQL} SELECT call_id, CAST(NULL AS VARCHAR) AS address, 'WICKLIFFE FIREHOUSE' AS place, 'ROOM 12' AS apartment, TRUE AS has_notes FROM g WHERE status = 'failed'")
def g03(spark, sf):
    return incident_rows(spark, sf).where("status = 'failed'").select("call_id", "address", "place", "apartment", (F.length("notes") > 0).alias("has_notes"))


@query("g09_saved_incidents", f"WITH {STATUS_SQL} SELECT call_id, said AS address FROM g WHERE status = 'ok'")
def g09(spark, sf):
    """Saved in two runs: what the first one has is not saved again."""
    found = written(incident_rows(spark, sf).select("call_id", "status", "address", "category"))
    first = written(found.where("status = 'ok' and address like '% & %'").select("call_id", "address", "category"))
    return first.unionByName(incidents.new_incidents(first, found)).select("call_id", "address")


UPPER_SQL = "d AS (SELECT doc_id AS call_id, replace(upper(replace(text, 'ß', chr(1))), chr(1), 'SS') AS up, doc_id * 37 % (length(text) + 1) AS place, left(text, CAST(doc_id * 37 % (length(text) + 1) AS INT)) AS lhs, substr(text, doc_id * 37 % (length(text) + 1) + 1) AS rhs FROM documents), u AS (SELECT call_id, replace(upper(replace(lhs, 'ß', chr(1))), chr(1), 'SS') AS lhs, replace(upper(replace(rhs, 'ß', chr(1))), chr(1), 'SS') AS rhs FROM d)"


def _corrected(transcripts, pairs):
    ship(transcripts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            said = [address.corrected(t, pairs) for t in batch.column("transcript").to_pylist()]
            yield pa.record_batch([batch.column("call_id"), pa.array(said, pa.string())], names=["call_id", "said"])

    return transcripts.select(F.col("call_id").cast("bigint").alias("call_id"), F.upper("transcript").alias("transcript")).mapInArrow(run, "call_id bigint, said string")


@query("f28_guarded_corrections", f"WITH {UPPER_SQL} SELECT call_id, lhs || chr(10) || CASE WHEN call_id % 2 = 0 THEN 'FIRE AT LAKE SHORE DR' ELSE 'FIRE AT SHORE RD AND LAKE SHORE DR' END || chr(10) || rhs AS said FROM u")
def f28(spark, sf):
    """A mistake is mended, but not where the right words stand already."""
    sentence = F.when(F.col("doc_id") % 2 == 0, "fire at lake shork dr").otherwise("fire at shork rd and lake shore dr")
    return _corrected(planted(spark, sf, sentence), [("LAKE SHORK", "LAKE SHORE"), ("SHORK", "SHORE")])


@query("f29_one_way_corrections", f"WITH {UPPER_SQL} SELECT call_id, lhs || chr(10) || 'AT MAIN STREET' || chr(10) || rhs AS said FROM u")
def f29(spark, sf):
    """Corrections whose correct form holds the mistake are left out."""
    pairs = [(bad, good) for bad, good in (("MANE", "MAIN"), ("MAIN", "MAIN STREET")) if bad not in good]
    return _corrected(planted(spark, sf, F.lit("at mane street")), pairs)
