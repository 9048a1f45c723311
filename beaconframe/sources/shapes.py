"""Boundary shapefiles: polygons (.shp) and their attributes (.dbf), read side by side.

Files come through Spark's binary reader, so they may lie in any store that Spark
reads, and each pair is one task; boundary files are cut by state and layer, so
many pairs make many tasks.  With a state filter, other states' geometry is never
decoded.  Records without an id or a polygon are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

#: Shape types with rings: plain, with heights, with measures.
POLYGONS = (5, 15, 25)
SCHEMA = "stem string, geoid string, name string, state string, min_lat double, min_lon double, max_lat double, max_lon double, lat double, lon double, ring array<struct<lon: double, lat: double>>"


def state_code(text: str) -> str:
    text = text.strip()
    return text.zfill(2) if len(text) == 1 else text


def attributes(dbf: bytes) -> list[dict[str, str]]:
    """A row of texts, by upper-case name, for each record."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at, place = [], 32, 1
    while at + 32 <= head and dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1").upper(), place, dbf[at + 16]))
        place, at = place + dbf[at + 16], at + 32

    def text(raw: bytes) -> str:
        try:
            return raw.decode().strip(" \0")
        except UnicodeDecodeError:
            return raw.decode("latin-1").strip(" \0")

    return [{name: text(dbf[start + p : start + p + width]) for name, p, width in fields} for start in range(head, head + n * size, size)]


def polygons(shp: bytes) -> Iterator[memoryview]:
    """The content of each record, in the order of the attributes."""
    at, view = 100, memoryview(shp)
    while at + 8 <= len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        yield view[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words


def largest_ring(record: memoryview) -> np.ndarray | None:
    """The ring with most points, closed; None without a polygon."""
    if len(record) < 44 or struct.unpack_from("<i", record)[0] not in POLYGONS:
        return None
    parts, points = struct.unpack_from("<ii", record, 36)
    starts = np.frombuffer(record, "<i4", parts, 44).tolist() or [0]
    xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    rings = []
    for a, b in zip(starts, [*starts[1:], points]):
        ring = xy[a:b]
        if len(ring) and (ring[0] != ring[-1]).any():
            ring = np.vstack([ring, ring[:1]])
        if len(ring) >= 4:
            rings.append(ring)
    return max(rings, key=len, default=None)


def features(files: DataFrame, state: str | None = None) -> DataFrame:
    """The SCHEMA's columns for the pairs in ``files`` (stem, shp, dbf); only those of ``state`` if one is given.

    The place of a boundary is the middle of its bounds.  Pairs with a missing side give nothing.
    """
    ship(files.sparkSession)
    wanted = state_code(state) if state else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, shp, dbf in zip(*(batch.column(c).to_pylist() for c in ("stem", "shp", "dbf"))):
                rows, rings = [], []
                for record, about in zip(polygons(shp), attributes(dbf)) if shp and dbf else ():
                    geoid, of = about.get("GEOID") or about.get("GEOID20"), state_code(about.get("STATEFP", ""))
                    if not geoid or wanted and of != wanted or (ring := largest_ring(record)) is None:
                        continue
                    (x0, y0), (x1, y1) = ring.min(0).tolist(), ring.max(0).tolist()
                    rows.append((stem, geoid, about.get("NAMELSAD") or about.get("NAME", ""), of, y0, x0, y1, x1, (y0 + y1) / 2, (x0 + x1) / 2))
                    rings.append(ring)
                if rows:
                    flat = np.concatenate(rings)
                    points = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["lon", "lat"])
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), points)
                    names = [c.split()[0] for c in SCHEMA.split(", ring")[0].split(", ")]
                    yield pa.record_batch([*[pa.array(c) for c in zip(*rows)], lists], names=[*names, "ring"])

    return files.select("stem", "shp", "dbf").mapInArrow(run, SCHEMA)


def boundaries(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """`features` of all shapefiles below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    side = lambda kind: read.option("pathGlobFilter", f"*.{kind}").load(path).select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.col("content").alias(kind))
    return features(side("shp").join(side("dbf"), "stem"), state)


def geojson(ring: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))


def write_shapes(shapes: list[tuple[dict[str, str], list[list[tuple[float, float]]]]], widths: dict[str, int]) -> tuple[bytes, bytes]:
    """(.shp, .dbf) of (attributes, rings); ``widths``: the attributes and their bytes."""
    records = []
    for i, (_, rings) in enumerate(shapes, 1):
        points = [p for ring in rings for p in ring]
        starts = np.cumsum([0, *map(len, rings)])[:-1]
        xs, ys = zip(*points) if points else ((), ())
        content = struct.pack("<i", 0) if not points else struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + np.array(starts, "<i4").tobytes() + np.array(points, "<f8").tobytes()
        records.append(struct.pack(">II", i, len(content) // 2) + content)
    body = b"".join(records)
    shp = struct.pack(">I5II", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<II8d", 1000, 5, *[0.0] * 8) + body
    fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for name, width in widths.items())
    rows = b"".join(b" " + b"".join(about.get(name, "").encode()[:width].ljust(width) for name, width in widths.items()) for about, _ in shapes)
    return shp, struct.pack("<4BIHH20x", 3, 124, 1, 1, len(shapes), 33 + len(fields), 1 + sum(widths.values())) + fields + b"\r" + rows
