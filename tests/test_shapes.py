"""Shapefiles written and read, and points in polygons against the rule edge by edge."""

import json
import random
import struct

from pyspark.sql import functions as F

from beaconframe.operators.geometry import points_in_rings
from beaconframe.sources import shapes

BOX = [(0.0, 0.0), (0.0, 1.0), (2.0, 1.0), (2.0, 0.0)]
WIDTHS = {"STATEFP": 2, "GEOID": 6, "NAME": 12}


def test_files(spark, tmp_path):
    made = [({"GEOID": "1", "STATEFP": "3", "NAME": "Émile"}, [BOX]), ({"GEOID": "", "STATEFP": "03"}, [BOX]), ({"GEOID": "2", "STATEFP": "39", "NAME": "x"}, [BOX[:3], [*BOX, (1.0, -1.0), BOX[0]]]), ({"GEOID": "3", "STATEFP": "39"}, [])]
    (tmp_path / "oh").mkdir()
    for name, some in (("oh/a", made), ("b", []), ("c.d", made[:1])):
        for kind, data in zip(("shp", "dbf"), shapes.write_shapes(some, WIDTHS)):
            (tmp_path / f"{name}.{kind}").write_bytes(data)
    (tmp_path / "alone.shp").write_bytes(b"")
    rows = shapes.boundaries(spark, str(tmp_path)).withColumn("json", shapes.geojson(F.col("ring"))).collect()
    got = {(r.stem.rsplit("/", 1)[1], r.geoid): r for r in rows}
    assert set(got) == {("a", "1"), ("a", "2"), ("c.d", "1")}
    r = got["a", "1"]
    assert (r.name, r.state, r.min_lat, r.max_lon, r.lat, r.lon) == ("Émile", "03", 0.0, 2.0, 0.5, 1.0)
    assert json.loads(r.json) == {"type": "Polygon", "coordinates": [[list(p) for p in [*BOX, BOX[0]]]]}
    assert len(got["a", "2"].ring) == 6 and got["a", "2"].min_lat == -1.0
    assert {r.geoid for r in shapes.boundaries(spark, str(tmp_path), "39").collect()} == {"2"}


def test_other_kinds_of_shape():
    heights = struct.pack("<i4dii", 15, 0, 0, 2, 1, 1, 4) + struct.pack("<i", 0) + struct.pack("<8d", *[v for p in BOX for v in p]) + b"\0" * 48
    assert shapes.largest_ring(memoryview(heights)).tolist() == [list(p) for p in [*BOX, BOX[0]]]
    assert shapes.largest_ring(memoryview(struct.pack("<i2d", 1, 0, 0))) is None and shapes.largest_ring(memoryview(b"")) is None


def inside(x, y, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            hit = not hit
    return hit


def test_points_in_rings(spark):
    rng = random.Random(8)
    rings = {}
    for i in range(30):
        x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
        ring = [(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for _ in range(rng.randint(3, 9))]  # they cross themselves
        rings[f"g{i}"] = [*ring, ring[0]]
    rings["box"] = [*BOX, BOX[0]]
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(500)] + [(900, 0.0, 0.0), (901, 1.0, 2.0), (902, 0.5, 2.0), (7, 0.5, 0.5), (7, 0.5, 0.5)]
    want = {(i, g) for i, lat, lon in points for g, ring in rings.items() if inside(lon, lat, ring)}
    frame = spark.createDataFrame([*points, (903, None, 0.0)], "id int, lat double, lon double")
    known = spark.createDataFrame([(g, [(float(x), float(y)) for x, y in ring]) for g, ring in rings.items()], "geoid string, ring array<struct<lon: double, lat: double>>")
    for cell in (0.05, 0.7, 10.0):
        got = [tuple(r) for r in points_in_rings(frame, known, cell).collect()]
        assert set(got) == want and len(got) == len(want)
    assert (900, "box") in want and (902, "box") not in want
    assert points_in_rings(frame.limit(0), known).count() == 0
