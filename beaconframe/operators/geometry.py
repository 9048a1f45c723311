"""Points in polygons as joins: cells find the candidates, strips of latitude the edges that a ray can cross."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_rings(points: DataFrame, shapes: DataFrame, cell: float = 0.05) -> DataFrame:
    """id, geoid of the points (id, lat, lon) inside shapes (geoid, ring of lon and lat).

    A shape's bounds are covered with cells of ``cell`` degrees, and a point meets only
    the shapes of its own cell; then it is inside where an odd number of edges lies to
    its east.  An edge is dealt to the strips of latitude that it passes, so a point
    meets no more edges than its strip has.  The south and west sides of a box belong
    to it, the north and east sides do not.  Equal points count once; null places are in nothing.
    """
    strip = lambda c: F.floor(c / cell)
    rings = shapes.select("geoid", "ring", *[f(f"ring.{side}").alias(f"{name}_{side}") for side in ("lon", "lat") for name, f in (("min", F.array_min), ("max", F.array_max))])
    bounds = ["min_lon", "max_lon", "min_lat", "max_lat"]
    cover = rings.select("geoid", *bounds, F.explode(F.sequence(strip(F.col("min_lon")), strip(F.col("max_lon")))).alias("x")).withColumn("y", F.explode(F.sequence(strip(F.col("min_lat")), strip(F.col("max_lat")))))
    placed = points.select("id", "lat", "lon").where("lat is not null and lon is not null").distinct().withColumn("x", strip(F.col("lon"))).withColumn("y", strip(F.col("lat")))
    near = placed.join(cover, ["x", "y"]).where("lon between min_lon and max_lon and lat between min_lat and max_lat").select("id", "lat", "lon", "geoid", "y")
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))
    edges = rings.select("geoid", F.explode(pairs).alias("e")).select("geoid", F.col("e.a.lon").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lon").alias("bx"), F.col("e.b.lat").alias("by")).where("ay <> by")
    edges = edges.withColumn("y", F.explode(F.sequence(strip(F.least("ay", "by")), strip(F.greatest("ay", "by")))))
    east = F.col("lon") < F.col("ax") + (F.col("lat") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = near.join(edges, ["geoid", "y"]).where(((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))) & east)
    return crossed.groupBy("id", "lat", "lon", "geoid").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id", "geoid")
