"""GeoJSON polygons and lines to attribute and edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

_GEOMETRY = "struct<type:string,coordinates:string>"


def read_features(spark, path, properties, line_delimited=False):
    """``(feature_id, properties..., kind, coordinates)``. ``properties`` is a DDL string.

    A feature collection is one JSON value per file; the line-delimited form (one feature per
    line) is splittable and is the one to use for large sets.
    """
    feature = f"struct<properties:struct<{properties}>,geometry:{_GEOMETRY}>"
    if line_delimited:
        raw = spark.read.schema(f"properties struct<{properties}>, geometry {_GEOMETRY}").json(path)
    else:
        raw = (spark.read.schema(f"features array<{feature}>").option("multiLine", "true")
               .json(path).select(F.explode("features").alias("f"))
               .select("f.properties", "f.geometry"))
    return raw.select("properties.*", F.col("geometry.type").alias("kind"),
                      F.col("geometry.coordinates").alias("coordinates"))


def _rings(features, key):
    """One row per ring or line, numbered within its feature."""
    parsed = features.select(
        key, F.when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json(
            "coordinates", "array<array<array<array<double>>>>")))
        .when(F.col("kind").isin("Polygon", "MultiLineString"), F.from_json(
            "coordinates", "array<array<array<double>>>"))
        .when(F.col("kind") == "LineString", F.array(F.from_json(
            "coordinates", "array<array<double>>"))).alias("rings"))
    return parsed.select(key, F.posexplode("rings").alias("ring", "points"))


def _pairs(rings, key):
    last = F.size("points") - 1
    step = F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: i < last)
    ends = F.transform(step, lambda i: F.struct(
        i.alias("seq"), F.get(F.get("points", i), F.lit(0)).alias("x1"),
        F.get(F.get("points", i), F.lit(1)).alias("y1"),
        F.get(F.get("points", i + 1), F.lit(0)).alias("x2"),
        F.get(F.get("points", i + 1), F.lit(1)).alias("y2")))
    return rings.select(key, "ring", F.inline(ends))


def polygon_edges(features, key):
    """``(key, ring, seq, x1, y1, x2, y2)``; an open ring is closed."""
    closed = _rings(features, key).withColumn("points", F.when(
        F.get("points", F.lit(0)) != F.element_at("points", -1),
        F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points")))
    return _pairs(closed, key)


def line_segments(features, key):
    return _pairs(_rings(features, key), key)


def edge_bounds(edges, key):
    """Bounding box of each polygon."""
    return edges.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"))
