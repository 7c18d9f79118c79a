"""JSON documents with fixed shapes: portable series, forecast frames, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks

SERIES = "schema string, selector string, units string, data_type string, interval_minutes int, timestamps array<timestamp>, values array<double>"
SERIES_KEYS = ["schema", "selector", "units", "data_type", "interval_minutes", "timestamps", "values"]
FRAMES = (
    "source struct<domain:struct<grid:struct<shape:array<int>,cell_size:double,origin:array<double>,crs:string,row_order:string>>,times:array<timestamp>,interval_seconds:int,units:string,data_type:string,"
    "segments:array<struct<kind:string,first_frame:int,frame_count:int>>>, frames array<array<array<double>>>, mask array<array<boolean>>"
)


def portable_series(files: DataFrame) -> DataFrame:
    """(file, selector, units, data_type, interval_minutes, ts, value) of documents with exactly the contract's keys.

    A document with other keys, or with unequal numbers of stamps and values, gives one row with a problem instead.
    """
    doc = checks.closed_keys(files, "content", SERIES_KEYS).withColumn("d", F.from_json("content", SERIES))
    problem = F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.concat_ws(", ", "missing"))).when(F.size("unknown") > 0, F.concat(F.lit("unknown: "), F.concat_ws(", ", "unknown")))
    problem = problem.when(F.col("repeated"), "repeated keys").when(F.size("d.timestamps") != F.size("d.values"), "unequal lengths")
    doc = doc.withColumn("problem", problem)
    rows = F.when(F.col("problem").isNull(), F.arrays_zip(F.col("d.timestamps").alias("ts"), F.col("d.values").alias("value")))
    out = doc.select("file", "d.selector", "d.units", "d.data_type", "d.interval_minutes", "problem", F.explode_outer(rows).alias("z"))
    return out.select("file", "selector", "units", "data_type", "interval_minutes", "z.ts", "z.value", "problem")


def forecast_frames(files: DataFrame) -> DataFrame:
    """Long grid (file, kind, start, end, row, col, x, y, value) of the cells that the mask asks for; kind is the segment's.

    A frame spans two neighbouring times; x and y are cell centres, rows counted from the south.
    """
    d = files.select("file", F.from_json("content", FRAMES).alias("d")).select("file", "d.*")
    f = d.select("file", "source", "mask", F.posexplode("frames").alias("t", "frame")).select("file", "source", "mask", "t", F.posexplode("frame").alias("row", "cells"))
    f = f.select("file", "source", "mask", "t", "row", F.posexplode("cells").alias("col", "value")).where(F.get(F.get("mask", F.col("row")), F.col("col")))
    g = F.col("source.domain.grid")
    own = F.filter("source.segments", lambda s: (F.col("t") >= s["first_frame"]) & (F.col("t") < s["first_frame"] + s["frame_count"]))
    centre = lambda i, c: g["origin"][i] + (F.col(c) + 0.5) * g["cell_size"]
    times = F.col("source.times")
    return f.select("file", F.get(own, F.lit(0))["kind"].alias("kind"), F.get(times, F.col("t")).alias("start"), F.get(times, F.col("t") + 1).alias("end"), "row", "col", centre(0, "col").alias("x"), centre(1, "row").alias("y"), "value")


def features(files: DataFrame) -> DataFrame:
    """(file, ord, geometry_type, coordinates (JSON), properties (map of text)) of feature collections."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    rows = files.select("file", F.posexplode(F.from_json("content", shape)["features"]).alias("ord", "f"))
    return rows.select("file", "ord", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def vertices(feature_rows: DataFrame) -> DataFrame:
    """(file, id, part, ring, ord, x, y) of polygons, lines and points, single or multiple: ring 0 of a polygon's part is its
    outline, the others are holes; a line or a point is ring 0 of its part. Null and other geometries have no rows."""
    c, kind = F.col("coordinates"), F.col("geometry_type")
    point = "array<double>"
    deep = lambda n: f"{'array<' * n}{point}{'>' * n}"
    shape = (
        F.when(kind == "MultiPolygon", F.from_json(c, deep(3)))
        .when(kind == "Polygon", F.array(F.from_json(c, deep(2))))
        .when(kind == "MultiLineString", F.transform(F.from_json(c, deep(2)), lambda line: F.array(line)))
        .when(kind == "LineString", F.array(F.array(F.from_json(c, deep(1)))))
        .when(kind == "MultiPoint", F.transform(F.from_json(c, deep(1)), lambda p: F.array(F.array(p))))
        .when(kind == "Point", F.array(F.array(F.array(F.from_json(c, point)))))
    )
    rows = feature_rows.select("file", F.col("ord").alias("id"), F.posexplode(shape).alias("part", "_r"))
    rows = rows.select("file", "id", "part", F.posexplode("_r").alias("ring", "_p"))
    rows = rows.select("file", "id", "part", "ring", F.posexplode("_p").alias("ord", "p"))
    return rows.select("file", "id", "part", "ring", "ord", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
