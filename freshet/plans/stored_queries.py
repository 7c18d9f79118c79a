"""Queries on tables that are written, checked and read back, on documents, and on a table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import overlay
from ..operators.network import shared_folder
from ..sources import documents, sinks, tables
from ..streaming import series as streams
from .geometry_queries import CUSTOMER, frames, shapes
from .registry import query, table


def scratch(spark) -> str:
    """A new folder that all machines share."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4()}"


def hourly(spark, sf):
    """Orders as ten hourly series."""
    o = table(spark, sf, "orders")
    return o.selectExpr("concat('/A/B', o_orderkey % 10, '/FLOW//1HOUR/R/') as path", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(o_orderkey div 10 as int), 0, 0) as ts", "o_totalprice as value")


SQL_HOURLY = "SELECT '/A/B' || o_orderkey % 10 || '/FLOW//1HOUR/R/' AS path, TIMESTAMP '2024-01-01' + INTERVAL 1 hour * (o_orderkey // 10) AS ts, o_totalprice AS value FROM orders"
START, END = "2024-01-02 05:00:00", "2024-01-05 11:00:00"


@query(f"SELECT * FROM ({SQL_HOURLY}) WHERE path IN ('/A/B3/FLOW//1HOUR/R/', '/A/B7/FLOW//1HOUR/R/') AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def stored_series(spark, sf):
    """Two of ten stored series within a window."""
    at = scratch(spark)
    sinks.write_series(hourly(spark, sf), at)
    return tables.read_series(spark, at, ["/A/B3/FLOW//1HOUR/R/", "/A/B7/FLOW//1HOUR/R/"], START, END).select("path", "ts", "value")


@query("SELECT '/A/S3/STAGE-FLOW///T/' AS path, p_partkey // 10 AS ord, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_partkey % 10 = 3")
def stored_paired(spark, sf):
    """One of ten stored curves."""
    at = scratch(spark)
    sinks.write_paired(table(spark, sf, "part").selectExpr("concat('/A/S', p_partkey % 10, '/STAGE-FLOW///T/') as path", "p_partkey div 10 as ord", "double(p_size) as x", "p_retailprice as y"), at)
    return tables.read_paired(spark, at, "/A/S3/STAGE-FLOW///T/").select("path", "ord", "x", "y")


@query("SELECT c_custkey // 100 AS t, c_custkey // 10 % 10 AS \"row\", c_custkey % 10 AS col, c_acctbal AS value FROM customer WHERE c_custkey % 10 BETWEEN 2 AND 6 AND c_custkey // 10 % 10 BETWEEN 1 AND 8 AND c_custkey // 100 BETWEEN 1 AND 9")
def stored_grid(spark, sf):
    """A window of a stored grid of 10 x 10 cells by step: columns 2 to 6, rows 1 to 8, steps 1 to 9."""
    at = scratch(spark)
    sinks.write_grid(table(spark, sf, "customer").selectExpr("c_custkey div 100 as t", "c_custkey div 10 % 10 as row", "c_custkey % 10 as col", "c_acctbal as value"), at)
    return tables.read_grid(spark, at, (2, 1, 6, 8), 1, 9).select(F.col("t").cast("long").alias("t"), "row", "col", "value")


@query("SELECT 'E' || l_suppkey AS element, l_returnflag AS variable, count(*) AS n, max(l_extendedprice) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey IN (1, 4) GROUP BY ALL")
def landed_results(spark, sf):
    """Rows and peak of two variables at two elements of landed results."""
    at = scratch(spark)
    rows = table(spark, sf, "lineitem").selectExpr("concat('E', l_suppkey) as element", "l_returnflag as variable", "l_shipdate as ts", "l_extendedprice as value")
    rows.write.parquet(f"{at}/results")
    return tables.read_results(spark, at, ["A", "R"], ["E1", "E4"]).groupBy("element", "variable").agg(F.count("*").alias("n"), F.max("value").alias("value"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer")
def csv_import(spark, sf):
    """A table exported as CSV and read back by its schema."""
    at = scratch(spark)
    sinks.write_csv(table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as value"), at)
    return sinks.read_csv(spark, at, "id long, name string, value double")


@query("SELECT true AS wrote, false AS again, true AS refused, count(*) AS n FROM supplier")
def idempotent_write(spark, sf):
    """A table written once: again the same is accepted, something else is refused and leaves it as it was."""
    at, s = scratch(spark), table(spark, sf, "supplier")
    wrote, again, refused = sinks.write_once(s, at), sinks.write_once(s.repartition(3), at), False
    try:
        sinks.write_once(s.withColumn("s_acctbal", F.col("s_acctbal") + 1), at)
    except sinks.Rejected:
        refused = True
    return spark.read.parquet(at).agg(F.lit(wrote).alias("wrote"), F.lit(again).alias("again"), F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS \"end\", count(*) AS \"rows\", CAST(10 AS BIGINT) AS series, CAST(4 AS BIGINT) AS qualified, CAST(0 AS BIGINT) AS problems FROM orders")
def product_package(spark, sf):
    """What the manifest of a published product says of its rows and series, and how many of its files fail their check."""
    at = scratch(spark)
    o = table(spark, sf, "orders").selectExpr("cast(o_orderdate as timestamp_ntz) as time", "o_orderkey as mapping_id", "o_totalprice as value", "o_orderkey % 10 as series")
    sinks.write_product(o, o.groupBy("series").agg(F.max("value").alias("peak")).withColumn("complete", F.col("series") % 3 == 0), at)
    shape = "time struct<start:string,end:string>, rows bigint, status struct<series:bigint,qualified:bigint>"
    said = spark.read.text(f"{at}/manifest").select(F.from_json("value", shape).alias("m")).select("m.time.start", "m.time.end", "m.rows", "m.status.series", "m.status.qualified")
    return said.join(sinks.product_problems(spark, at).agg(F.count("*").alias("problems")))  # a row each


@query("SELECT c_custkey AS id, round(CAST(2 * ((1 + c_custkey % 5 * 0.5) ** 2 - (c_custkey % 3 * 0.3) ** 2) AS DOUBLE), 6) AS area, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS rings FROM customer")
def feature_areas(spark, sf):
    """Areas of polygons with holes that come as GeoJSON documents of a hundred features."""
    v = frames(shapes(spark, sf, "customer", CUSTOMER))
    ring = v.groupBy("id", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("r"))
    polygon = ring.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", F.concat("r", F.slice("r", 1, 1)).alias("r")))), lambda p: p["r"]).alias("c"))
    each = polygon.select(F.expr("id div 100").alias("file"), sinks.feature("Polygon", F.col("c"), F.struct(F.col("id").cast("string").alias("id"))).alias("f"))
    files = each.groupBy("file").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("content"))
    rows = documents.features(files).select(F.col("properties")["id"].cast("long").alias("file"), F.lit(0).alias("ord"), "geometry_type", "coordinates")
    got = documents.vertices(rows).drop("id").withColumnRenamed("file", "id")
    return overlay.areas(got).join(got.groupBy("id").agg(F.count_distinct("ring").cast("int").alias("rings")), "id").select("id", F.round("area", 6).alias("area"), "rings")


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, stream, mode):
    """What a stream gives when its source is read to the end; a batch that is run again replaces its own output."""
    at = scratch(spark)

    def put(batch, n):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS ts, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 hour, any_value(events.ts)) + INTERVAL 2 hour <= (SELECT max(ts) FROM events)")
def hourly_stream(spark, sf):
    """Hourly means of the events as a stream; hours that the watermark has not passed are not given."""
    out = drained(spark, streams.hourly_mean(events_stream(spark, sf), "event_type"), "append")
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("value"), "n")


@query("SELECT event_type, max(value) AS peak_value, count(*) AS n_values FROM events GROUP BY 1")
def running_peak_stream(spark, sf):
    """Largest value of each kind of event after the whole stream."""
    return drained(spark, streams.running_peak(events_stream(spark, sf), "event_type"), "complete")
