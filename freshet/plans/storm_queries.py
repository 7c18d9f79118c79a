"""Queries on design storms and model text; curves are literal, texts are made of rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyetograph
from ..operators import logs, network, params, transfer
from ..sources import sinks, text
from .registry import query, table

# --- storms ---

TYPES = ("I", "IA", "II", "III")
# Cumulative curve of type k at x = i / 24: S-curves of four steepnesses.
SQL_KNOTS = "(SELECT k, i, pow(i / 24.0, k + 1.5) / (pow(i / 24.0, k + 1.5) + pow(1 - i / 24.0, k + 1.5)) AS y FROM range(4) AS t(k), range(25) AS r(i))"
SQL_READ = f"WITH kn AS {SQL_KNOTS}, s AS (SELECT * FROM (SELECT p_partkey, p_retailprice / 100 AS depth, p_partkey % 4 AS own FROM part), range(49) AS r(i)), c AS (SELECT p_partkey, depth, own, s.i, a.k, a.y + (b.y - a.y) * (s.i % 2) / 2.0 AS y FROM s JOIN kn a ON a.i = s.i // 2 JOIN kn b ON b.k = a.k AND b.i = (s.i + 1) // 2)"
SQL_STORM = "round((y - coalesce(lag(y) OVER (PARTITION BY p_partkey, k ORDER BY i), 0)) * depth, 6) AS incremental_depth, round(y * depth, 6) AS cumulative_depth"


def type_curves(spark):
    x = F.col("i") / 24.0
    p = F.col("k") + 1.5
    rows = spark.range(4).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    return rows.select(F.element_at(F.array(*map(F.lit, TYPES)), (F.col("k") + 1).cast("int")).alias("curve"), x.alias("x"), (F.pow(x, p) / (F.pow(x, p) + F.pow(1 - x, p))).alias("y"))


def part_storms(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "p_partkey as storm_id", "p_retailprice / 100 as depth", "1440 as duration_min", "30 as interval_min")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"{SQL_READ} SELECT p_partkey AS storm_id, CAST(i AS INT) AS i, i / 2.0::DOUBLE AS hour, incremental_depth, cumulative_depth FROM (SELECT p_partkey, own, k, i, {SQL_STORM} FROM c) WHERE k = own")
def scs_storm(spark, sf):
    """A day under the type curve of each storm, every half hour."""
    s = part_storms(spark, sf).withColumn("curve", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("p_partkey") % 4 + 1).cast("int")))
    return rounded(hyetograph.cumulative_storm(s.drop("p_partkey"), type_curves(spark), "curve").select("storm_id", "i", "hour", "incremental_depth", "cumulative_depth"), "incremental_depth", "cumulative_depth")


@query(f"{SQL_READ} SELECT p_partkey AS storm_id, ['I', 'IA', 'II', 'III'][k + 1] AS curve, CAST(i AS INT) AS i, incremental_depth, cumulative_depth FROM (SELECT p_partkey, k, i, {SQL_STORM} FROM c WHERE p_partkey % 5 = 0)")
def scs_all_types(spark, sf):
    s = part_storms(spark, sf).where("p_partkey % 5 = 0").drop("p_partkey")
    return rounded(hyetograph.all_types(s, type_curves(spark), list(TYPES)).select("storm_id", "curve", "i", "incremental_depth", "cumulative_depth"), "incremental_depth", "cumulative_depth")


def distribution_files(spark, sf):
    """A distribution file for each nation: two quartiles, three probabilities, a line each two hours of a day."""
    n = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as file", "n_nationkey as n")
    hours = F.sequence(F.lit(0), F.lit(12))
    value = lambda q, p: (lambda h: F.round(100 * F.pow(h / 12.0, F.lit(q) + F.col("n") / 50.0 + p / 10.0), 4).cast("string"))
    line = lambda q: F.array_join(F.transform(hours, lambda h: F.concat_ws(",", (h * 2).cast("string"), *[value(q, p)(h) for p in range(3)])), "\n")
    part = lambda q, name: F.concat(F.lit(f"CUMULATIVE PERCENTAGES OF TOTAL PRECIPITATION FOR {name}\nhours,90%,50%,10%\n"), line(q))
    return n.select("file", F.concat(part(1, "FIRST-QUARTILE CASES,,"), F.lit("\n\n"), part(2, "SECOND-QUARTILE CASES,,")).alias("content"))


SQL_DISTRIBUTION = "(SELECT 'n' || n_nationkey AS file, n_nationkey AS n, q, p, h, ['90%', '50%', '10%'][p + 1] AS probability, ['FIRST-QUARTILE', 'SECOND-QUARTILE'][q] AS quartile, round(100 * pow(h / 12.0, q + n_nationkey / 50.0 + p / 10.0), 4) AS v FROM nation, range(1, 3) AS a(q), range(3) AS b(p), range(13) AS c(h))"


@query(f"SELECT file, quartile, h * 2.0::DOUBLE AS hours, probability, v AS cum_pct FROM {SQL_DISTRIBUTION}")
def temporal_distribution(spark, sf):
    return text.temporal_distributions(distribution_files(spark, sf))


@query(f"SELECT file AS storm_id, CAST(h AS INT) AS i, round((v - coalesce(lag(v) OVER (PARTITION BY file ORDER BY h), 0)) / 100 * (4 + n), 6) AS incremental_depth, round(v / 100 * (4 + n), 6) AS cumulative_depth FROM {SQL_DISTRIBUTION} WHERE q = 2 AND p = 1")
def distribution_storm(spark, sf):
    """A day of 4 + n inches under each file's second-quartile median curve, every two hours."""
    d = text.temporal_distributions(distribution_files(spark, sf)).where("quartile = 'SECOND-QUARTILE' and probability = '50%'")
    curves = d.select(F.col("file").alias("curve"), (F.col("hours") / 24).alias("x"), F.col("cum_pct").alias("y"))
    s = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as storm_id", "concat('n', n_nationkey) as curve", "4d + n_nationkey as depth", "1440 as duration_min", "120 as interval_min")
    return rounded(hyetograph.cumulative_storm(s, curves, "curve", scale=100.0).select("storm_id", "i", "incremental_depth", "cumulative_depth"), "incremental_depth", "cumulative_depth")


SQL_WEIGHTS = "(SELECT i, CASE WHEN i <= 8 THEN i + 1 ELSE 17 - i END / 65.0 AS w FROM range(12) AS r(i))"


@query(f"SELECT s_suppkey AS storm_id, CAST(i + 1 AS INT) AS i, (i + 1) * 0.5::DOUBLE AS hour, round(w * (s_suppkey % 9 + 1), 6) AS incremental_depth, round((s_suppkey % 9 + 1) * sum(w) OVER (PARTITION BY s_suppkey ORDER BY i), 6) AS cumulative_depth FROM supplier, {SQL_WEIGHTS} UNION ALL SELECT s_suppkey, 0, 0, 0, 0 FROM supplier")
def pattern_storm(spark, sf):
    """A pattern of twelve steps with its peak at 67 percent under each supplier's depth."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as storm_id", "s_suppkey % 9 + 1d as depth", "30 as interval_min", "67d as peak_pct")
    w = s.select("storm_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).withColumn("weight", F.expr("if(i <= 8, i + 1, 17 - i) / 65d"))
    return rounded(hyetograph.pattern_storm(s, w, 12), "incremental_depth", "cumulative_depth")


@query(
    """WITH w AS (SELECT j, CASE WHEN 2 * j <= 16 THEN 2 * j + 1 ELSE 33 - 2 * j END + CASE WHEN 2 * j + 1 <= 16 THEN 2 * j + 2 ELSE 32 - 2 * j END AS p FROM range(12) AS r(j)),
v AS (SELECT i, p / sum(p) OVER () AS v FROM (SELECT i, p FROM range(12) AS r(i) JOIN w ON j = least(i + 5, 11))),
d AS (SELECT s_suppkey, s_suppkey % 9 + 1 AS depth FROM supplier)
SELECT s_suppkey AS storm_id, CAST(i + 1 AS INT) AS i, (i + 1) * 0.5::DOUBLE AS hour, round(v * depth, 6) AS incremental_depth, round(depth * sum(v) OVER (PARTITION BY s_suppkey ORDER BY i), 6) AS cumulative_depth FROM d, v
UNION ALL SELECT s_suppkey, 0, 0.0, 0.0, 0.0 FROM d"""
)
def pattern_storm_shifted(spark, sf):
    """A pattern of 24 steps resampled to twelve, its peak moved from 67 to 33 percent."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as storm_id", "s_suppkey % 9 + 1d as depth", "30 as interval_min", "33d as peak_pct")
    w = s.select("storm_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i")).withColumn("weight", F.expr("if(i <= 16, i + 1, 33 - i) / 305d"))
    return rounded(hyetograph.pattern_storm(s, w, 12), "incremental_depth", "cumulative_depth")


SQL_EMPIRICAL = "(VALUES (0, 0.0), (20, 30.0), (40, 25.0), (60, 70.0), (80, 69.0), (100, 100.0)) AS t(x, y)"


@query(f"WITH e AS (SELECT x / 20 AS j, max(y) OVER (ORDER BY x) AS y FROM {SQL_EMPIRICAL}), s AS (SELECT s_suppkey, i, 2.0 + s_suppkey % 5 AS depth FROM supplier, range(11) AS r(i)), c AS (SELECT s_suppkey, s.i, depth * (a.y + (b.y - a.y) * (s.i % 2) / 2.0) / 100 AS c FROM s JOIN e a ON a.j = s.i // 2 JOIN e b ON b.j = (s.i + 1) // 2) SELECT s_suppkey AS storm_id, CAST(i AS INT) AS i, round(c - coalesce(lag(c) OVER (PARTITION BY s_suppkey ORDER BY i), 0), 6) AS incremental_depth, round(c, 6) AS cumulative_depth FROM c")
def empirical_storm(spark, sf):
    """A curve that falls twice, made monotone, read at every tenth of ten hours."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as storm_id", "'e' as curve", "2d + s_suppkey % 5 as depth", "600 as duration_min", "60 as interval_min")
    curve = spark.createDataFrame([("e", 20.0, 30.0), ("e", 40.0, 25.0), ("e", 60.0, 70.0), ("e", 80.0, 69.0)], "curve string, x double, y double")
    return rounded(hyetograph.empirical_storm(s, curve).select("storm_id", "i", "incremental_depth", "cumulative_depth"), "incremental_depth", "cumulative_depth")


DURATIONS = list(hyetograph.FREQUENCY_DURATIONS)


@query(f"WITH d AS (SELECT p_brand, {DURATIONS}[p_size % 8 + 1] AS duration, max(p_retailprice) AS depth FROM part WHERE p_size % 8 <> length(p_type) % 8 OR p_partkey % 3 > 0 GROUP BY 1, 2) SELECT b.p_brand, array_to_string(list(coalesce(CAST(round(depth, 2) AS DECIMAL(12, 2))::VARCHAR, '-') ORDER BY x.duration), ';') AS depths, count(*) FILTER (depth IS NULL) AS n_missing FROM (SELECT DISTINCT p_brand FROM d) b CROSS JOIN (SELECT unnest({DURATIONS}) AS duration) x LEFT JOIN d ON d.p_brand = b.p_brand AND d.duration = x.duration GROUP BY 1")
def frequency_vector(spark, sf):
    at = F.element_at(F.array(*map(F.lit, DURATIONS)), (F.col("p_size") % 8 + 1).cast("int"))
    d = table(spark, sf, "part").where("p_size % 8 <> length(p_type) % 8 or p_partkey % 3 > 0").groupBy("p_brand", at.alias("duration")).agg(F.max("p_retailprice").alias("depth"))
    out = hyetograph.frequency_vector(d, ["p_brand"])
    shown = F.array_join(F.transform("depths", lambda x: F.coalesce(F.round(x, 2).cast("decimal(12,2)").cast("string"), F.lit("-"))), ";")
    return out.select("p_brand", shown.alias("depths"), F.size("missing").cast("long").alias("n_missing"))


# --- model text ---


FILE, SQL_FILE = "concat(s_nationkey, '-', s_suppkey div 1000)", "s_nationkey || '-' || s_suppkey // 1000"


def basin_files(spark, sf):
    """Basin files of bounded size, one for a nation and a thousand of keys: suppliers as subbasins, every third one followed by a reach."""
    s = table(spark, sf, "supplier")
    line = lambda key, v: F.concat(F.lit(f"     {key}: "), v, F.lit("\n"))
    num = lambda e: F.expr(f"cast({e} as string)")
    loss = F.when(F.col("s_suppkey") % 2 == 0, F.concat(line("LossRate", F.lit("SCS")), line("Curve Number", num("60 + s_suppkey % 30")))).otherwise(F.concat(line("Loss", F.lit("Deficit")), line("Initial Deficit", num("s_suppkey % 7"))))
    sub = F.concat(
        F.lit("Subbasin: "), "s_name", F.lit("\n"), line("Area", num("s_suppkey % 50 + 0.5d")), line("Downstream", num("s_suppkey div 10")), line("Canvas X", num("s_suppkey * 1.5d")), line("Canvas Y", F.lit("north")),
        loss, line("Transform", F.lit("Clark")), line("Time of Concentration", num("s_suppkey % 4 + 0.25d")), line("Impervious Area", F.lit("2.0")), F.lit("End:\n"),
    )
    reach = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\nReach: R"), num("s_suppkey"), F.lit("\n     Downstream: none\nEnd:\n"))).otherwise("")
    each = s.select(F.expr(FILE).alias("file"), F.struct("s_suppkey", F.concat(sub, reach).alias("t")).alias("z"))
    return each.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("z")), lambda x: x["t"]), "\n").alias("content"))


def basin_blocks(spark, sf):
    return text.blocks(text.lines(basin_files(spark, sf)))


@query(f"SELECT {SQL_FILE} AS file, count(*) AS n_subbasins, count(*) FILTER (s_suppkey % 3 = 0) AS n_reaches, sum(s_suppkey % 50 + 0.5)::DOUBLE AS total_area, sum(s_suppkey % 50 + 2.5)::DOUBLE AS total_area_compat, CASE WHEN bool_or(s_suppkey % 2 = 0) THEN 'SCS' ELSE '' END AS loss_methods, 'Clark' AS transform_methods FROM supplier GROUP BY 1")
def basin_summary(spark, sf):
    return params.basin_summary(basin_blocks(spark, sf)).select("file", "n_subbasins", "n_reaches", "total_area", "total_area_compat", "loss_methods", "transform_methods")


@query(f"SELECT {SQL_FILE} AS file, s_name AS name, (s_suppkey % 50 + 0.5)::DOUBLE AS area, CAST(s_suppkey // 10 AS VARCHAR) AS downstream, CASE WHEN s_suppkey % 2 = 0 THEN 'SCS' ELSE 'Deficit' END AS loss_method, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey % 7.0 END::DOUBLE AS initial_deficit, CASE WHEN s_suppkey % 2 = 0 THEN 60.0 + s_suppkey % 30 END::DOUBLE AS curve_number, (s_suppkey % 4 + 0.25)::DOUBLE AS time_of_concentration, s_suppkey * 1.5::DOUBLE AS canvas_x, NULL::DOUBLE AS canvas_y, NULL::DOUBLE AS snyder_tp FROM supplier")
def subbasin_detail(spark, sf):
    return params.subbasin_detail(basin_blocks(spark, sf)).select("file", "name", "area", "downstream", "loss_method", "initial_deficit", "curve_number", "time_of_concentration", "canvas_x", "canvas_y", "snyder_tp")


@query("SELECT s_name AS name, s_acctbal AS balance, (s_suppkey % 50 + 0.5)::DOUBLE AS area, CAST(s_suppkey // 10 AS VARCHAR) AS downstream FROM supplier")
def geometry_parameters(spark, sf):
    """Shapes with an area of their own keep it; the parameters' other columns come along."""
    g = table(spark, sf, "supplier").selectExpr("s_name as name", "s_acctbal as balance", "s_suppkey % 50 + 0.5d as Area")
    return params.with_geometry(g, params.subbasin_detail(basin_blocks(spark, sf)), "name").selectExpr("name", "balance", "Area as area", "downstream")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS file, c_name AS subbasin, 'G' || c_custkey % 20 AS gage, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_custkey % 4 / 4.0 END::DOUBLE AS weight FROM customer")
def gage_assignments(spark, sf):
    c = table(spark, sf, "customer")
    one = F.concat(F.lit("Subbasin: "), "c_name", F.lit("\n     "), F.expr("if(c_custkey % 2 = 0, 'Gage', 'Precip Gage')"), F.lit(": G"), F.expr("cast(c_custkey % 20 as string)"), F.expr("if(c_custkey % 4 = 0, '', concat('\n     Gage Weight: ', cast(c_custkey % 4 / 4d as string)))"), F.lit("\nEnd:"))
    lines = c.select(F.col("c_nationkey").cast("string").alias("file"), "c_custkey", F.posexplode(F.split(one, "\n")).alias("p", "line")).select("file", (F.col("c_custkey") * 10 + F.col("p")).alias("pos"), "line")
    return text.gage_assignments(text.blocks(lines))


@query("SELECT 'G' || c_custkey AS gage FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 4 = 2")
def gage_filter(spark, sf):
    g = table(spark, sf, "customer").selectExpr("concat('G', c_custkey) as gage", "element_at(array('Flow', 'PRECIPITATION', 'stage'), cast(c_custkey % 3 + 1 as int)) as gage_type", "concat('F', c_custkey % 4, '.dss') as dss_file")
    return params.gages(g, "precipitation", "f2.DSS").select("gage")


@query("SELECT n_nationkey, n_name FROM nation")
def folded_sort(spark, sf):
    mixed = F.expr("if(n_nationkey % 2 = 0, lower(n_name), n_name)")
    out = params.folded_order(table(spark, sf, "nation").select("n_nationkey", mixed.alias("name")), "name")
    return out.select("n_nationkey", F.upper("name").alias("n_name"))


@query("SELECT 'n' || n_nationkey AS file, CAST(d AS INT) AS duration_row, CAST(a AS INT) AS ari_col, round(d * 2.5 + a + n_nationkey / 4.0, 2)::DOUBLE AS depth FROM nation, range(5) AS x(d), range(4) AS y(a)")
def point_frequencies(spark, sf):
    cell = lambda d, a: F.concat(F.lit("'"), F.round(d * 2.5 + a + F.col("n_nationkey") / 4.0, 2).cast("string"), F.lit("'"))
    row = lambda d: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: cell(d, a)), ", "), F.lit("]"))
    body = F.concat(F.lit("result = 'values';\nquantiles = ["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), row), ", "), F.lit("];\nupper = [[]];"))
    return text.point_frequencies(table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("file"), body.alias("content")))


@query("SELECT 'n' || n_nationkey AS file, CAST(d.m AS BIGINT) AS duration, CAST(a.y AS INT) AS ari, round(d.m / 10.0 + a.y + n_nationkey, 3)::DOUBLE AS depth FROM nation, (VALUES (5), (60), (1440)) AS d(m), (VALUES (1), (2), (10), (100)) AS a(y)")
def depth_duration_table(spark, sf):
    aris = [1, 2, 10, 100]
    line = lambda label, m: F.concat(F.lit(f"{label}:, "), F.concat_ws(", ", *[F.round(F.lit(m / 10.0 + y) + F.col("n_nationkey"), 3).cast("string") for y in aris]))
    body = F.concat_ws("\n", F.lit("Point depths"), F.lit("by duration for ARI (years):, " + ", ".join(map(str, aris))), line("5-min", 5), line("60-min", 60), line("24-hr", 1440))
    out = text.depth_table(table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("file"), body.alias("content")))
    return out.withColumn("duration", F.col("duration").cast("long")).withColumn("depth", F.round("depth", 3))


@query(f"SELECT {SQL_FILE} AS file, CAST(min(s_suppkey * 1.5) AS DOUBLE) AS x0, CAST(max(s_suppkey * 1.5) AS DOUBLE) AS x1, CAST(min(s_suppkey % 11 * 2.0) AS DOUBLE) AS y0, CAST(max(s_suppkey % 11 * 2.0) AS DOUBLE) AS y1 FROM supplier GROUP BY 1")
def element_bounds(spark, sf):
    s = table(spark, sf, "supplier")
    lines = s.select(F.expr(FILE).alias("file"), "s_suppkey", F.posexplode(F.array(F.concat(F.lit("Junction: "), "s_name"), F.expr("concat('     Canvas X: ', s_suppkey * 1.5d)"), F.expr("concat('     Canvas Y: ', s_suppkey % 11 * 2d)"), F.lit("End:"))).alias("p", "line"))
    files = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "p", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return text.bounds(text.element_points(files), ["file"])


@query("SELECT 'n' || n_nationkey AS file, s AS segment, CASE WHEN s % 2 = 0 THEN 'closed' ELSE 'open' END AS segment_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(p * 1.0 + s) AS DOUBLE) AS sx FROM nation, range(1, 4) AS x(s), range(5) AS y(p) GROUP BY 1, 2, 3")
def map_segments(spark, sf):
    seg = lambda s: F.concat(F.lit(f"MapSegment: {'closed' if s % 2 == 0 else 'open'}\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.concat((p * 1.0 + s).cast("string"), F.lit(", "), F.col("n_nationkey").cast("string"))), "\n"), F.lit("\nbroken, line\n"))
    files = table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("file"), F.concat(F.lit("MapGeo: BoundaryMap\n"), *[seg(s) for s in (1, 2, 3)]).alias("content"))
    return text.map_segments(files).groupBy("file", "segment", "segment_type").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


@query("SELECT 'n' || n_nationkey AS file, 'S' || s AS subbasin, CAST(count(*) AS BIGINT) AS n, CAST(sum(c * 0.5) AS DOUBLE) AS area FROM nation, range(3) AS x(s), range(4) AS y(c) GROUP BY 1, 2")
def hrap_cells(spark, sf):
    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.concat(F.lit("GRIDCELL: "), c.cast("string"), F.lit(" 7  1.25 "), (c * 0.5).cast("string"))), "\n")
    files = table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("file"), F.concat_ws("\n", *[F.concat(F.lit(f"SUBBASIN: S{s}\n"), cells, F.lit("\nEND:")) for s in range(3)]).alias("content"))
    return text.grid_cells(files).groupBy("file", "subbasin").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("SELECT s_suppkey, s_name, s_acctbal AS x, (s_suppkey % 90)::DOUBLE AS y FROM supplier")
def geojson_points(spark, sf):
    """Features written as GeoJSON and read again."""
    p = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name", "s_acctbal as x", "cast(s_suppkey % 90 as double) as y")
    shape = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<s_suppkey: int, s_name: string>"
    f = sinks.points_geojson(p, ["s_suppkey", "s_name"]).select(F.from_json("feature", shape).alias("f")).where("f.type = 'Feature' and f.geometry.type = 'Point'")
    kind = dict(p.dtypes)["s_suppkey"]
    return f.select(F.col("f.properties.s_suppkey").cast(kind).alias("s_suppkey"), "f.properties.s_name", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))


@query("SELECT user_id, 'P' || user_id % 10 AS project, '4.' || user_id % 8 AS from_version, '4.13' AS to_version FROM events WHERE event_id % 11 = 0 GROUP BY user_id")
def version_change(spark, sf):
    line = F.expr("if(event_id % 11 = 0, concat('WARNING 10021:  Project \"P', user_id % 10, '\" was updated from Version 4.', user_id % 8, ' to Version 4.13'), 'NOTE 1: Project')")
    return logs.version_changes(table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), line.alias("line")), ["user_id"])


@query("SELECT 'n' || n_nationkey AS file, 'Frequency Based' AS method, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 0.5 END::DOUBLE AS exceedance_frequency, CAST(1440 AS INT) AS total_duration, NULL::INT AS time_interval, n_nationkey % 2 = 0 AS convert_to_annual, FALSE AS convert_from_annual, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 4 = 1 END AS user_specified_storm_area, (n_nationkey * 3 + 3.0)::DOUBLE AS depth_total, CAST(3 AS BIGINT) AS n_depths FROM nation")
def frequency_parameters(spark, sf):
    n = lambda e: F.expr(f"cast({e} as string)")
    body = F.concat_ws(
        "\n", F.lit("Precip Method Parameters: Frequency Based"), F.concat(F.expr("if(n_nationkey % 2 = 0, '     Exceedence', '     Exceedance')"), F.lit(" Frequency: "), F.expr("if(n_nationkey % 3 > 0, cast(n_nationkey + 0.5d as string), '')")),
        F.lit("     Total Duration: 1440"), F.lit("     Time Interval: "), F.concat(F.lit("     Convert to Annual Series: "), F.expr("if(n_nationkey % 2 = 0, 'YES', 'No')")), F.concat(F.lit("     User Specified Storm Area: "), F.expr("case n_nationkey % 4 when 0 then '' when 1 then 'yes' else 'no' end")),
        *[F.concat(F.lit("     Depth: "), n(f"n_nationkey + {i}")) for i in range(3)], F.lit("     Depth: "), F.lit("End:"),
    )
    files = table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("file"), body.alias("content"))
    out = params.frequency_parameters(text.blocks(text.lines(files)))
    total = F.aggregate("depths", F.lit(0.0), lambda a, x: a + x)
    return out.select("file", "method", "exceedance_frequency", "total_duration", "time_interval", "convert_to_annual", "convert_from_annual", "user_specified_storm_area", total.alias("depth_total"), F.size("depths").cast("long").alias("n_depths"))


@query(f"SELECT '//TX/' || quartile || '/24HR//' || probability || '/' AS path, CAST(h AS INT) AS ord, h * 2.0::DOUBLE AS x, round(v / 100, 6)::DOUBLE AS y FROM {SQL_DISTRIBUTION} WHERE n = 3")
def temporal_import(spark, sf):
    rows = text.temporal_distributions(distribution_files(spark, sf).where("file = 'n3'"))
    return rounded(text.paired_distributions(rows, "TX", 24), "y")


# --- networks, transfers, features ---


@query("SELECT CAST(s_nationkey AS INT) AS n, sum(s_suppkey % 50 + 0.5)::DOUBLE AS subbasin_area, (s_nationkey * 10.0)::DOUBLE AS boundary_area, (sum(s_suppkey % 50 + 0.5) - s_nationkey * 10.0)::DOUBLE AS difference, round(CASE WHEN s_nationkey > 0 THEN (sum(s_suppkey % 50 + 0.5) - s_nationkey * 10.0) / (s_nationkey * 10.0) * 100 END::DOUBLE, 6) AS percent FROM supplier GROUP BY s_nationkey")
def area_closure(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("cast(s_nationkey as int) as n", "s_suppkey % 50 + 0.5d as area")
    b = s.select("n").distinct().select("n", (F.col("n") * 10.0).alias("area"))
    return rounded(network.area_closure(s, b, ["n"]), "percent")


@query("SELECT count(*) AS n_links, sum(c_custkey % 13 * 0.5)::DOUBLE AS length, CAST(max(c_custkey % 6) AS INT) AS max_order FROM customer")
def stream_totals(spark, sf):
    return network.max_order(table(spark, sf, "customer").selectExpr("c_custkey % 13 * 0.5d as length", "cast(c_custkey % 6 as int) as order"))


@query("SELECT c_nationkey AS n, arg_min(c_custkey, (-(c_custkey % 4), -(c_custkey % 17), c_custkey)) AS idx FROM customer GROUP BY 1")
def farthest_outlet(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_nationkey as n", "c_custkey as idx", "cast(c_custkey % 4 as int) as order", "cast(c_custkey % 17 as double) as distance")
    return network.nearest_outlet(c, ["n"], farthest=True).select("n", "idx")


@query("WITH r AS (SELECT l_suppkey AS subbasin, l_linenumber AS step, round(sum(l_quantity * (CASE WHEN l_orderkey % 7 = 0 THEN 0.25 ELSE 0.0 END)), 4) AS residual FROM lineitem GROUP BY 1, 2) SELECT subbasin, arg_min(step, (-abs(residual), step)) AS step, arg_min(residual, (-abs(residual), step)) AS residual FROM r GROUP BY 1")
def largest_step_residual(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("l_suppkey as subbasin", "l_linenumber as step", "l_quantity as source", "l_quantity + if(l_orderkey % 7 = 0, l_quantity * 0.25, 0) as target")
    return rounded(transfer.largest_step_residual(p), "residual")


@query(
    """WITH u AS (SELECT vec_id % 8 AS g, label % 3 AS id, vec_id // 8 % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT g, id, side, pos, avg(v) AS v FROM u GROUP BY ALL), c AS (SELECT a.g, a.id AS a, b.id AS b, avg(pow(a.v - b.v, 2)) AS cost FROM m a JOIN m b USING (g, pos) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
p AS (SELECT * FROM (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)) AS p(k, x, y, z)),
t AS (SELECT g, k, sum(cost) AS total FROM c JOIN p ON b = CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END GROUP BY ALL), best AS (SELECT g, arg_min(k, total) AS k FROM t GROUP BY g)
SELECT g, a AS a_id, b AS b_id, round(cost, 6) AS cost FROM c JOIN best USING (g) JOIN p USING (k) WHERE b = CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END"""
)
def fingerprint_assignment(spark, sf):
    """Least total cost one-to-one assignment within each of eight records; a record is a group."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 8).alias("g"), (F.col("label") % 3).alias("id"), F.expr("vec_id div 8 % 2").alias("side"), F.posexplode("embedding").alias("pos", "value"))
    m = e.groupBy("g", "id", "side", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    out = transfer.assign(transfer.fingerprint_cost(m.where("side = 0").drop("side"), m.where("side = 1").drop("side"), ["g"]), ["g"])
    return rounded(out, "cost")
