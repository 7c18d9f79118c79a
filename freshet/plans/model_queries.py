"""Queries on storms, reduction factors, networks, parameters, transfers, grids and logs, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hyetograph, units
from ..functions.interp import interpolate
from ..operators import arf, logs, network, params, transfer
from .registry import query, table

# --- storms ---

KNOTS = [(5, 0.91), (15, 2.06), (60, 3.78), (120, 5.02), (180, 5.9), (360, 7.4), (1440, 9.6)]
SQL_KNOTS = "(VALUES " + ", ".join(f"({a}.0, {b})" for a, b in KNOTS) + ") AS k(x, y)"
SQL_BRACKET = f"(SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM {SQL_KNOTS})"


def knots(spark):
    return spark.createDataFrame([("k", float(a), b) for a, b in KNOTS], "curve string, x double, y double")


@query(f"WITH p AS (SELECT p_partkey, CAST(p_size * 30 AS DOUBLE) AS x FROM part) SELECT p_partkey, x, round(CASE WHEN x <= 5 THEN 0.91 WHEN x >= 1440 THEN 9.6 ELSE exp(ln(y0) + (ln(x) - ln(x0)) / (ln(x1) - ln(x0)) * (ln(y1) - ln(y0))) END, 6) AS depth FROM p LEFT JOIN {SQL_BRACKET} ON x >= x0 AND x < x1")
def balanced_cumulative(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "'k' as curve", "cast(p_size * 30 as double) as x")
    return interpolate(p, knots(spark), "curve", scale="loglog", out="depth").select("p_partkey", "x", F.round("depth", 6).alias("depth"))


@query(f"WITH p AS (SELECT p_partkey, CAST(p_size * 30 AS DOUBLE) AS x FROM part) SELECT p_partkey, round(CASE WHEN x <= 5 THEN 0.91 WHEN x >= 1440 THEN 9.6 ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END, 6) AS depth FROM p LEFT JOIN {SQL_BRACKET} ON x >= x0 AND x < x1")
def bracket_interpolation(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "'k' as curve", "cast(p_size * 30 as double) as x")
    return interpolate(p, knots(spark), "curve", out="depth").select("p_partkey", F.round("depth", 6).alias("depth"))


@query("SELECT p_brand AS storm_id, i, round(i * 15 / 60.0, 6) AS hour, round(inc, 6) AS incremental_depth, round(sum(inc) OVER (PARTITION BY p_brand ORDER BY i), 6) AS cumulative_depth FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size / 10.0 AS inc FROM part)")
def hyetograph_frame(spark, sf):
    p = brand_pattern(spark, sf).withColumn("incremental_depth", F.col("weight") / 10.0)
    out = hyetograph.frame(p, 15)
    return out.withColumns({c: F.round(c, 6) for c in ("hour", "incremental_depth", "cumulative_depth")})


def brand_pattern(spark, sf):
    """Part sizes of each brand as an incremental pattern."""
    i = (F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i")
    return table(spark, sf, "part").select(F.col("p_brand").alias("storm_id"), i, F.col("p_size").cast("double").alias("weight"))


SQL_PATTERN = "p AS (SELECT p_brand AS storm_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, CAST(p_size AS DOUBLE) AS w, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query(f"""WITH {SQL_PATTERN}, k AS (SELECT storm_id, (i + 1) / n AS x, sum(w) OVER (PARTITION BY storm_id ORDER BY i) AS y FROM p UNION ALL SELECT DISTINCT storm_id, 0.0, 0.0 FROM p),
b AS (SELECT storm_id, x AS x0, y AS y0, lead(x) OVER v AS x1, lead(y) OVER v AS y1 FROM k WINDOW v AS (PARTITION BY storm_id ORDER BY x)),
q AS (SELECT storm_id, i, (i + 1) / 24.0 AS x FROM (SELECT DISTINCT storm_id FROM p), range(24) AS r(i)),
c AS (SELECT q.storm_id, q.i, CASE WHEN q.x >= 1 THEN (SELECT max(y) FROM k WHERE k.storm_id = q.storm_id) ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END AS cum FROM q LEFT JOIN b ON q.storm_id = b.storm_id AND q.x >= b.x0 AND q.x < b.x1),
d AS (SELECT *, cum - coalesce(lag(cum) OVER (PARTITION BY storm_id ORDER BY i), 0) AS inc FROM c)
SELECT storm_id, CAST(i AS INT) AS i, round(inc / sum(inc) OVER (PARTITION BY storm_id), 6) AS weight FROM d""")
def hyetograph_resample(spark, sf):
    return hyetograph.resample(brand_pattern(spark, sf), 24).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {SQL_PATTERN}, s AS (SELECT *, CAST(floor(0.25 * n) AS BIGINT) - first_value(i) OVER (PARTITION BY storm_id ORDER BY w DESC, i) AS s FROM p),
r AS (SELECT storm_id, ((i + s) % n + n) % n AS i, w, n, s FROM s), e AS (SELECT *, max(CASE WHEN i = CASE WHEN s > 0 THEN s ELSE n + s - 1 END THEN w END) OVER (PARTITION BY storm_id) AS edge FROM r),
f AS (SELECT storm_id, i, CASE WHEN s > 0 AND i < s OR s < 0 AND i >= n + s THEN edge ELSE w END AS w FROM e)
SELECT storm_id, CAST(i AS INT) AS i, round(w / sum(w) OVER (PARTITION BY storm_id), 6) AS weight FROM f""")
def peak_shift(spark, sf):
    return hyetograph.shift_peak(brand_pattern(spark, sf), 25.0).withColumn("weight", F.round("weight", 6))


@query(f"WITH {SQL_PATTERN}, c AS (SELECT storm_id, i, sum(w) OVER (PARTITION BY storm_id ORDER BY i) AS c FROM p) SELECT storm_id, CAST(i AS INT) AS i, round(c / 100.0 * 5 - coalesce(lag(c) OVER (PARTITION BY storm_id ORDER BY i) / 100.0 * 5, 0), 6) AS incremental_depth FROM c")
def cum_to_inc(spark, sf):
    run = F.sum("weight").over(W.partitionBy("storm_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    cum = brand_pattern(spark, sf).withColumn("cumulative", run)
    return hyetograph.increments(cum, scale=100.0, depth=5.0).select("storm_id", "i", F.round("incremental_depth", 6).alias("incremental_depth"))


@query("SELECT p_partkey, round(CASE WHEN f <= 0.4 THEN f * f / 0.4 ELSE -f * f / 0.6 + (2 * 0.4 / 0.6 + 2) * f - (0.4 * 0.4 / 0.6 + 0.4) END, 6) AS depth_fraction FROM (SELECT p_partkey, p_size / 50.0 AS f FROM part)")
def triangular(spark, sf):
    f = F.col("p_size") / 50.0
    return table(spark, sf, "part").select("p_partkey", F.round(hyetograph.triangular(f, F.lit(0.4)), 6).alias("depth_fraction"))


@query("SELECT p_partkey, round(CASE WHEN f <= 0 THEN 0 ELSE pow(f, 1.2) * exp(0.7 * (1 - f)) END, 6) AS depth_fraction FROM (SELECT p_partkey, p_size / 50.0 AS f FROM part)")
def lgamma(spark, sf):
    f = F.col("p_size") / 50.0
    return table(spark, sf, "part").select("p_partkey", F.round(hyetograph.l_gamma(f, F.lit(1.2), F.lit(0.7)), 6).alias("depth_fraction"))


@query("SELECT p_brand AS storm_id, p_partkey AS x, y, count(*) FILTER (y > p_size) OVER (PARTITION BY p_brand) AS adjusted, max(y - p_size) OVER (PARTITION BY p_brand) AS max_adjustment FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS y FROM part)")
def running_max(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_brand as storm_id", "p_partkey as x", "p_size as y")
    return hyetograph.monotone(p)


@query("""WITH RECURSIVE c AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, least(p_size - 1, greatest(0, CAST(floor((p_partkey % 5) * 0.2 * p_size + 1e-9) AS BIGINT))) AS p FROM part),
r AS (SELECT p_partkey, n, p, CAST(0 AS BIGINT) AS k, p AS place, p - 1 AS lo, p + 1 AS hi, true AS before FROM c
UNION ALL SELECT p_partkey, n, p, k + 1, CASE WHEN before THEN CASE WHEN lo >= 0 THEN lo ELSE hi END ELSE CASE WHEN hi < n THEN hi ELSE lo END END, CASE WHEN before AND lo >= 0 OR NOT before AND hi >= n THEN lo - 1 ELSE lo END, CASE WHEN before AND lo < 0 OR NOT before AND hi < n THEN hi + 1 ELSE hi END, NOT before FROM r WHERE k + 1 < n)
SELECT p_partkey, k, place FROM r""")
def alternating_blocks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n"), ((F.col("p_partkey") % 5) * 20).alias("pct"))
    rows = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), hyetograph.block_place(F.col("k"), F.col("n"), F.col("pct")).cast("long").alias("place"))


AREAL = "(VALUES " + ", ".join(f"({a}.0, {b})" for a, b in hyetograph.AREAL_LIMITS.items()) + ") AS k(x, y)"


@query(f"WITH k AS (SELECT ln(x) AS x0, ln(1 - y) AS y0, lead(ln(x)) OVER (ORDER BY x) AS x1, lead(ln(1 - y)) OVER (ORDER BY x) AS y1 FROM {AREAL}), p AS (SELECT p_partkey, ln(greatest(30.0, least(14400.0, p_size * 20.0))) AS d, p_retailprice / 100 AS area FROM part) SELECT p_partkey, round(1 - exp(y0 + (d - x0) / (x1 - x0) * (y1 - y0)) * (1 - exp(-0.015 * area)), 6) AS factor FROM p JOIN k ON d >= x0 AND d < x1")
def areal_factor(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(hyetograph.areal_factor(F.col("p_size") * 20.0, F.col("p_retailprice") / 100), 6).alias("factor"))


@query("SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN 0.88 WHEN 1 THEN 0.96 WHEN 2 THEN 0.99 ELSE 1 END * p_retailprice, 4) AS depth FROM part")
def partial_to_annual(spark, sf):
    pct = F.element_at(F.array(*[F.lit(x) for x in (50, 20, 10, 1)]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.round(hyetograph.partial_to_annual(F.col("p_retailprice"), pct), 4).alias("depth"))


@query(f"""
WITH d AS (SELECT * FROM {SQL_KNOTS} UNION ALL SELECT 10.0, 0.59 * 2.06 + 0.41 * 0.91 UNION ALL SELECT 30.0, 0.49 * 3.78 + 0.51 * 2.06),
a AS (SELECT ln(x) AS x0, ln(1 - y) AS y0, lead(ln(x)) OVER (ORDER BY x) AS x1, lead(ln(1 - y)) OVER (ORDER BY x) AS y1 FROM {AREAL}),
n AS (SELECT n_name AS storm_id, n_nationkey % 5 * 16 + 17 AS pct, n_nationkey * 10.0 AS area FROM nation),
k AS (SELECT storm_id, ln(d.x) AS x, ln(d.y * CASE WHEN area <= 0 THEN 1 ELSE 1 - exp(a.y0 + (ln(greatest(30.0, d.x)) - a.x0) / (a.x1 - a.x0) * (a.y1 - a.y0)) * (1 - exp(-0.015 * area)) END) AS y FROM n, d JOIN a ON ln(greatest(30.0, d.x)) >= a.x0 AND ln(greatest(30.0, d.x)) < a.x1),
b AS (SELECT storm_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY storm_id ORDER BY x)),
t AS (SELECT storm_id, pct, i, ln((i + 1) * 15.0) AS t FROM n, range(96) AS r(i)),
c AS (SELECT t.storm_id, pct, i, exp(y0 + CASE WHEN x1 IS NULL THEN 0 ELSE (t - x0) / (x1 - x0) * (y1 - y0) END) AS c FROM t JOIN b ON t.storm_id = b.storm_id AND t.t >= b.x0 - 1e-12 AND (t.t < b.x1 - 1e-12 OR b.x1 IS NULL)),
e AS (SELECT storm_id, i AS k, c - coalesce(lag(c) OVER (PARTITION BY storm_id ORDER BY i), 0) AS inc, least(95, CAST(floor(pct / 100.0 * 96 + 1e-9) AS BIGINT)) AS p FROM c),
f AS (SELECT storm_id, inc, 1 + CASE WHEN k = 0 THEN p WHEN k <= 2 * least(p, 95 - p) THEN CASE WHEN k % 2 = 1 THEN p - (k + 1) // 2 ELSE p + k // 2 END WHEN p < 95 - p THEN k ELSE p - (k - (95 - p)) END AS i FROM e UNION ALL SELECT storm_id, 0, 0 FROM n)
SELECT storm_id, CAST(i AS INT) AS i, i * 15 / 60.0::DOUBLE AS hour, round(inc, 6) AS incremental_depth, round(sum(inc) OVER (PARTITION BY storm_id ORDER BY i), 6) AS cumulative_depth FROM f""")
def balanced_storm(spark, sf):
    """Balanced storms for every nation."""
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("storm_id"), F.lit(1440).alias("duration_min"), F.lit(15).alias("interval_min"), (F.col("n_nationkey") % 5 * 16 + 17).alias("peak_pct"), (F.col("n_nationkey") * 10.0).alias("area_sqmi"), F.lit(1).alias("exceedance_pct"))
    depths = nations.select("storm_id", F.explode(F.array(*[F.struct(F.lit(a).alias("duration"), F.lit(b).alias("depth")) for a, b in KNOTS])).alias("k")).select("storm_id", "k.duration", "k.depth")
    out = hyetograph.balanced_storm(nations, depths)
    return out.withColumns({c: F.round(c, 6) for c in ("incremental_depth", "cumulative_depth")})


# --- areal reduction ---

SEG = "(VALUES " + ", ".join(f"('{c}', {s[0]}::DOUBLE, {s[1]}::DOUBLE, {s[2]}, {s[3]}, {s[4]}, {s[5]}, {s[6]})" for c, ss in arf.SEGMENTS.items() for s in ss) + ") AS s(city, lo, hi, sa, sb, fa, fb, fc)"
CITY = "CASE {} % 3 WHEN 0 THEN 'austin' WHEN 1 THEN 'dallas' ELSE 'houston' END"


@query(f"WITH p AS (SELECT p_partkey, {CITY.format('p_partkey')} AS city, CAST(p_size AS DOUBLE) AS r FROM part), j AS (SELECT p.*, sa - sb * r AS s2, fa - fb * r + CASE WHEN fc = 0 THEN 0 ELSE fc / (r * r) END AS f FROM p JOIN {SEG} ON p.city = s.city AND r >= lo AND (r < hi OR hi = 50)) SELECT p_partkey, city, r, round(CASE WHEN s2 > 0 AND s2 <= 1 AND r <= 50 THEN s2 END, 4) AS s2, round(CASE WHEN f > 0 AND f <= 1 AND r <= 50 THEN f END, 5) AS arf FROM j")
def texas_segment_arf(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{CITY.format('p_partkey')} as city", "cast(p_size as double) as r")
    return arf.depth_distance(p).withColumns({"s2": F.round("s2", 4), "arf": F.round("arf", 5)})


@query(f"WITH p AS (SELECT p_brand, {CITY.format('p_partkey')} AS city, CAST(p_size AS DOUBLE) AS r, p_retailprice AS area FROM part), j AS (SELECT p_brand, sa - sb * r AS s2, area FROM p JOIN {SEG} ON p.city = s.city AND r >= lo AND (r < hi OR hi = 50)) SELECT p_brand, round(sum(s2 * area) / sum(area), 6) AS arf FROM j GROUP BY p_brand")
def noncircular_arf(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_brand", f"{CITY.format('p_partkey')} as city", "cast(p_size as double) as r", "p_retailprice as area")
    return arf.noncircular_factor(p, ["p_brand"]).withColumn("arf", F.round("arf", 6))


DAR = [(24, 10, 1.0), (24, 100, 0.97), (24, 1000, 0.92), (6, 10, 0.99), (6, 100, 0.94), (6, 500, 0.85)]
SQL_DAR = "(VALUES " + ", ".join(f"({d}, {a}.0, {f})" for d, a, f in DAR) + ") AS t(duration, a, f)"


@query(f"WITH b AS (SELECT duration, a AS a0, f AS f0, lead(a) OVER w AS a1, lead(f) OVER w AS f1, min(a) OVER (PARTITION BY duration) AS lo, max(a) OVER (PARTITION BY duration) AS hi, min(f) OVER (PARTITION BY duration) AS fm FROM {SQL_DAR} WINDOW w AS (PARTITION BY duration ORDER BY a)), p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 24 ELSE 6 END AS duration, p_size * 15.0 AS area FROM part) SELECT p_partkey, round(CASE WHEN area <= (SELECT min(lo) FROM b WHERE b.duration = p.duration) THEN 1.0 WHEN area >= (SELECT max(hi) FROM b WHERE b.duration = p.duration) THEN (SELECT min(fm) FROM b WHERE b.duration = p.duration) ELSE (SELECT greatest(fm, least(1.0, f0 + (area - a0) / (a1 - a0) * (f1 - f0))) FROM b WHERE b.duration = p.duration AND area >= a0 AND area < a1) END, 6) AS arf FROM p")
def dar_lookup(spark, sf):
    curve = spark.createDataFrame([(d, float(a), f) for d, a, f in DAR], "duration int, area double, factor double")
    p = table(spark, sf, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, 24, 6) as duration", "cast(p_size * 15 as double) as area")
    return arf.from_curve(p, curve).select("p_partkey", F.round("arf", 6).alias("arf"))


@query("WITH d AS (SELECT * FROM (VALUES (5, 0), (15, 1), (60, 2), (360, 3), (1440, 4)) AS t(d, o)) SELECT p_partkey AS id, CAST(arg_min(d, (abs(d - p_size * 30), o)) AS DOUBLE) AS duration FROM part, d GROUP BY 1")
def nearest_duration(spark, sf):
    durations = spark.createDataFrame([(5.0, 0), (15.0, 1), (60.0, 2), (360.0, 3), (1440.0, 4)], "duration double, ordinal int")
    return arf.nearest_duration(table(spark, sf, "part").selectExpr("p_partkey as id", "cast(p_size * 30 as double) as wanted"), durations).select("id", "duration")


@query("WITH f AS (SELECT * FROM (VALUES (0, 0.9), (1, 0.85), (2, 0.8), (3, 0.97)) AS t(k, arf)) SELECT s_suppkey, s_nationkey, round(s_acctbal * coalesce(arf, (SELECT avg(arf) FROM f)), 2) AS depth_reduced FROM supplier LEFT JOIN f ON s_nationkey = k")
def apply_arf(spark, sf):
    f = spark.createDataFrame([(0, 0.9), (1, 0.85), (2, 0.8), (3, 0.97)], "s_nationkey int, arf double")
    return arf.apply_factor(table(spark, sf, "supplier").withColumnRenamed("s_acctbal", "depth"), f, "s_nationkey", 2).select("s_suppkey", "s_nationkey", "depth_reduced")


@query("WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000) SELECT k, 'missing' AS problem FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)")
def arf_missing_extra(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "k")
    return arf.unmatched(s.where("s_acctbal < 5000"), s.where("s_acctbal > 3000"), "k")


# --- networks: part p drains to p div 2 ---


def edges(spark, sf):
    p = table(spark, sf, "part")
    e = p.selectExpr("if(p_partkey % 7 = 0, 'Diversion', if(p_partkey % 3 = 0, 'Junction', 'Subbasin')) as kind", "p_partkey as name", "if(p_partkey > 0, p_partkey div 2, null) as downstream", "if(p_partkey % 7 = 0 and p_partkey > 0, p_partkey div 3, null) as divert_to")
    return network.edges(e)


SQL_EDGES = "e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 7 = 0 THEN 'Diversion' WHEN p_partkey % 3 = 0 THEN 'Junction' ELSE 'Subbasin' END AS src_type, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, 'Diversion', p_partkey // 3 FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 0)"
SQL_UP = f"WITH RECURSIVE {SQL_EDGES}, up AS (SELECT t AS target, t AS node FROM (VALUES (1), (5), (12), (90)) AS v(t) UNION SELECT up.target, e.src FROM up JOIN e ON e.dst = up.node)"


def targets(spark):
    return spark.createDataFrame([(1,), (5,), (12,), (90,)], "target long")


@query(f"WITH {SQL_EDGES} SELECT src_type, count(*) AS n, count(DISTINCT src) AS n_elements FROM e GROUP BY 1")
def upstream_edges(spark, sf):
    return edges(spark, sf).groupBy("src_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_elements"))


@query(f"{SQL_UP} SELECT target, src AS name, src_type AS kind FROM e JOIN up ON e.dst = up.node")
def upstream_closure(spark, sf):
    return network.upstream(edges(spark, sf), targets(spark))


@query(f"{SQL_UP}, s AS (SELECT DISTINCT target, src FROM e JOIN up ON e.dst = up.node WHERE src_type = 'Subbasin') SELECT target, CAST(sum(p_size) AS DOUBLE) AS area, count(*) AS n_subbasins FROM s JOIN part ON p_partkey = src GROUP BY target")
def contributing_area(spark, sf):
    areas = table(spark, sf, "part").selectExpr("p_partkey as name", "cast(p_size as double) as area")
    return network.contributing_area(edges(spark, sf), areas, targets(spark))


@query(f"{SQL_UP}, s AS (SELECT DISTINCT target, src FROM e JOIN up ON e.dst = up.node WHERE src_type = 'Subbasin') SELECT target, CAST(sum(p_size) AS DOUBLE) AS area, count(*) AS n_subbasins, array_to_string(list(src ORDER BY src), ',') AS subbasins FROM s JOIN part ON p_partkey = src GROUP BY target")
def kcda_table(spark, sf):
    areas = table(spark, sf, "part").selectExpr("p_partkey as name", "cast(p_size as double) as area")
    return network.area_table(edges(spark, sf), areas, targets(spark)).withColumn("subbasins", F.concat_ws(",", F.col("subbasins").cast("array<string>")))


@query("WITH l AS (SELECT p_partkey AS link, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS ds_link, p_size % 5 + 1 AS o FROM part), u AS (SELECT ds_link AS link, count(*) AS n FROM l WHERE ds_link IS NOT NULL GROUP BY 1) SELECT l.link, l.ds_link, l.o AS \"order\", d.o AS ds_order, coalesce(u.n, 0) AS n_upstream, d.o IS NULL AS outlet, coalesce(u.n, 0) >= 2 AS junction FROM l LEFT JOIN u ON l.link = u.link LEFT JOIN l d ON l.ds_link = d.link")
def link_topology(spark, sf):
    return network.link_topology(table(spark, sf, "part").selectExpr("p_partkey as link", "if(p_partkey > 0, p_partkey div 2, null) as ds_link", "p_size % 5 + 1 as `order`"))


@query("SELECT CAST(o AS INT) AS \"order\", count(*) AS n_links, round(sum(p_retailprice), 2) AS length FROM (SELECT *, p_size % 5 + 1 AS o FROM part) GROUP BY GROUPING SETS ((o), ())")
def stream_summary(spark, sf):
    s = network.stream_summary(table(spark, sf, "part").selectExpr("p_partkey as link", "p_size % 5 + 1 as `order`", "p_retailprice as length"))
    return s.withColumn("length", F.round("length", 2))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k")
def key_reconciliation(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return network.reconcile(a, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT p_brand, p_partkey AS idx, p_size AS \"order\", p_retailprice AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) AS n FROM part) WHERE n = 1")
def outlet_selection(spark, sf):
    return network.nearest_outlet(table(spark, sf, "part").selectExpr("p_brand", "p_partkey as idx", "p_size as `order`", "p_retailprice as distance"), ["p_brand"])


@query("SELECT CAST(min(c_custkey) AS BIGINT) AS idx, count(*) AS n FROM customer GROUP BY round(c_acctbal / 1000, 0), c_nationkey")
def dedupe_points(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.round(F.col("c_acctbal") / 1000, 0).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    n = c.groupBy("x", "y").agg(F.count("*").alias("n"))
    return network.dedupe_points(c).join(n, ["x", "y"]).select("idx", "n")


# --- parameters ---


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def run_config_join(spark, sf):
    runs = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey as basin")
    basins = table(spark, sf, "customer").selectExpr("c_custkey as basin", "c_name", "c_nationkey as met")
    mets = table(spark, sf, "nation").selectExpr("n_nationkey as met", "n_name", "n_regionkey as control")
    controls = table(spark, sf, "region").selectExpr("r_regionkey as control", "r_name")
    return params.configuration(runs, basins, mets, controls).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def component_exists(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0")
    return params.known_components(table(spark, sf, "orders"), "o_custkey", known, "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS old FROM supplier WHERE s_acctbal > 3000), c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN concat(s_nationkey, '.0') ELSE CAST(s_nationkey + 1 AS VARCHAR) END AS v FROM supplier WHERE s_acctbal < 7000), n AS (SELECT * FROM c WHERE v IS NOT NULL)
SELECT coalesce(o.k, n.k) AS k, old, CASE WHEN n.k IS NULL OR o.k IS NOT NULL AND TRY_CAST(old AS DOUBLE) = TRY_CAST(v AS DOUBLE) THEN old ELSE v END AS value, CASE WHEN n.k IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'inserted' WHEN TRY_CAST(old AS DOUBLE) = TRY_CAST(v AS DOUBLE) THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.k = n.k""")
def param_upsert(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.where("s_acctbal > 3000").selectExpr("s_suppkey as k", "cast(s_nationkey as string) as value")
    new = s.where("s_acctbal < 7000").selectExpr("s_suppkey as k", "case when s_suppkey % 3 = 0 then null when s_suppkey % 4 = 0 then concat(s_nationkey, '.0') else cast(s_nationkey + 1 as string) end as value")
    return params.upsert(old, new, ["k"], insert=True)


@query("SELECT 'supplier' AS kind, count(*) AS n, count(s_acctbal) AS n_s, 0 AS n_c FROM supplier UNION ALL SELECT 'customer', count(*), 0, count(c_mktsegment) FROM customer")
def param_union_export(spark, sf):
    a = table(spark, sf, "supplier").withColumn("kind", F.lit("supplier"))
    b = table(spark, sf, "customer").withColumn("kind", F.lit("customer"))
    return params.export([a, b]).groupBy("kind").agg(F.count("*").alias("n"), F.count("s_acctbal").alias("n_s"), F.count("c_mktsegment").alias("n_c"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ', ') AS methods FROM customer GROUP BY 1")
def method_sets(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.concat("c_mktsegment", F.lit(", ")).alias("m"))
    return params.method_sets(c, "m", ["c_nationkey"])


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer) ORDER BY 1")
def distinct_files(spark, sf):
    return params.distinct_files([table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select("r_name"), table(spark, sf, "customer").select("c_mktsegment")])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3")
def catalog_stats(spark, sf):
    from ..operators import catalog

    return catalog.statistics(table(spark, sf, "part"), "p_type")


@query("WITH a AS (SELECT p_partkey AS k, p_size - 10 AS old, CASE WHEN p_partkey % 2 = 0 THEN p_size - 10 ELSE p_size END AS new FROM part) SELECT count(*) AS n, count(*) FILTER (isinf(pct)) AS n_inf, round(avg(pct) FILTER (NOT isinf(pct)), 6) AS mean_pct FROM (SELECT CASE WHEN old <> 0 THEN (new - old) / old::DOUBLE * 100 WHEN new = 0 THEN 0 ELSE 'inf'::DOUBLE END AS pct FROM a)")
def pct_change(spark, sf):
    p = table(spark, sf, "part")
    out = params.percent_change(p.selectExpr("p_partkey as k", "p_size - 10 as value"), p.selectExpr("p_partkey as k", "if(p_partkey % 2 = 0, p_size - 10, p_size) as value"), "k")
    finite = F.col("pct") < float("inf")
    return out.agg(F.count("*").alias("n"), F.count_if(~finite).alias("n_inf"), F.round(F.avg(F.when(finite, F.col("pct"))), 6).alias("mean_pct"))


@query("SELECT o_custkey, array_to_string(list(d ORDER BY pos), ',') AS depths FROM (SELECT o_custkey, row_number() OVER w - 1 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS d, max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE d <= last GROUP BY 1")
def depth_vector(spark, sf):
    pos = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos")
    lines = table(spark, sf, "orders").select("o_custkey", pos, F.lit("Depth").alias("k"), F.expr("if(o_orderkey % 3 = 0, '', cast(o_orderkey as string))").alias("v"))
    return params.depth_vector(lines, ["o_custkey"]).select("o_custkey", F.array_join(F.transform("depths", lambda x: x.cast("long").cast("string")), ",").alias("depths"))


# --- transfers and grids: line items are cells, orders are subbasins ---


def allocation(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subbasin"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cell"), F.col("l_quantity").alias("area"))


def subbasins(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("subbasin"), (F.col("o_totalprice") / 1000).alias("area"))


SQL_MULT = "m AS (SELECT l_orderkey AS subbasin, max(o_totalprice) / 1000 AS source, round(sum(l_quantity), 9) AS received FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


@query(f"WITH {SQL_MULT} SELECT subbasin, source / received AS multiplier FROM m")
def transfer_multiplier(spark, sf):
    return transfer.multipliers(allocation(spark, sf), subbasins(spark, sf)).groupBy("subbasin").agg(F.max("multiplier").alias("multiplier"))


@query(f"WITH {SQL_MULT} SELECT o_custkey, count(*) AS n, round(sum(l_quantity * source / received * (o_orderkey % 7) * 0.0254), 4) AS volume FROM lineitem JOIN m ON l_orderkey = subbasin JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def apply_transfer(spark, sf):
    depths = table(spark, sf, "orders").selectExpr("o_orderkey as subbasin", "o_custkey as t", "cast(o_orderkey % 7 as double) as depth")
    out = transfer.apply_transfer(transfer.multipliers(allocation(spark, sf), subbasins(spark, sf)), depths)
    return out.groupBy(F.col("t").alias("o_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))


@query("SELECT l_returnflag AS subbasin, l_linenumber AS step, CAST(GROUPING(l_returnflag) * 2 + GROUPING(l_linenumber) AS BIGINT) AS level, round(sum(l_extendedprice), 2) AS source, round(sum(l_extendedprice * (1 - l_discount)), 2) AS target, round(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice), 2) AS residual, abs(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice)) <= greatest(1e-6, 0.05 * sum(l_extendedprice)) AS accepted FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), (l_linenumber), ())")
def volume_evidence(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("l_returnflag as subbasin", "l_linenumber as step", "l_extendedprice as source", "l_extendedprice * (1 - l_discount) as target")
    out = transfer.volume_evidence(p, relative=0.05)
    return out.select("subbasin", "step", "level", F.round("source", 2).alias("source"), F.round("target", 2).alias("target"), F.round("residual", 2).alias("residual"), "accepted")


@query("SELECT l_linestatus, round(sum(CASE WHEN l_tax > 0.04 THEN l_quantity * 0.001 ELSE 0 END), 6) AS direct_m3, round(sum(CASE WHEN l_tax > 0.04 THEN 0 ELSE l_quantity * 0.001 END), 6) AS filled_m3, round(sum(l_quantity * 0.001), 6) AS total_m3, round(sum(l_quantity * 0.001) / 1233.48183754752, 8) AS total_acft, round(sum(CASE WHEN l_tax > 0.04 THEN 0 ELSE l_quantity * 0.001 END) / sum(l_quantity * 0.001) * 100, 6) AS filled_pct FROM lineitem GROUP BY 1")
def direct_vs_fill(spark, sf):
    c = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_quantity").alias("depth"), F.lit(1.0).alias("area"), (F.col("l_tax") > 0.04).alias("direct"))
    return transfer.volume_effect(c, ["l_linestatus"]).withColumns({n: F.round(n, 8 if n == "total_acft" else 6) for n in ("direct_m3", "filled_m3", "total_m3", "total_acft", "filled_pct")})


@query("SELECT l_returnflag, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def distance_percentiles(spark, sf):
    out = transfer.distance_metrics(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "p50", "p90", "p95", "p99")})


@query("WITH t AS (SELECT s_suppkey AS tid, s_nationkey * 10.0 AS tx, s_acctbal / 50 AS ty FROM supplier), p AS (SELECT c_custkey AS id, c_nationkey * 10.0 + c_custkey % 10 AS x, c_acctbal / 50 AS y FROM customer) SELECT id, arg_min(tid, (sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), tid)) AS tid, round(min(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))), 6) AS distance FROM p, t GROUP BY id")
def nearest_fill(spark, sf):
    t = table(spark, sf, "supplier").selectExpr("s_suppkey as tid", "s_nationkey * 10d as tx", "s_acctbal / 50 as ty")
    p = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_nationkey * 10d + c_custkey % 10 as x", "c_acctbal / 50 as y")
    return transfer.nearest(p, t, 20.0).select("id", "tid", F.round("distance", 6).alias("distance"))


BOX = "SELECT {k} AS id, {a} % 40 * 1.0 AS x0, {a} % 23 * 1.0 AS y0, {a} % 40 + 1.0 + {a} % 5 AS x1, {a} % 23 + 1.0 + {a} % 3 AS y1 FROM {t}"


@query(f"WITH a AS ({BOX.format(k='c_custkey', a='c_custkey', t='customer')}), b AS ({BOX.format(k='s_suppkey', a='s_suppkey', t='supplier')}), j AS (SELECT a.id AS a_id, b.id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM a, b) SELECT a_id, b_id, round(CAST(w * h AS DOUBLE), 6) AS area FROM j WHERE w > 0 AND h > 0")
def bbox_overlap(spark, sf):
    box = lambda k, t: table(spark, sf, t).selectExpr(f"{k} as id", f"{k} % 40 * 1d as x0", f"{k} % 23 * 1d as y0", f"{k} % 40 + 1d + {k} % 5 as x1", f"{k} % 23 + 1d + {k} % 3 as y1")
    return transfer.overlap(box("c_custkey", "customer"), box("s_suppkey", "supplier"), 4.0).withColumn("area", F.round("area", 6))


@query("SELECT event_type AS subbasin, round(sum(CASE WHEN value > 5 THEN value ELSE 0 END), 4) AS covered, round(sum(CASE WHEN value <= 1 THEN value ELSE 0 END), 4) AS nodata, round(sum(CASE WHEN value > 1 AND value <= 5 THEN value ELSE 0 END), 4) AS outside, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def bbox_overlap_coverage(spark, sf):
    c = table(spark, sf, "events").selectExpr("event_type as subbasin", "case when value > 5 then 'covered' when value <= 1 then 'nodata' else 'outside' end as kind", "value as area")
    return transfer.coverage(c).withColumns({k: F.round(k, 4) for k in ("covered", "nodata", "outside")})


@query("WITH b AS (SELECT c_custkey AS id, c_custkey % 17 * 1.5 AS x0, c_custkey % 11 * 2.5 AS y0, c_custkey % 17 * 1.5 + 3.2 AS x1, c_custkey % 11 * 2.5 + 2.1 AS y1 FROM customer), c AS (SELECT *, unnest(range(CAST(floor(x0 / 2) AS BIGINT), CAST(ceil(x1 / 2) AS BIGINT))) AS col FROM b), r AS (SELECT *, unnest(range(CAST(floor(y0 / 2) AS BIGINT), CAST(ceil(y1 / 2) AS BIGINT))) AS row FROM c) SELECT \"row\", col, count(*) AS n, round(CAST(sum((least(col * 2 + 2, x1) - greatest(col * 2, x0)) * (least(\"row\" * 2 + 2, y1) - greatest(\"row\" * 2, y0))) AS DOUBLE), 6) AS area FROM r GROUP BY 1, 2")
def grid_cells(spark, sf):
    b = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_custkey % 17 * 1.5d as x0", "c_custkey % 11 * 2.5d as y0", "c_custkey % 17 * 1.5d + 3.2d as x1", "c_custkey % 11 * 2.5d + 2.1d as y1")
    return transfer.cells(b, 2.0).groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"))


@query("SELECT n, CASE n WHEN 1 THEN 'assigned' ELSE CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END END AS status, count(*) AS k FROM (SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey) GROUP BY ALL")
def assignment_check(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as id", "o_orderkey as area_id")
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    n = o.groupBy("id").agg(F.count("*").alias("n"))
    return transfer.assignments(o, p).join(n, "id", "left").groupBy("n", "status").agg(F.count("*").alias("k"))


@query("SELECT c_custkey, round(sqrt(pow((c_nationkey - 12.0) * 111.32 * cos(radians(m)), 2) + pow((c_acctbal / 500 - 5) * 110.574, 2)), 4) AS length_km FROM (SELECT *, avg(c_acctbal / 500) OVER (PARTITION BY c_mktsegment) AS m FROM customer)")
def travel_length(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment", "cast(c_nationkey as double) as lon", "c_acctbal / 500 as lat", "12d as out_lon", "5d as out_lat")
    return transfer.travel_length(c, ["c_mktsegment"]).select("c_custkey", F.round("length_km", 4).alias("length_km"))


@query("WITH p AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer), v AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY k ORDER BY ord)), s AS (SELECT k, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my FROM v GROUP BY k) SELECT k, round(abs(a), 2) AS area, round(mx / (6 * a), 3) AS cx, round(my / (6 * a), 3) AS cy FROM s")
def bbox_centroid(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("ord"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return transfer.polygon_measures(p, ["k"]).select("k", F.round("area", 2).alias("area"), F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query("SELECT p_partkey, round(a - b, 4) AS area_difference, round(c / (a + b - c), 6) AS iou, round(c / b, 6) AS reference_covered, round(c / a, 6) AS candidate_covered, round(b - c, 4) AS false_negative_area, round(a - c, 4) AS false_positive_area FROM (SELECT p_partkey, p_retailprice AS a, p_retailprice + p_size AS b, p_retailprice - p_size AS c FROM part)")
def overlap_metrics(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_retailprice as a", "p_retailprice + p_size as b", "p_retailprice - p_size as c")
    out = p.select("p_partkey", *transfer.overlap_metrics(F.col("a"), F.col("b"), F.col("c")))
    return out.withColumns({n: F.round(n, 6 if n in ("iou", "reference_covered", "candidate_covered") else 4) for n in out.columns[1:]})


def fingerprints(spark, sf):
    """Mean vectors of each label, over even and over odd ids, as two supports of one record."""
    e = table(spark, sf, "embeddings").select(F.lit(1).alias("g"), "label", (F.col("vec_id") % 2).alias("side"), F.posexplode("embedding").alias("pos", "value"))
    m = e.groupBy("g", "side", F.col("label").alias("id"), "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return m.where("side = 0").drop("side"), m.where("side = 1").drop("side")


@query("WITH u AS (SELECT label, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, side, pos, avg(v) AS v FROM u GROUP BY ALL) SELECT 1 AS g, a.label AS a_id, b.label AS b_id, round(avg(pow(a.v - b.v, 2)), 6) AS cost FROM m a JOIN m b ON a.pos = b.pos WHERE a.side = 0 AND b.side = 1 GROUP BY 2, 3")
def fingerprint_cost(spark, sf):
    a, b = fingerprints(spark, sf)
    return transfer.fingerprint_cost(a, b, ["g"]).withColumn("cost", F.round("cost", 6))


# --- scalars, dates, logs ---


@query("SELECT p_partkey, round(p_retailprice * 25.4, 4) AS mm, round(p_retailprice * 0.028316847, 6) AS cms, round(p_retailprice / 1233.48, 8) AS acft FROM part")
def unit_convert(spark, sf):
    v = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(units.convert(v, "in", "mm"), 4).alias("mm"), F.round(units.convert(v, "CFS", "cms"), 6).alias("cms"), F.round(units.convert(v, "m3", "acft"), 8).alias("acft"))


@query("SELECT p_partkey, round(0.2 * (1000.0 / p_size - 10), 6) AS ia, CAST(round(greatest(0, least(100, 1000.0 / (0.2 * (1000.0 / p_size - 10) / 0.2 + 10))), 6) AS DOUBLE) AS cn FROM part")
def cn_ia(spark, sf):
    ia = units.initial_abstraction(F.col("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", F.round(ia, 6).alias("ia"), F.round(units.curve_number(ia), 6).alias("cn"))


@query("SELECT p_partkey, CAST(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 END AS BIGINT) AS minutes FROM part")
def interval_parse(spark, sf):
    t = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" Minutes"), F.lit("HOUR"), F.lit(" Day"), F.lit(" lots")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", units.interval_minutes(t).alias("minutes"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY ELSE date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 6 HOUR END AS stamp FROM orders")
def date_parse(spark, sf):
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    time = F.when(F.col("o_orderkey") % 3 == 0, "24:00").otherwise("06:00")
    return o.select("o_orderkey", units.parse_datetime(date, time).alias("stamp"))


LOG = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'NOTE' ELSE 'noise' END || ' ' || CASE WHEN event_id % 50 = 1 THEN 10185 ELSE 10000 + event_id % 7 END || ':  value ' || event_type"


def log_table(spark, sf):
    return logs.messages(table(spark, sf, "events").selectExpr("user_id", "event_id", f"{LOG} as line"))


@query("SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'NOTE' END AS type, CAST(CASE WHEN event_id % 50 = 1 THEN 10185 ELSE 10000 + event_id % 7 END AS INT) AS code, 'value ' || event_type AS message, count(*) AS n FROM events WHERE event_type IN ('error', 'view', 'click') GROUP BY ALL")
def log_parse(spark, sf):
    return log_table(spark, sf).groupBy("type", "code", "message").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS notes, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_id % 50 = 1) AS finished, bool_or(event_id % 50 = 1) AND count(*) FILTER (event_type = 'error') = 0 AS success FROM events WHERE event_type IN ('error', 'view', 'click') GROUP BY 1")
def log_outcome(spark, sf):
    return logs.outcome(log_table(spark, sf), ["user_id"])


@query("WITH m AS (SELECT user_id, event_type, CASE WHEN event_id % 50 = 1 THEN 10185 ELSE 10000 + event_id % 7 END AS code FROM events WHERE event_type IN ('error', 'view', 'click')), a AS (SELECT DISTINCT event_type, code FROM m WHERE user_id = 1), b AS (SELECT DISTINCT event_type, code FROM m WHERE user_id = 2) SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'NOTE' END AS type, CAST(code AS INT) AS code, 'value ' || event_type AS message, change FROM (SELECT *, 'resolved' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def log_compare(spark, sf):
    m = log_table(spark, sf)
    return logs.compare(m.where("user_id = 1"), m.where("user_id = 2"))


@query("SELECT o_orderpriority, round(sqrt(avg(pow(a - b, 2))), 4) AS rmse, round(max(abs(a - b)), 4) AS max_abs_diff, round(avg(a - b), 4) AS mean_diff, round(corr(a, b), 8) AS correlation FROM (SELECT o_orderpriority, o_totalprice AS a, o_totalprice * 1.01 + o_orderkey % 5 AS b FROM orders) GROUP BY 1")
def validation_metrics(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderpriority as storm_id", "o_orderkey as i", "o_totalprice as incremental_depth", "o_totalprice * 1.01d + o_orderkey % 5 as golden")
    out = hyetograph.compare(o.drop("golden"), o.select("storm_id", "i", "golden"), ["storm_id", "i"])
    return out.select(F.col("storm_id").alias("o_orderpriority"), F.round("rmse", 4).alias("rmse"), F.round("max_abs_diff", 4).alias("max_abs_diff"), F.round("mean_diff", 4).alias("mean_diff"), F.round("correlation", 8).alias("correlation"))

