"""Queries on series: events stand for samples of paths //user_id/event_type/.../RUN:run/."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import params, routing, series, storms
from .registry import query, table

PATH = "concat('//USER', user_id, '/', c, '//1HOUR/RUN:Run ', user_id % 3, '/')"
C_PART = "CASE event_type WHEN 'click' THEN 'FLOW' WHEN 'view' THEN 'PRECIP-INC' WHEN 'purchase' THEN 'PRECIP' WHEN 'signup' THEN 'FLOW-DIRECT' ELSE 'TABLE' END"
SQL_CATALOG = f"WITH k AS (SELECT user_id, c, min(event_id) AS ordinal FROM (SELECT user_id, event_id, {C_PART} AS c FROM events) GROUP BY ALL), p AS (SELECT ordinal, {PATH} AS path, user_id, concat('USER', user_id) AS b, c, concat('Run ', user_id % 3) AS run_name FROM k)"


def samples(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def catalog(spark, sf):
    e = samples(spark, sf).selectExpr("user_id", f"{C_PART} as c", "event_id")
    return cat.parse(e.groupBy("user_id", "c").agg(F.min("event_id").alias("ordinal")).selectExpr("ordinal", f"{PATH} as path"))


@query(f"{SQL_CATALOG} SELECT ordinal, path, '' AS a, b, c, '' AS d, '1HOUR' AS e, concat('RUN:', run_name) AS f, run_name FROM p")
def path_parse(spark, sf):
    return catalog(spark, sf)


@query(f"{SQL_CATALOG} SELECT concat('/A/', b, '/', c, '/01JAN2000/1HOUR/RUN:', run_name, '/') AS path FROM p")
def path_build(spark, sf):
    return catalog(spark, sf).select(cat.build(F.lit("A"), F.col("b"), F.col("c"), F.lit("01JAN2000"), F.col("e"), F.col("run_name")).alias("path"))


@query(f"{SQL_CATALOG} SELECT ordinal, path FROM p WHERE regexp_matches(path, '(?i)user1[0-9]') AND contains(c, 'PRECIP') AND upper(run_name) = 'RUN 1'")
def path_filter(spark, sf):
    return cat.filter_catalog(catalog(spark, sf), "user1[0-9]", "precip", None, "run 1", True).select("ordinal", "path")


@query(f"{SQL_CATALOG} SELECT ordinal, path FROM p WHERE c = 'TABLE'")
def path_tables(spark, sf):
    return catalog(spark, sf).where(cat.is_table()).select("ordinal", "path")


@query(f"{SQL_CATALOG} SELECT ordinal, path FROM p WHERE c = 'FLOW' AND b IN ('USER1', 'USER2', 'USER30') AND run_name = 'Run 1'")
def select_flow_total(spark, sf):
    return cat.select_results(catalog(spark, sf), "flow-total", ["user1", "User2", "USER30"], "RUN 1").select("ordinal", "path")


C_NAMES = "FLOW FLOW-OBSERVED FLOW-DIRECT FLOW-BASE FLOW-COMBINE FLOWS PRECIP PRECIP-INC PRECIP-CUM PRECIP-EXCESS PRECIP-LOSS STAGE STAGE-X STORAGE STORAGE-GW STORAGE-SOIL ELEV ELEVATION OUTFLOW OUTFLOW-2 INFLOW EXCESS EXCESS-PRECIP BASEFLOW INFILTRATION ET ET-CANOPY ETX MET TABLE".split()
SQL_TYPES = "(VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in cat.RESULT_TYPES.items()) + ") AS t(kind, re)"


@query(f"WITH p AS (SELECT concat('//USER', user_id, '/', [{', '.join(repr(c) for c in C_NAMES)}][event_id % {len(C_NAMES)} + 1], '//1HOUR/RUN:Run ', user_id % 3, '/') AS path FROM events) SELECT kind, count(*) AS n FROM p, {SQL_TYPES} WHERE regexp_matches(path, '(?i)/' || re || '/') AND NOT contains(path, '/TABLE/') GROUP BY kind")
def result_types(spark, sf):
    """Every result type on C parts with and without suffixes; C parts are in mixed case."""
    names = F.array(*[F.lit(c.lower() if i % 3 == 1 else c) for i, c in enumerate(C_NAMES)])
    e = table(spark, sf, "events").select("user_id", F.get(names, (F.col("event_id") % len(C_NAMES)).cast("int")).alias("c")).selectExpr(f"{PATH} as path")
    kinds = F.array(*[F.when(cat.matches_type(k), F.lit(k)) for k in cat.RESULT_TYPES])
    return cat.parse(e).where(~cat.is_table()).select(F.explode(F.array_compact(kinds)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{SQL_CATALOG} SELECT ordinal, path FROM (SELECT *, row_number() OVER (PARTITION BY upper(b), upper(run_name) ORDER BY CASE c WHEN 'PRECIP-INC' THEN 0 ELSE 1 END, ordinal) AS n FROM p WHERE c IN ('PRECIP-INC', 'PRECIP')) WHERE n = 1")
def prefer_interval_precip(spark, sf):
    return cat.prefer_interval_precip(catalog(spark, sf)).select("ordinal", "path")


@query(f"{SQL_CATALOG} SELECT arg_min(b, ordinal) AS element, min(ordinal) AS ordinal FROM p GROUP BY upper(b)")
def unique_elements(spark, sf):
    return cat.unique_elements(catalog(spark, sf))


@query(f"{SQL_CATALOG} SELECT b AS element, array_to_string(list(path ORDER BY ordinal), ';') AS paths FROM p GROUP BY b")
def group_by_element(spark, sf):
    return cat.by_element(catalog(spark, sf)).select("element", F.concat_ws(";", "paths").alias("paths"))


@query(f"{SQL_CATALOG} SELECT b, max(ordinal) AS last_ordinal, min(ordinal) AS first_ordinal FROM p GROUP BY b")
def last_match(spark, sf):
    c = catalog(spark, sf).select("b", "ordinal")
    return cat.one_match(c, ["b"]).withColumnRenamed("ordinal", "last_ordinal").join(cat.one_match(c, ["b"], "first").withColumnRenamed("ordinal", "first_ordinal"), "b")


VALID = "value IS NOT NULL AND NOT isnan(value) AND value NOT IN (-901, -902) AND value > -3.4e38"


@query(f"SELECT user_id, event_type, max(value) AS peak_value, arg_min(ts, (-value, ts)) AS peak_time, count(*) AS n_values FROM events WHERE {VALID} GROUP BY ALL")
def peak_first_max(spark, sf):
    return series.first_peak(samples(spark, sf), ["user_id", "event_type"], "event_id")


@query(f"SELECT user_id, max(value) AS peak_value, arg_min(ts, (-value, ts)) AS peak_time, count(*) AS n_values FROM events WHERE event_type = 'click' AND {VALID} GROUP BY ALL ORDER BY peak_value DESC")
def peak_sorted(spark, sf):
    return series.first_peak(samples(spark, sf).where("event_type = 'click'"), ["user_id"], "event_id").orderBy(F.desc("peak_value"), "user_id")


STEP = "(value + lag(value) OVER w) / 2 * (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9"


@query(f"SELECT user_id, round(coalesce(sum(area), 0) * 3600.0 / 43560.0, 2) AS total_volume_af, round(avg(value), 2) AS mean_flow, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 2) AS duration_hours FROM (SELECT *, {STEP} AS area FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id ORDER BY total_volume_af DESC")
def volume_summary(spark, sf):
    return series.volume_summary(samples(spark, sf), ["user_id"], "event_id")


@query(f"SELECT user_id, start_time, end_time, round(dur, 6) AS duration_hours, peak_flow, peak_time, min_flow, round(mean_flow, 6) AS mean_flow, round(median_flow, 6) AS median_flow, round(std_flow, 6) AS std_flow, round(v * 3600.0 / 43560.0, 2) AS total_volume_af, round((epoch_us(peak_time) - epoch_us(start_time)) / 3.6e9, 2) AS time_to_peak_hours, round(m / s, 2) AS centroid_time FROM (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS dur, max(value) AS peak_flow, arg_min(ts, (-value, ts)) AS peak_time, min(value) AS min_flow, avg(value) AS mean_flow, median(value) AS median_flow, stddev_samp(value) AS std_flow, coalesce(sum(area), 0) AS v, sum(t * value) AS m, sum(value) AS s FROM (SELECT *, {STEP} AS area, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 3.6e9 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id)")
def hydrograph_stats(spark, sf):
    out = series.statistics(samples(spark, sf), ["user_id"], "event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("duration_hours", "mean_flow", "median_flow", "std_flow")})


@query("SELECT user_id, event_type, round(sum(value), 2) AS total_depth, round(max(value), 2) AS max_intensity, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 2) AS duration_hours FROM events WHERE event_type = 'view' GROUP BY ALL")
def precip_summary(spark, sf):
    return series.precipitation_summary(samples(spark, sf).where("event_type = 'view'"), ["user_id", "event_type"])


@query("SELECT user_id, round(sum(value), 6) AS total, count(*) AS n_values FROM events WHERE event_type = 'view' GROUP BY ALL")
def total_precip(spark, sf):
    return series.total_precipitation(samples(spark, sf).where("event_type = 'view'"), ["user_id"]).withColumn("total", F.round("total", 6))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS \"view\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def compare_runs_pivot(spark, sf):
    hourly = series.resample(samples(spark, sf).where("event_type in ('click', 'view')"), ["event_type"]).withColumn("value", F.round("value", 6))
    return series.compare_runs(hourly, "event_type", ["click", "view"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (v IS NOT NULL AND v NOT IN (-901, -902) AND v > -3.4e38) AS n_valid, count(*) FILTER (v IN (-901, -902)) AS n_marked FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN -901.0 WHEN event_id % 11 = 0 THEN -3.5e38 WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY ALL")
def valid_mask_counts(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, -901.0).when(F.col("event_id") % 11 == 0, -3.5e38).when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value"))
    return series.mask_counts(samples(spark, sf).withColumn("value", v), ["event_type"])


@query("SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00' GROUP BY ALL")
def time_window(spark, sf):
    return series.window_of(samples(spark, sf), "2024-01-05 00:00:00", "2024-01-06 12:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


QUALIFY = """
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -1e31 ELSE value - 1 END AS v FROM events),
d AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS d, v IS NOT NULL AND v > -1e30 AS ok FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, count(*) AS record_count, count(*) FILTER (v IS NULL) AS missing_count, count(*) FILTER (v <= -1e30) AS sentinel_count, count(*) FILTER (ok AND v < 0) AS negative_count, min(v) FILTER (ok) AS minimum_value, max(v) FILTER (ok) AS peak_value, arg_min(ts, (-v, ts)) FILTER (ok) AS peak_time, arg_max(v, (ts, event_id)) FILTER (ok) AS final_value, max(ts) AS e, min(d) AS lo, max(d) AS hi FROM d GROUP BY user_id)
SELECT user_id, record_count, missing_count, sentinel_count, negative_count, round(minimum_value, 6) AS minimum_value, round(peak_value, 6) AS peak_value, peak_time, round(final_value, 6) AS final_value, round(CASE WHEN peak_value > 0 THEN final_value / peak_value END, 6) AS final_to_peak_ratio, round((epoch_us(e) - epoch_us(peak_time)) / 3.6e9, 6) AS post_peak_hours, coalesce(lo = hi AND lo > 0, false) AS regular_interval, coalesce(CASE WHEN peak_value > 0 THEN final_value / peak_value END <= 0.1 AND (epoch_us(e) - epoch_us(peak_time)) / 3.6e9 >= 6, false) AS recession_accepted, missing_count + sentinel_count + negative_count = 0 AND coalesce(lo = hi AND lo > 0, false) AND peak_value IS NOT NULL AS qualified FROM g"""


@query(QUALIFY)
def qualify_series(spark, sf):
    v = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 89 == 0, -1e31).otherwise(F.col("value") - 1)
    out = series.qualify(samples(spark, sf).withColumn("value", v), ["user_id"], tie="event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("minimum_value", "peak_value", "final_value", "final_to_peak_ratio", "post_peak_hours")})


HOURLY = "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"WITH h AS ({HOURLY}), d AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 6e7 AS d FROM h) SELECT event_type, count(*) AS n, min(d) AS interval_minutes, coalesce(min(d) = max(d) AND min(d) > 0, false) AS regular FROM d GROUP BY event_type")
def regularity(spark, sf):
    return series.interval(series.resample(samples(spark, sf), ["event_type"]), ["event_type"])


@query(f"WITH h AS ({HOURLY}), b AS (SELECT event_type, date_trunc('hour', min(ts))::TIMESTAMP AS a, date_trunc('hour', max(ts))::TIMESTAMP AS z FROM events GROUP BY 1), x AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b) SELECT coalesce(h.event_type, x.event_type) AS event_type, count(*) FILTER (h.ts IS NOT NULL AND x.ts IS NOT NULL) AS matched, count(*) FILTER (h.ts IS NULL) AS missing, count(*) FILTER (x.ts IS NULL) AS unexpected FROM h FULL JOIN x ON h.event_type = x.event_type AND h.ts = x.ts GROUP BY 1")
def exact_coverage(spark, sf):
    s = samples(spark, sf)
    return series.coverage(series.resample(s, ["event_type"]), series.regular_stamps(s, ["event_type"]), ["event_type"])


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_resample(spark, sf):
    return series.resample(samples(spark, sf), ["event_type"]).withColumn("value", F.round("value", 6))


MAPPINGS = [(1, "click", "q1", 1.0, 0.0), (2, "click", "q2", 2.0, 1.5), (3, "view", "q2", 1.0, 0.0), (4, "view", "q3", 0.5, 0.0), (5, "view", "q3", 0.5, 0.0)]
SQL_MAPPINGS = "(VALUES " + ", ".join(f"({i}, '{s}', '{t}', {m}, {b})" for i, s, t, m, b in MAPPINGS) + ") AS m(mapping_id, source, target, m, b)"


def mappings(spark):
    return spark.createDataFrame(MAPPINGS, "mapping_id int, source string, target string, m double, b double")


@query(f"SELECT mapping_id, source, target, count(*) AS n, round(sum(value * m + b), 3) AS total FROM events JOIN {SQL_MAPPINGS} ON event_type = source GROUP BY ALL")
def linear_handoff(spark, sf):
    s = samples(spark, sf).select(F.col("event_type").alias("source"), "ts", "value")
    return series.linear_handoff(s, mappings(spark)).groupBy("mapping_id", "source", "target").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT o_custkey AS target, count(*) AS n, count(DISTINCT (o_orderpriority, o_orderkey % 3, o_orderstatus)) AS signatures FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderpriority, o_orderkey % 3, o_orderstatus)) > 1")
def collision_check(spark, sf):
    """Customers that orders with different priorities, factors or states write to."""
    return series.collisions(table(spark, sf, "orders").selectExpr("o_custkey as target", "o_orderpriority as source", "o_orderkey % 3 as m", "o_orderstatus as b"))


def rain(spark, sf):
    """Hourly series of each event type, dry hours filled with 0, scaled so that there are storms."""
    s = samples(spark, sf)
    wet = series.resample(s.where("value > 40"), ["event_type"], how="sum").select("event_type", "ts", (F.col("value") / 1000).alias("value"))
    return series.regular_stamps(s, ["event_type"]).join(wet, ["event_type", "ts"], "left").select("event_type", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


RAIN = """
WITH b AS (SELECT event_type, date_trunc('hour', min(ts))::TIMESTAMP AS a, date_trunc('hour', max(ts))::TIMESTAMP AS z FROM events GROUP BY 1),
x AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM b),
wet AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) / 1000 AS value FROM events WHERE value > 40 GROUP BY 1, 2),
rain AS (SELECT x.event_type, x.ts, coalesce(wet.value, 0) AS value FROM x LEFT JOIN wet USING (event_type, ts)),
l AS (SELECT *, max(CASE WHEN value > 0.01 THEN ts END) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM rain),
e AS (SELECT *, sum(CASE WHEN value > 0.01 AND (p IS NULL OR ts - p > INTERVAL 4 HOUR) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS e FROM l),
t AS (SELECT *, max(CASE WHEN value > 0.01 THEN ts END) OVER (PARTITION BY event_type, e) AS z FROM e WHERE e > 0),
g AS (SELECT event_type, min(ts) AS start_time, max(ts) AS end_time, sum(value) AS d, max(value) AS p, count(*) FILTER (value > 0.01) AS wet_hours FROM t WHERE ts <= z GROUP BY event_type, e),
f AS (SELECT event_type, start_time, end_time, round(d, 3) AS total_depth_in, round(p, 3) AS peak_intensity_in_hr, CAST((epoch_us(end_time) - epoch_us(start_time)) / 3.6e9 + 1 AS BIGINT) AS duration_hours, wet_hours FROM g WHERE d >= 0.1 AND wet_hours >= 1)"""


@query(f"{RAIN} SELECT event_type, start_time, end_time, start_time - INTERVAL 48 HOUR AS sim_start, end_time + INTERVAL 48 HOUR AS sim_end, total_depth_in, peak_intensity_in_hr, duration_hours, wet_hours, rank() OVER (PARTITION BY event_type ORDER BY total_depth_in DESC) AS rank, row_number() OVER (PARTITION BY event_type ORDER BY start_time) AS storm_id FROM f")
def storm_catalog(spark, sf):
    return storms.storm_catalog(rain(spark, sf), ["event_type"], 4, 0.1)


@query(f"{RAIN}, q AS (SELECT event_type, quantile_cont(total_depth_in, 0.5) AS cut FROM f GROUP BY 1) SELECT event_type, start_time, total_depth_in, rank() OVER (PARTITION BY event_type ORDER BY total_depth_in DESC) AS rank FROM f JOIN q USING (event_type) WHERE total_depth_in >= cut")
def storm_percentile(spark, sf):
    return storms.storm_catalog(rain(spark, sf), ["event_type"], 4, 0.1, percentile=50).select("event_type", "start_time", "total_depth_in", "rank")


@query(f"{RAIN} SELECT event_type, total_depth_in, count(*) AS n, min(rank) AS rank FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY total_depth_in DESC) AS rank FROM f) GROUP BY 1, 2")
def storm_rank(spark, sf):
    s = storms.storm_catalog(rain(spark, sf), ["event_type"], 4, 0.1)
    return s.groupBy("event_type", "total_depth_in").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))


@query("""
WITH RECURSIVE h AS (SELECT event_type, ts, round(avg(value), 6) AS value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, value FROM events) GROUP BY event_type, ts),
r AS (SELECT event_type, i, value AS qin, CAST(20 AS DOUBLE) AS s, CAST(5 AS DOUBLE) AS q, 0 AS clips FROM h WHERE i = 1
UNION ALL SELECT h.event_type, h.i, h.value, greatest(10, least(60, r.s + r.qin - r.q)), 0.5 * greatest(10, least(60, r.s + r.qin - r.q)), r.clips + CASE WHEN r.s + r.qin - r.q BETWEEN 10 AND 60 THEN 0 ELSE 1 END FROM h JOIN r ON h.event_type = r.event_type AND h.i = r.i + 1)
SELECT event_type, round(arg_max(s, i), 4) AS final_storage, round(arg_max(q, i), 4) AS final_outflow, round(sum(q), 4) AS total_outflow, CAST(max(clips) AS BIGINT) AS clips FROM r GROUP BY event_type""")
def routing_linear(spark, sf):
    daily = series.resample(samples(spark, sf), ["event_type"], "day").withColumn("value", F.round("value", 6))
    out = routing.route_linear(daily, "event_type", 0.5, 10.0, 60.0, 20.0)
    return out.withColumns({c: F.round(c, 4) for c in ("final_storage", "final_outflow", "total_outflow")})


FLOW = "CASE WHEN {s} < 50 THEN 0.002 * {s} * {s} + 0.2 * {s} ELSE 0.4 * ({s} - 50) + 15 END"


@query(f"""
WITH RECURSIVE h AS (SELECT event_type, ts, avg(value) AS value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, value FROM events) GROUP BY event_type, ts),
r AS (SELECT event_type, i, ts, value AS qin, CAST(20 AS DOUBLE) AS s, CAST(20 AS DOUBLE) AS raw, CAST(0 AS DOUBLE) AS q FROM h WHERE i = 1
UNION ALL SELECT event_type, i, ts, qin, s, raw, {FLOW.format(s="s")} FROM (SELECT h.event_type, h.i, h.ts, h.value AS qin, r.s + r.qin - r.q AS raw, greatest(0, least(200, r.s + r.qin - r.q)) AS s FROM h JOIN r ON h.event_type = r.event_type AND h.i = r.i + 1))
SELECT event_type, ts, round(q, 5) AS value, round(s, 5) AS storage, round(raw, 5) AS unclipped_storage FROM r""")
def routing_curve(spark, sf):
    """A piecewise cubic curve of two pieces."""
    curve = {"x": [0.0, 50.0, 200.0], "c": [[0.0, 0.0], [0.002, 0.0], [0.2, 0.4], [0.0, 15.0]], "low": 0.0, "high": 200.0, "initial": 20.0}
    out = routing.route_samples(samples(spark, sf), "event_type", curve, check=False)
    return out.withColumns({c: F.round(c, 5) for c in ("value", "storage", "unclipped_storage")})


@query("SELECT user_id, coalesce(sum(bad), 0)::BIGINT AS non_finite, count(*) FILTER (d = 0) AS duplicates, count(*) FILTER (d > 0 AND d < 1) AS sub_minute, CASE WHEN coalesce(min(d) <> max(d), false) THEN 1 ELSE 0 END AS irregular FROM (SELECT user_id, 0 AS bad, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 6e7 AS d FROM events) GROUP BY user_id")
def writable_series(spark, sf):
    return series.check_regular(samples(spark, sf), ["user_id"])


@query("SELECT user_id, CASE WHEN date_trunc('hour', min(ts)) <> min(ts) THEN 1 ELSE 0 END + CASE WHEN date_trunc('hour', max(ts)) <> max(ts) THEN 1 ELSE 0 END AS unaligned, CASE WHEN coalesce(min(d) = max(d) AND min(d) > 0 AND min(d) % 60000000 = 0 AND 3600000000 % nullif(min(d), 0) = 0, false) THEN 0 ELSE 1 END AS irregular, count(*) FILTER (v IS NULL OR v < 0) AS bad_values, CASE WHEN count(*) < 2 THEN 1 ELSE 0 END AS short FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS d FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-01-01' + INTERVAL 15 MINUTE * ((event_id - 1) // 7) END AS ts, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -value ELSE value END AS v FROM events)) GROUP BY 1")
def routing_input_checks(spark, sf):
    e = samples(spark, sf).selectExpr("user_id", "if(user_id % 2 = 0, cast(ts as timestamp_ntz), timestampadd(MINUTE, 15 * ((event_id - 1) div 7), timestamp_ntz'2024-01-01 00:00:00')) as ts", "case when event_id % 97 = 0 then null when event_id % 89 = 0 then -value else value end as value")
    return routing.inflow_problems(e, "user_id")


@query("WITH k AS (SELECT user_id, event_type, c, min(event_id) AS ordinal FROM (SELECT user_id, event_id, event_type, " + C_PART + " AS c FROM events) GROUP BY ALL), p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE c WHEN 'PRECIP-INC' THEN 0 ELSE 1 END, ordinal) AS n FROM k WHERE c IN ('PRECIP-INC', 'PRECIP')) SELECT user_id, event_type, round(sum(value), 2) AS total_depth, round(max(value), 2) AS max_intensity, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 2) AS duration_hours FROM events JOIN p USING (user_id, event_type) WHERE n = 1 GROUP BY ALL")
def precip_summary_preferred(spark, sf):
    """The summary of each element and run on its one preferred path."""
    e = samples(spark, sf)
    keyed = e.selectExpr("event_id", "user_id", "event_type", f"{C_PART} as c").groupBy("user_id", "event_type", "c").agg(F.min("event_id").alias("ordinal"))
    paths = cat.parse(keyed.selectExpr("user_id", "event_type", "ordinal", f"{PATH} as path"))
    chosen = cat.prefer_interval_precip(paths).select("user_id", "event_type")
    return series.precipitation_summary(e.join(chosen, ["user_id", "event_type"]), ["user_id", "event_type"])


@query("SELECT user_id, max(value) AS peak_value, arg_min(ts, (-value, ts)) AS peak_time, count(*) AS n_values FROM (SELECT user_id, ts, CASE WHEN event_id % 7 = 0 THEN -901.0 WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY 1")
def peak_raw(spark, sf):
    """Peaks without the mask: markers count as values."""
    v = F.when(F.col("event_id") % 7 == 0, -901.0).when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value"))
    return series.first_peak(samples(spark, sf).withColumn("value", v), ["user_id"], "event_id", mask=False)


@query(f"{SQL_CATALOG} SELECT 'b' AS name, count(*) AS n, count(DISTINCT b) AS n_distinct FROM p UNION ALL SELECT 'c', count(*), count(DISTINCT c) FROM p UNION ALL SELECT 'run_name', count(*), count(DISTINCT run_name) FROM p")
def catalog_summary(spark, sf):
    return cat.summary(catalog(spark, sf), ["b", "c", "run_name"])
