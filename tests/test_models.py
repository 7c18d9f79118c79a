"""Storm, routing, network, source, sink and streaming operators against loops, published fixtures and round trips."""

import itertools
import json
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import hyetograph, units
from freshet.functions.interp import interpolate
from freshet.operators import arf, network, overlay, params, routing, series, transfer
from freshet.plans import check_queries, model_queries, series_queries  # noqa: F401
from freshet.sources import sinks, tables, text
from freshet.streaming import series as stream

SF = "/root/testdata/sf0.001"


DISTRIBUTION = """Distribution data
CUMULATIVE PERCENTAGES OF TOTAL PRECIPITATION FOR FIRST-QUARTILE CASES
Time,Percent of occurrence
hours,90%,50%,10%
0,0,0,0
3, 5.5,20.25,61
6,30,70,90
12,100,100,100

CUMULATIVE PERCENTAGES OF TOTAL PRECIPITATION FOR ALL CASES
Time,Percent of occurrence
hours,90%,50%,10%
0,0,0,0
6,12,40,75
12,100,100,100
"""


def test_cumulative_storms_from_distribution_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DISTRIBUTION)
    dist = text.temporal_distributions(text.read_files(spark, str(tmp_path / "d.csv")))
    assert dist.count() == 21 and {r[0] for r in dist.select("quartile").distinct().collect()} == {"FIRST-QUARTILE", "ALL"}
    knots = dist.select(F.concat_ws("|", "quartile", "probability").alias("curve"), (F.col("hours") / 12).alias("x"), F.col("cum_pct").alias("y"))
    storms = spark.createDataFrame([("a", "FIRST-QUARTILE|50%", 8.0, 720, 30), ("b", "ALL|10%", 3.0, 720, 60)], "storm_id string, curve string, depth double, duration_min int, interval_min int")
    got = hyetograph.cumulative_storm(storms, knots, "curve", scale=100.0).collect()
    for name, xs, ys, depth, n in (("a", [0, 0.25, 0.5, 1], [0, 20.25, 70, 100], 8.0, 25), ("b", [0, 0.5, 1], [0, 75, 100], 3.0, 13)):
        own = sorted((r.i, r.hour, r.incremental_depth, r.cumulative_depth) for r in got if r.storm_id == name)
        cum = np.interp(np.linspace(0, 1, n), xs, ys) / 100 * depth
        assert np.allclose([r[3] for r in own], cum) and np.allclose([r[2] for r in own], np.diff(cum, prepend=0)) and own[-1][1] == 12.0


def test_balanced_storm_equals_loop(spark):
    got = {}
    for r in model_queries.balanced_storm(spark, SF).collect():
        got.setdefault(r.storm_id, {})[r.i] = r.incremental_depth
    k = dict(model_queries.KNOTS)
    k[10] = 0.59 * k[15] + 0.41 * k[5]
    k[30] = 0.49 * k[60] + 0.51 * k[15]
    xs = np.array(sorted(k), float)
    lim = sorted(hyetograph.AREAL_LIMITS.items())
    for n in spark.read.parquet(f"{SF}/nation.parquet").collect():
        area, pct = n.n_nationkey * 10.0, n.n_nationkey % 5 * 16 + 17
        loss = np.exp(np.interp(np.log(np.clip(xs, 30, 14400)), np.log([a for a, _ in lim]), np.log([1 - b for _, b in lim])))
        ys = np.array([k[int(x)] for x in xs]) * (1 - loss * (1 - math.exp(-0.015 * area)) if area > 0 else 1)
        t = np.arange(15, 1441, 15.0)
        inc = np.diff(np.exp(np.interp(np.log(t), np.log(xs), np.log(ys))), prepend=0)
        m = len(inc)
        p = min(max(math.floor(pct / 100 * m + 1e-9), 0), m - 1)
        free = sorted(range(m), key=lambda i: i)
        out, lo, hi, left = [0.0] * m, p - 1, p + 1, True
        out[p] = inc[0]
        free.remove(p)
        for v in inc[1:]:
            if (left and lo >= 0) or hi >= m:
                out[lo] = v
                lo -= 1
            else:
                out[hi] = v
                hi += 1
            left = not left
        own = got[n.n_name]
        assert len(own) == m + 1 and own[0] == 0
        assert np.abs(np.array([own[i + 1] for i in range(m)]) - out).max() < 1e-6


def test_pattern_storm_shapes(spark):
    pattern = spark.createDataFrame([("s", i, 1.0 + (i == 8) * 5) for i in range(12)], "storm_id string, i int, weight double")
    storms = spark.createDataFrame([("s", 10.0, 5, 67.0)], "storm_id string, depth double, interval_min int, peak_pct double")
    rows = sorted(hyetograph.pattern_storm(storms, pattern, 24).collect(), key=lambda r: r.i)
    assert len(rows) == 25 and rows[0].incremental_depth == 0 and abs(rows[-1].cumulative_depth - 10) < 1e-9


def test_interpolation_equals_numpy(spark):
    rng = random.Random(1)
    xs = sorted(rng.sample(range(1, 100), 8))
    ys = [rng.random() + 0.1 for _ in xs]
    pts = [(i, "c", rng.random() * 110 + 0.5) for i in range(60)] + [(100 + i, "c", float(x)) for i, x in enumerate(xs)]
    p = spark.createDataFrame(pts, "id int, c string, x double")
    k = spark.createDataFrame([("c", float(a), b) for a, b in zip(xs, ys)], "c string, x double, y double")
    for scale, f, g in (("linear", lambda v: v, lambda v: v), ("loglog", np.log, np.exp)):
        got = {r.id: r.y for r in interpolate(p, k, "c", scale=scale).collect()}
        want = g(np.interp(f(np.array([x for *_, x in pts])), f(np.array(xs, float)), f(np.array(ys))))
        assert max(abs(got[i] - w) for (i, *_), w in zip(pts, want)) < 1e-12


def test_routing_equals_loop(spark):
    curve = {"x": [0.0, 50.0, 200.0], "c": [[0.0, 0.0], [0.002, 0.0], [0.2, 0.4], [0.0, 15.0]], "low": 0.0, "high": 200.0, "initial": 20.0}
    hourly = series.resample(series_queries.samples(spark, SF), ["event_type"]).select("event_type", "ts", "value")
    rows = {}
    for r in hourly.collect():
        rows.setdefault(r.event_type, []).append((r.ts, r.value))
    got = {}
    for r in series_queries.routing_curve(spark, SF).collect():
        got.setdefault(r.event_type, []).append((r.ts, r.value, r.storage))
    f = lambda s: 0.002 * s * s + 0.2 * s if s < 50 else 0.4 * (s - 50) + 15
    for k, some in rows.items():
        s, q, want = 20.0, f(0.0), []
        some.sort()
        for j, (ts, _) in enumerate(some):
            if j:
                s = min(max(s + some[j - 1][1] - q, 0.0), 200.0)
                q = f(s)
            want.append((ts, q, s))
        own = sorted(got[k])
        assert [a for a, *_ in own] == [a for a, *_ in want] and np.allclose([x[1:] for x in own], [x[1:] for x in want], atol=1e-4)
    with pytest.raises(ValueError):
        routing.route(hourly, "event_type", curve | {"high": 100.0})


def test_assignment_is_optimal(spark):
    rng = random.Random(4)
    rows = [(g, a, 10 + b, rng.random()) for g, n, m in ((1, 4, 4), (2, 3, 5), (3, 5, 3)) for a in range(n) for b in range(m)]
    got = transfer.assign(spark.createDataFrame(rows, "g int, a_id int, b_id int, cost double"), ["g"]).collect()
    for g, n, m in ((1, 4, 4), (2, 3, 5), (3, 5, 3)):
        cost = {(a, b): c for k, a, b, c in rows if k == g}
        if n <= m:
            best = min(sum(cost[a, 10 + p[a]] for a in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[b], 10 + b] for b in range(m)) for p in itertools.permutations(range(n), m))
        own = [r for r in got if r.g == g]
        assert len(own) == min(n, m) == len({r.a_id for r in own}) == len({r.b_id for r in own}) and abs(sum(r.cost for r in own) - best) < 1e-9


def test_closure_with_cycle_and_diamond(spark):
    e = spark.createDataFrame([("a", "Subbasin", "b"), ("b", "Diversion", "t"), ("b", "Diversion", "c"), ("c", "Junction", "t"), ("t", "Reach", "a")], "src string, src_type string, dst string")
    got = sorted(r.name for r in network.upstream(e, spark.createDataFrame([("t",)], "target string")).collect())
    assert got == ["a", "b", "b", "c", "t"]


PROJECT = {
    "p.hms": "Project: P\n     Version: 4.0\nEnd:\n",
    "b.basin": "Basin: B1\n     Version: 3\nEnd:\n\nSubbasin: S1\n     Canvas X: 10.5\n     Canvas Y: 2E3\n     Area: 3.5\n     Downstream: J\n     LossRate: Green and Ampt\n     Percent Impervious Area: 1.5\n     Transform: Clark\nEnd:\n\n"
    "Subbasin: S2\n     Area: 1\n     Downstream: D\n     LossRate: Initial+Constant\nEnd:\n\nDiversion: D\n     Downstream: J\n     Divert To: R\nEnd:\n\nJunction: J\n     Downstream: R\nEnd:\n\nReservoir: R\nEnd:\n",
    "m.met": "Meteorology: M\n     Precipitation Method: Gage\n     Use Basin Model: B1\nEnd:\n\nSubbasin: S1\n     Gage: G\nEnd:\n",
    "c.control": "Control: C\n     Start Date: 1 January 2000\n     Start Time: 00:00\n     End Date: 1 January 2000\n     End Time: 24:00\n     Time Interval: 15\nEnd:\n",
    "p.run": "Run: R1\n     Basin: B1\n     Precip: M\n     Control: C\n     DSS File: x.dss\nEnd:\n",
    "p.gage": "Gage: G\n     Gage Type: Precipitation\n     Filename: g.dss\n     Pathname: //G/PRECIP-INC//1HOUR/OBS/\nEnd:\n",
    "p.pdata": "Table: T\n     Table Type: Storage-Outflow\n     DSS File: t.dss\nEnd:\n",
}


def test_project_files(spark, tmp_path):
    for name, content in PROJECT.items():
        (tmp_path / name).write_text(content)
    p = text.load_project(spark, str(tmp_path))
    b = p["basins"].first()
    assert (b.basin, b.n_subbasins, b.n_junctions, b.n_diversions, b.n_reservoirs) == ("B1", 2, 1, 1, 1)
    assert (b.total_area, b.total_area_compat, b.loss_methods) == (4.5, 6.0, "Green and Ampt, Initial+Constant")
    c = p["controls"].selectExpr("cast(end as string) as e", "interval_minutes").first()
    assert tuple(c) == ("2000-01-02 00:00:00", 15.0)
    assert spark.sql("select count(*) from runs join basins using (basin)").first()[0] == 1
    assert tuple(text.gage_assignments(text.read_blocks(spark, str(tmp_path / "m.met"))).first())[1:] == ("S1", "G", 1.0)
    conf = params.configuration(p["runs"].drop("file"), p["basins"].select("basin", "n_subbasins"), p["mets"].select("met", "precip_method"), p["controls"].select("control", "interval_minutes"))
    assert (conf.first().n_subbasins, conf.first().precip_method) == (2, "Gage")
    net = network.edges(params.elements(text.read_blocks(spark, str(tmp_path / "b.basin"))))
    assert sorted((r.src, r.dst) for r in net.collect()) == [("D", "J"), ("D", "R"), ("J", "R"), ("S1", "J"), ("S2", "D")]
    geo = text.element_points(text.read_files(spark, str(tmp_path / "b.basin")))
    assert [(r.name, r.x, r.y) for r in geo.collect()] == [("S1", 10.5, 2000.0)] and text.bounds(geo, ["file"]).first().x0 == 10.5


def test_frequency_tables(spark, tmp_path):
    (tmp_path / "q.txt").write_text("result = 'values';\nquantiles = [['0.398', '0.475'], ['0.6', '0.7'], ['1', '2']];\nupper = [['9']];\n")
    pf = text.point_frequencies(text.read_files(spark, str(tmp_path / "q.txt")))
    assert sorted((r.duration_row, r.ari_col, r.depth) for r in pf.collect())[:3] == [(0, 0, 0.398), (0, 1, 0.475), (1, 0, 0.6)] and pf.count() == 6
    (tmp_path / "d.csv").write_text("Estimates\nby duration for ARI (years):, 1,100\n5-min:, 0.4,1.17\n2-hr:, 1.9,5.77\n3-day:, 4,9\n")
    dt = {(r.duration, r.ari): r.depth for r in text.depth_table(text.read_files(spark, str(tmp_path / "d.csv"))).collect()}
    assert dt == {(5, 1): 0.4, (5, 100): 1.17, (120, 1): 1.9, (120, 100): 5.77, (4320, 1): 4.0, (4320, 100): 9.0}


def test_empirical_curves(spark, tmp_path):
    (tmp_path / "e.csv").write_text("supplement,quartile,duration_class,interval_pct,p50,p90\n1,2,0-12,5,1.5,2\n")
    got = text.empirical_curves(spark, str(tmp_path / "e.csv")).collect()
    assert sorted((r.percentile, r.value) for r in got) == [(50, 1.5), (90, 2.0)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Basin: Größe\n     Area: 1\n     Area: 2\nEnd:\n".encode("cp1252"))
    b = text.read_blocks(spark, str(tmp_path / "a.txt")).first()
    assert (b.kind, b.name, b.attrs["Area"]) == ("Basin", "Größe", "2") and [x.v for x in b.lines] == ["1", "2"]
    (tmp_path / "m.map").write_text("MapGeo: BoundaryMap\nMapSegment: closed\n1, 2\nbad, x\n3, 4\nMapGeo: RiverMap\nMapSegment: open\n5, 6\n")
    m = text.map_segments(text.read_files(spark, str(tmp_path / "m.map"))).orderBy("segment", "ord").collect()
    assert [(r.map_type, r.segment, r.ord, r.x) for r in m] == [("BoundaryMap", 1, 1, 1.0), ("BoundaryMap", 1, 2, 3.0), ("RiverMap", 2, 1, 5.0)]
    (tmp_path / "h").write_text("Parameter Order: X\nSUBBASIN: 85\nGRIDCELL: 1 2 3.5 4.25\nEND:\n")
    assert tuple(text.grid_cells(text.read_files(spark, str(tmp_path / "h"))).first())[1:] == ("85", 1, 2, 3.5, 4.25)
    (tmp_path / "x.log").write_text("NOTE 10185:  Finished\nhello\nERROR 5:  bad\n")
    assert [(r.type, r.code) for r in text.log_lines(text.read_files(spark, str(tmp_path / "x.log"))).collect()] == [("NOTE", 10185), ("ERROR", 5)]


def test_sqlite_layers(spark, tmp_path):
    path = str(tmp_path / "g.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table a(x int, g blob)")
    con.executemany("insert into a values (?, ?)", [(1, b"z"), (2, None)])
    con.execute("create table b(y text)")
    con.commit()
    con.close()
    assert {r.layer: r.n for r in tables.read_layers(spark, path).collect()}.get("a") == 2
    assert json.loads(tables.read_layer(spark, path, "a").orderBy("rowid").first().row) == {"x": 1, "g": "eg=="}


def test_sinks(spark, tmp_path):
    s = series.resample(series_queries.samples(spark, SF).where("user_id = 1"), ["user_id"]).select(F.lit("//B/FLOW//1HOUR/R/").alias("path"), "ts", "value")
    full = series.regular_stamps(s, ["path"]).withColumn("value", F.lit(1.0))
    sinks.write_series(full, str(tmp_path))
    assert tables.read_series(spark, str(tmp_path), ["//B/FLOW//1HOUR/R/"]).count() == full.count()
    with pytest.raises(sinks.Rejected):
        sinks.write_series(full.union(full.limit(1)), str(tmp_path))
    with pytest.raises(sinks.Rejected):
        sinks.write_paired(spark.createDataFrame([("/a/b/", 1, 1.0, 2.0)], "path string, ord int, x double, y double"), str(tmp_path))
    sinks.write_paired(spark.createDataFrame([("/a/b/c/d/e/f/", 1, 1.0, 2.0)], "path string, ord int, x double, y double"), str(tmp_path))
    assert tables.read_paired(spark, str(tmp_path), "/a/b/c/d/e/f/").count() == 1
    grid = spark.createDataFrame([("2024-01-01", 0, 0, 1.0), ("2024-01-02", 1, 1, 2.0)], "t string, row int, col int, value double")
    sinks.write_grid(grid, str(tmp_path))
    assert tables.read_grid(spark, str(tmp_path), (1, 1, 2, 2)).count() == 1
    assert sinks.write_once(grid, str(tmp_path / "once")) and not sinks.write_once(grid, str(tmp_path / "once"))
    with pytest.raises(sinks.Rejected):
        sinks.write_once(grid.limit(1), str(tmp_path / "once"))
    prod = full.select(F.col("ts").alias("time"), F.col("path").alias("mapping_id"), "value")
    sinks.write_product(prod, prod.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/series")).count() == full.count()
    with pytest.raises(sinks.Rejected):
        sinks.write_product(prod, prod.limit(1), str(tmp_path / "p"))


def test_block_edits_round_trip(spark, tmp_path):
    raw = "Subbasin: A\n     Area: 1\n     Lag: 2\nEnd:\n\nReach: R\n     K: 3\nEnd:\n"
    (tmp_path / "x.basin").write_text(raw)
    b = text.read_blocks(spark, str(tmp_path / "x.basin"))
    assert sinks.block_text(b).first().content == raw
    ch = spark.createDataFrame([("Subbasin", "A", "Area", "9"), ("Subbasin", "A", "New", "x"), ("Subbasin", "Z", "Area", "1")], "kind string, name string, k string, v string")
    assert sinks.block_text(sinks.edit_blocks(b, ch)).first().content == raw.replace("Area: 1", "Area: 9")
    assert "     New: x\n" in sinks.block_text(sinks.edit_blocks(b, ch, insert=True)).first().content


def test_geojson(spark):
    v = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), ("a", 3, 1.0, 1.0)], "n string, ord int, x double, y double")
    doc = json.loads(sinks.collection(sinks.shapes_geojson(v, ["n"], True)).first().content)
    assert doc["features"][0]["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    assert json.loads(sinks.points_geojson(v, ["n"]).first().feature)["geometry"]["type"] == "Point"


def test_circular_factor_domain(spark):
    w = spark.createDataFrame([("dallas", 50.3, 100.0, 24.0), ("dallas", 50.3, 1.0, 24.0), ("austin", 9000.0, 100.0, 24.0)], "city string, area_mi2 double, recurrence_yr double, duration_hr double")
    got = {(r.city, r.recurrence_yr): r.arf for r in arf.circular_factor(w).collect()}
    assert round(got["dallas", 100.0], 2) == 0.85 and got["dallas", 1.0] is None and got["austin", 100.0] is None


def test_units(spark):
    assert units.factor("mm", "in") == 1 / 25.4 and units.factor("ft", "FT") == 1
    with pytest.raises(ValueError):
        units.factor("in", "cfs")
    df = spark.createDataFrame([(1.0, "in", "mm"), (1.0, "x", "mm"), (2.0, "m", "m")], "v double, a string, b string")
    assert [r[0] for r in df.select(units.convert_by(F.col("v"), F.col("a"), F.col("b"))).collect()] == [25.4, None, 2.0]
    assert [r[0] for r in spark.createDataFrame([(15,), (60,), (2880,)], "m int").select(units.interval_text(F.col("m"))).collect()] == ["15 Minutes", "1 Hour", "2 Days"]


def test_streams_equal_batch(spark, tmp_path):
    e = series_queries.samples(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    for n, d in enumerate(("2024-01-10", "2024-01-20", "2024-02-10")):
        lo = ("2024-01-01", "2024-01-10", "2024-01-20")[n]
        e.where((F.col("ts") >= lo) & (F.col("ts") < d)).coalesce(1).orderBy("ts").write.mode("append").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    src = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    got = run(stream.hourly_mean(src(), "event_type"), "hourly", "complete")
    want = series.resample(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["event_type"])
    assert got.count() == want.count() and abs(got.agg(F.sum("value")).first()[0] - want.agg(F.sum("value")).first()[0]) < 1e-6
    assert run(stream.storms(src().withColumn("value", F.col("value") / 50), "event_type", 2), "storms", "complete").count() > 5
    assert run(stream.running_peak(src(), "event_type"), "peaks", "complete").count() == 5
    routed = run(stream.route(src(), "event_type", 0.5, 10.0, 60.0, 20.0), "routed", "append")
    assert routed.count() == e.count() and routed.where("storage < 10 or storage > 60").count() == 0


def test_wall_clock_changes(spark):
    from freshet.operators import checks

    rows = [("spring", "2024-03-10 01:30:00"), ("spring", "2024-03-10 02:30:00"), ("spring", "2024-03-10 03:30:00"), ("fall", "2024-11-03 01:30:00"), ("fall", "2024-11-03 03:30:00"), ("calm", "2024-07-01 00:00:00"), ("calm", "2024-07-02 00:00:00")]
    df = spark.createDataFrame(rows, "k string, s string").selectExpr("k", "cast(s as timestamp_ntz) as ts")
    got = {r.k: r for r in checks.wall_clock(df, ["k"], "America/Chicago").collect()}
    assert got["spring"].nonexistent == 1 and got["spring"].offsets > 1
    assert got["fall"].ambiguous == 1
    assert (got["calm"].nonexistent, got["calm"].ambiguous, got["calm"].offsets) == (0, 0, 1)


def test_closed_keys(spark):
    from freshet.operators import checks

    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1, "c": 3}',), (None,), ("[1]",)], "j string")
    got = [(sorted(r.missing), r.unknown) for r in checks.closed_keys(df, "j", ["a", "b"]).collect()]
    assert got == [([], []), (["b"], ["c"]), (["a", "b"], []), (["a", "b"], [])]


def test_empirical_storm_and_vector(spark):
    curves = spark.createDataFrame([("c", 25.0, 10.0), ("c", 50.0, 60.0), ("c", 75.0, 55.0)], "curve string, x double, y double")
    storms = spark.createDataFrame([("s", "c", 2.0, 60, 15)], "storm_id string, curve string, depth double, duration_min int, interval_min int")
    got = sorted((r.i, r.cumulative_depth) for r in hyetograph.empirical_storm(storms, curves).collect())
    assert np.allclose([c for _, c in got], [0, 0.2, 1.2, 1.2, 2.0])
    d = spark.createDataFrame([("s", t, float(t)) for t in hyetograph.FREQUENCY_DURATIONS if t != 30], "k string, duration int, depth double")
    r = hyetograph.frequency_vector(d, ["k"]).first()
    assert r.missing == [30] and r.depths[0] == 5.0 and r.depths[2] is None


def test_within_and_cells_of_a_triangle(spark):
    from freshet.operators import geometry

    tri = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 0.0, 4.0)], "id int, ord int, x double, y double")
    pts = [(i, random.Random(i).uniform(-1, 5), random.Random(i + 999).uniform(-1, 5)) for i in range(200)]
    got = {r.point for r in geometry.within(spark.createDataFrame(pts, "point int, px double, py double"), tri, 1.0).collect()}
    assert got == {i for i, x, y in pts if x > 0 and y > 0 and x + y < 4}
    assert abs(overlay.cell_areas(tri, 1.0).agg(F.sum("area")).first()[0] - 8) < 1e-9


def test_components_of_chains(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    got = {r.node: r.component for r in network.components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_json_documents(spark, tmp_path):
    from freshet.sources import documents

    good = {"schema": "s/1.0", "selector": "r", "units": "CMS", "data_type": "INST-VAL", "interval_minutes": 60, "timestamps": ["2026-11-18T00:00:00Z", "2026-11-18T01:00:00Z"], "values": [0, 17.5]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"extra": 1}))
    (tmp_path / "c.json").write_text(json.dumps(good | {"values": [1]}))
    got = documents.portable_series(text.read_files(spark, str(tmp_path))).collect()
    assert sorted((r.file[-6], r.value, r.problem) for r in got) == [("a", 0.0, None), ("a", 17.5, None), ("b", None, "unknown: extra"), ("c", None, "unequal lengths")]
    grid = {"shape": [2, 2], "cell_size": 1000.0, "origin": [5000.0, 1000.0], "crs": "x", "row_order": "south-to-north"}
    src = {"domain": {"grid": grid}, "times": ["2026-11-01T23:00:00Z", "2026-11-02T00:00:00Z", "2026-11-02T01:00:00Z"], "interval_seconds": 3600, "units": "MM", "data_type": "PER-CUM", "segments": [{"kind": "observed", "first_frame": 0, "frame_count": 1}, {"kind": "forecast", "first_frame": 1, "frame_count": 1}]}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/g.json").write_text(json.dumps({"source": src, "frames": [[[0.0, 1.25], [None, 2.5]], [[4.0, 0.0], [None, 8.5]]], "mask": [[True, True], [False, True]]}))
    rows = documents.forecast_frames(text.read_files(spark, str(tmp_path / "f"))).orderBy("start", "row", "col").collect()
    assert [(r.kind, r.row, r.col, r.value) for r in rows] == [("observed", 0, 0, 0.0), ("observed", 0, 1, 1.25), ("observed", 1, 1, 2.5), ("forecast", 0, 0, 4.0), ("forecast", 0, 1, 0.0), ("forecast", 1, 1, 8.5)]
    assert (rows[0].x, rows[2].y, str(rows[3].end)) == (5500.0, 2500.0, "2026-11-02 01:00:00")
    (tmp_path / "h").mkdir()
    v = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), ("a", 3, 1.0, 1.0)], "n string, ord int, x double, y double")
    (tmp_path / "h/x.geojson").write_text(sinks.collection(sinks.shapes_geojson(v, ["n"], True)).first().content)
    f = documents.features(text.read_files(spark, str(tmp_path / "h")))
    assert f.first().properties == {"n": "a"} and [(r.x, r.y) for r in documents.vertices(f).orderBy("ord").collect()] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]


def test_closure_is_whole_or_raises(spark):
    from freshet.operators import network

    chain = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "src string, dst string")
    target = spark.createDataFrame([("a",)], "target string")
    assert network.closure(chain, target, max_depth=3).count() == 4
    with pytest.raises(RuntimeError):
        network.closure(chain, target, max_depth=2)


def test_nearest_keeps_repeated_and_null_points(spark):
    from freshet.operators import transfer

    p = spark.createDataFrame([(1.0, 1.0, "a"), (1.0, 1.0, "a"), (None, 2.0, "b"), (9.0, 9.0, "c")], "x double, y double, k string")
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 8.0, 8.0), (3, None, 1.0)], "tid long, tx double, ty double")
    got = sorted(((r.k, r.tid) for r in transfer.nearest(p, t, 1.0).collect()), key=str)
    assert got == [("a", 1), ("a", 1), ("b", None), ("c", 2)]
    assert transfer.nearest(p, t.limit(0), 1.0).where("tid is null").count() == 4


def test_percentiles_equal_numpy(spark):
    import numpy as np

    from freshet.operators import transfer

    rng = np.random.default_rng(4)
    rows = [(int(k), float(v)) for k in range(3) for v in rng.integers(0, 40, 50 * k + 1) / 3]
    got = {r.k: r for r in transfer.percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for k in range(3):
        own = [v for g, v in rows if g == k]
        assert np.allclose([got[k].p10, got[k].p50, got[k].p99], np.percentile(own, [10, 50, 99]))


def test_series_that_cannot_be_routed(spark):
    from freshet.operators import routing

    curve = {"x": [0.0, 50.0, 200.0], "c": [[0.0, 0.0], [0.002, 0.0], [0.2, 0.4], [0.0, 15.0]], "low": 0.0, "high": 200.0, "initial": 20.0}
    stamp = lambda *t: [("k", f"2024-01-01 {x}", 1.0) for x in t]
    frame = lambda rows: spark.createDataFrame(rows, "key string, ts string, value double").selectExpr("key", "cast(ts as timestamp_ntz) as ts", "value")
    good = frame(stamp("00:00:00", "00:30:00", "01:00:00", "01:30:00", "02:00:00"))
    out = routing.route_samples(good, "key", curve)
    assert out.count() == 3 and routing.diagnostics(out, "key").first().clips == 0
    for bad in (stamp("00:00:00", "00:30:00", "02:00:00"), stamp("00:10:00", "00:20:00"), stamp("00:00:00", "00:07:00", "00:14:00"), stamp("00:00:00"), [("k", "2024-01-01 00:00:00", -1.0), ("k", "2024-01-01 01:00:00", 1.0)]):
        with pytest.raises(ValueError):
            routing.route_samples(frame(bad), "key", curve)
    with pytest.raises(ValueError):
        routing.route_samples(good, "key", curve | {"low": -1.0})


def test_tree_closure_is_whole_or_raises(spark):
    from freshet.operators import network

    spark.createDataFrame([(i + 1, i) for i in range(150)], "src int, dst int").createOrReplaceTempView("chain")
    spark.createDataFrame([(2, 1), (3, 1), (4, 3), (9, 8)], "src int, dst int").createOrReplaceTempView("tree")
    assert sorted(r.node for r in network.tree_closure(spark, "tree", 1).collect()) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="RECURSION"):
        network.tree_closure(spark, "chain", 0).collect()


def test_hot_curves_are_shared_out(spark, monkeypatch):
    from freshet.functions import interp

    pts = spark.range(200).selectExpr("if(id % 4 = 0, 'b', 'a') as c", "id / 10d as x")
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 7.0, 14.0), ("a", 20.0, 1.0), ("b", 5.0, 5.0)], "c string, x double, y double")
    want = sorted(map(tuple, interp.interpolate(pts, knots, "c").collect()))
    monkeypatch.setattr(interp, "SHARE", 20)
    assert sorted(map(tuple, interp.interpolate(pts, knots, "c").collect())) == want


def test_digest_does_not_depend_on_order(spark):
    from freshet.operators import checks

    df = spark.range(500).selectExpr("id % 2 as g", "id as v")
    one = sorted(map(tuple, checks.content_digest(df, ["g"], ["v"]).collect()))
    two = sorted(map(tuple, checks.content_digest(df.orderBy(df.v.desc()).repartition(7), ["g"], ["v"]).collect()))
    assert one == two and one != sorted(map(tuple, checks.content_digest(df.where("v <> 3"), ["g"], ["v"]).collect()))


def test_project_grids_and_coordinate_systems(spark, tmp_path):
    from freshet.sources import tables, text

    wkt = 'PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4269"]],AUTHORITY["EPSG","{}"]]'
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.prj").write_text(wkt.format(5070))
    (tmp_path / "p.hms").write_text("Project: p\nEnd:\n")
    con = sqlite3.connect(tmp_path / "grid.sqlite")
    con.execute("create table spatial_ref_sys (srid int, srtext text)")
    con.execute("insert into spatial_ref_sys values (1, ?)", (wkt.format(2278),))
    con.commit()
    con.close()
    assert [(r.rank, r.epsg) for r in text.project_crs(spark, str(tmp_path)).orderBy("rank").collect()] == [(1, 2278), (2, 5070)]
    assert [r.file for r in tables.sqlite_files(spark, str(tmp_path)).collect()] == [str(tmp_path / "grid.sqlite")]
    assert text.load_project(spark, str(tmp_path), views=False)["grids"].count() == 1


def test_landed_results(spark, tmp_path):
    from freshet.sources import tables

    spark.sql("select 'a' as element, 'excess' as variable, timestamp_ntz'2024-01-01 00:00:00' as ts, 1d as value, 2 as other union all select 'b', 'precip', timestamp_ntz'2024-01-01 00:00:00', 3d, 4").write.parquet(f"{tmp_path}/results")
    assert [r.element for r in tables.read_results(spark, str(tmp_path), ["excess"]).collect()] == ["a"]
    assert tables.read_results(spark, str(tmp_path), elements=["a", "b"]).columns == ["element", "variable", "ts", "value"]


def test_csv_round_trip(spark, tmp_path):
    from freshet.sources import sinks, tables

    df = spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, sinks.read_csv(spark, f"{tmp_path}/c", "a int, b string").collect())) == [(1, "x, y"), (2, None)]
    df.write.parquet(f"{tmp_path}/catalog")
    assert tables.read_catalog(spark, str(tmp_path)).count() == 2


def test_format_date(spark):
    from freshet.functions import units

    df = spark.sql("select timestamp_ntz'2024-03-05 06:07:00' as t union all select timestamp_ntz'2024-12-31 00:00:00'")
    shown = [tuple(r) for r in df.select("t", units.format_date(df.t).alias("s")).collect()]
    assert len({s for _, s in shown}) == 2 and all(str(t.year) in s for t, s in shown)


def test_features_by_line_and_refused_collections(spark, tmp_path):
    from freshet.sources import sinks

    f = sinks.points_geojson(spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, "b")], "x double, y double, k string"), ["k"])
    sinks.write_features(f, f"{tmp_path}/f")
    assert sorted(json.loads(r.value)["properties"]["k"] for r in spark.read.text(f"{tmp_path}/f").collect()) == ["a", "b"]
    with pytest.raises(sinks.Rejected):
        sinks.collection(f, limit=1)


def test_curve_totals_of_large_keys(spark, tmp_path):
    import duckdb

    from freshet.plans.registry import ORACLES, QUERIES

    rows = [(5, "a", 50, 1.0), (100_005, "a", 49, 2.0), (350_000, "b", 7, 3.0), (1, "b", 9, 4.0), (99, "b", 9, 5.0)]  # keys past 100,000, one tie of places
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["curve_totals"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES["curve_totals"]).fetchall()) == [("a", 50, 2.0), ("b", 9, 3.0)]


def test_storms_of_one_curve_share_its_readings(spark):
    knots = spark.createDataFrame([("A", 0.0, 0.0), ("A", 0.5, 0.2), ("A", 1.0, 1.0), ("B", 0.0, 0.1), ("B", 1.0, 1.0)], "curve string, x double, y double")
    storms = spark.range(1000).selectExpr("id as storm_id", "if(id % 2 = 0, 'A', 'B') as curve", "1 + id * 0.5d as depth", "240 as duration_min", "60 as interval_min")
    assert hyetograph.sample_cumulative(storms.limit(0).union(storms), knots, "curve").where("i = 0").count() == 1000
    out = hyetograph.cumulative_storm(storms, knots, "curve")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # no sort of all storms' rows
    at = {"A": [0.0, 0.1, 0.2, 0.6, 1.0], "B": [0.1, 0.325, 0.55, 0.775, 1.0]}
    for r in out.where("storm_id in (0, 7, 998)").collect():
        y, depth = at["AB"[r.storm_id % 2]], 1 + r.storm_id * 0.5
        assert r.hour == r.i and r.cumulative_depth == pytest.approx(y[r.i] * depth) and r.incremental_depth == pytest.approx((y[r.i] - (y[r.i - 1] if r.i else 0)) * depth)


def test_a_growing_network_is_walked_past_the_first_rounds(spark, monkeypatch):
    from freshet.operators import network

    monkeypatch.setattr(network, "SHALLOW", 3)
    monkeypatch.setattr(network, "FRONTIER", 40)
    real, deep = network.owners, []
    monkeypatch.setattr(network, "owners", lambda *a: deep.append(1) or real(*a))
    target = spark.createDataFrame([(1,), (5,)], "target long")
    up = lambda e: sorted((r.target, r.name) for r in network.upstream(e, target).collect())
    tree = spark.range(2, 600).selectExpr("id as src", "'Reach' as src_type", "id div 2 as dst")
    tree = tree.union(spark.range(7, 600, 7).selectExpr("id", "'Diversion'", "id div 3"))

    def holds(i, t):
        return i == t or i > t and (holds(i // 2, t) or i % 7 == 0 and holds(i // 3, t))

    want = sorted((t, i) for t in (1, 5) for i in range(2, 600) for d in ([i // 2, i // 3] if i % 7 == 0 else [i // 2]) if holds(d, t))
    assert up(tree) == want and not deep
    chain = spark.range(2, 60).selectExpr("id as src", "'Reach' as src_type", "id - 1 as dst")
    assert up(chain) == sorted((t, i) for t in (1, 5) for i in range(t + 1, 60)) and deep
