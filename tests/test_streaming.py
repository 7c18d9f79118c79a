"""Routing of a stream that comes in any order equals routing of the whole in order."""

import datetime as dt
import random

from freshet.streaming import series

START = dt.datetime(2024, 3, 1)
SCHEMA = "site string, ts timestamp, value double"
RATIO, LOW, HIGH, INITIAL = 0.4, 5.0, 80.0, 20.0


def in_order(rows):
    out, held = {}, {}
    for site, ts, q in sorted(r for r in rows if None not in r):
        if site in held:
            s0, q0, i0 = held[site]
            s = min(max(s0 + i0 - q0, LOW), HIGH)
            held[site] = (s, RATIO * s, q)
        else:
            held[site] = (INITIAL, RATIO * LOW, q)
        out.setdefault((site, ts), []).append((held[site][1], held[site][0]))
    return out


def streamed(spark, tmp_path, batches, late):
    series.state_store(spark)
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = series.route_ordered(src, "site", RATIO, LOW, HIGH, INITIAL, late)
    q = out.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {}
    for r in spark.table("ordered").collect():
        got.setdefault((r.site, r.ts), []).append((r.value, r.storage))
    return got


def test_shuffled_batches_equal_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, START + dt.timedelta(hours=h), round(rng.uniform(0, 60), 3)) for s in ("a", "b") for h in range(36)]
    rows += [("a", START + dt.timedelta(hours=7), 11.0)]  # a second sample of one time
    late_by = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 6)))  # up to six hours out of order
    n = len(late_by) // 4
    batches = [late_by[:n], late_by[n : 2 * n], late_by[2 * n : 3 * n], late_by[3 * n :], [("b", None, 1.0), ("c", START + dt.timedelta(days=9), 1.0)]]
    got, want = streamed(spark, tmp_path, batches, "6 hours"), in_order(rows)
    assert got.keys() == want.keys()
    assert all(sorted(got[k]) == sorted(want[k]) for k in want)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    hour = lambda s, h, q: (s, START + dt.timedelta(hours=h), q)
    batches = [[hour("a", 1, 30.0), hour("a", 3, 30.0)], [hour("a", 20, 10.0)], [hour("a", 2, 99.0)], [hour("a", 60, 1.0)]]
    got = streamed(spark, tmp_path, batches, "2 hours")
    assert got == in_order([hour("a", 1, 30.0), hour("a", 3, 30.0), hour("a", 20, 10.0)])
