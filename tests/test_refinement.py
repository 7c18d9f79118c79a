"""Exact percentiles by refinement and routing by composed maps against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest

from freshet.operators import routing, transfer


@pytest.mark.parametrize("bins,limit", [(64, 10), (1024, 100_000)])
def test_percentiles_equal_numpy(spark, bins, limit):
    rng = random.Random(bins)
    groups = {
        "a": [rng.gauss(0, 1) for _ in range(500)], "tail": [10 ** rng.uniform(-9, 9) for _ in range(300)], "tied": [7.0] * 400 + [rng.random() for _ in range(30)],
        "one": [3.5], "two": [1.0, 2.0], "far": [-1e300, 0.0, 1e300, 1e-300], None: [float(k % 5) for k in range(99)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("void", None)]
    rng.shuffle(rows)
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "top": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in transfer.percentiles(df, ["k"], "v", shares, bins, limit).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in shares.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12, abs=1e-12), (k, name)
    both = {r.k: r for r in transfer.distance_metrics(df.where("not isnan(v) or v is null"), ["k"], "v").collect()}
    assert both["void"].p50 is None and both[None].p50 == 2.0 and both["one"].p99 == 3.5
    assert transfer.percentiles(df.limit(0), ["k"], "v", shares).count() == 0


def walk(xs, ratio, low, high, initial):
    s, q = initial, ratio * low
    total, clips = q, 0
    for x in xs[:-1]:
        raw = s + x - q
        s = max(low, min(high, raw))
        q = ratio * s
        total += q
        clips += s != raw
    return s, q, total, clips


@pytest.mark.parametrize("fan,ratio", [(7, 0.5), (7, 1.75), (64, 1.0)])
def test_linear_routing_equals_a_walk(spark, monkeypatch, fan, ratio):
    monkeypatch.setattr(routing, "FAN", fan)
    rng = random.Random(7)
    series = {k: [rng.choice([0.0, 3.0, 25.0, 90.0]) + rng.random() for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 130), ("e", 300), (None, 40))}
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=i if k != "c" else i * i * 50), x) for k, xs in series.items() for i, x in enumerate(xs)] + [("bad", t0, 1.0), ("bad", t0 + dt.timedelta(hours=1), None)]
    rng.shuffle(rows)
    got = {r.k: r for r in routing.route_linear(spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double"), "k", ratio, 10.0, 60.0, 20.0).collect()}
    for k, xs in series.items():
        s, q, total, clips = walk(xs, ratio, 10.0, 60.0, 20.0)
        r = got[k]
        assert (r.final_storage, r.final_outflow, r.total_outflow) == pytest.approx((s, q, total)), k
        assert r.clips == clips
    assert got["bad"].final_storage is None and got["bad"].clips is None


def test_outflows_that_cannot_be(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), 1.0) for h in range(5)], "k string, ts timestamp_ntz, value double")
    with pytest.raises(ValueError):
        routing.route_linear(rows, "k", 0.5, -1.0, 60.0, 20.0)
    curve = {"x": [0.0, 10.0, 20.0], "c": [[0.0, 0.0], [0.0, 0.0], [1.0, -9.0], [0.0, 10.0]], "low": 0.0, "high": 20.0, "initial": 9.0}
    with pytest.raises(Exception, match="negative or not finite outflow"):
        routing.route(rows.withColumn("value", rows.value * 10), "k", curve).collect()


def test_folded_sort_orders_rows(spark):
    from freshet.operators import params

    names = ["beta", "Alpha", "ALPHA", "alpha", "Beta", "gamma", "GAMMA", "delta"]
    got = [r.name for r in params.folded_order(spark.createDataFrame([(n,) for n in names], "name string").repartition(3), "name").collect()]
    assert got == sorted(names, key=lambda n: (n.lower(), n))


def test_digests_of_known_bytes(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from freshet.operators import digests

    t0 = dt.datetime(2024, 1, 1, 0, 0, 59, 500_000)
    series = {"a": [1.0, -2.5, None, 1e300], None: [0.0], "long": [float(k) / 3 for k in range(30_000)]}
    rows = [(k, t0 + dt.timedelta(hours=i), v, "x") for k, vs in series.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    got = {r.k: r for r in digests.series_digests(spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double, n string"), ["k"]).collect()}
    for k, vs in series.items():
        assert got[k].n == len(vs)
        assert got[k].ordinate_sha256 == hashlib.sha256(np.array([np.nan if v is None else v for v in vs], "<f8").tobytes()).hexdigest()
        stamps = "\n".join((t0 + dt.timedelta(hours=i)).isoformat(timespec="seconds") for i in range(len(vs)))
        assert got[k].timestamp_sha256 == hashlib.sha256(stamps.encode()).hexdigest()
    text = ['{"b": 1, "a": {"ü": [1.50, null]}}', "{", None]
    seen = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").orderBy("i").select(digests.canonical_sha256(F.col("t")).alias("d")).collect()]
    assert seen == [hashlib.sha256(json.dumps(json.loads(text[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest(), None, None]
