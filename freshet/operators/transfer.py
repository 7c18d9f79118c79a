"""Volume-conserving transfer between supports, residual evidence, grids and nearest fill."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import copies

# Metres in a depth unit, cubic metres in an acre-foot, km in a degree at the equator and of latitude.
METRES = {"IN": 0.0254, "MM": 0.001}
ACRE_FOOT_M3 = 1233.48183754752
KM_PER_DEGREE_X, KM_PER_DEGREE_Y = 111.32, 110.574


def multipliers(allocation: DataFrame, sources: DataFrame) -> DataFrame:
    """allocation(cell, subbasin, area), sources(subbasin, area): source area over the received area, rounded to 9."""
    got = allocation.groupBy("subbasin").agg(F.round(F.sum("area"), 9).alias("received"))
    per = sources.select("subbasin", F.col("area").alias("source_area")).join(got, "subbasin").withColumn("multiplier", F.col("source_area") / F.col("received"))
    return allocation.join(per.select("subbasin", "multiplier"), "subbasin")


def apply_transfer(weights: DataFrame, depths: DataFrame, unit: str = "IN") -> DataFrame:
    """weights(cell, subbasin, area, multiplier) and depths(subbasin, t, depth): cell depth and volume in cubic metres (area in m2)."""
    out = weights.join(depths, "subbasin").withColumn("cell_depth", F.col("depth") * F.col("multiplier"))
    return out.withColumn("volume", F.col("cell_depth") * METRES[unit] * F.col("area"))


def volume_evidence(pairs: DataFrame, absolute: float = 1e-6, relative: float = 1e-9) -> DataFrame:
    """pairs(subbasin, step, source, target) by subbasin and step, by subbasin, by step and in all, in one pass.

    residual, tolerance (the larger of absolute and relative to the source) and accepted; subbasin or step is null
    in the rows that sum over it.
    """
    g = pairs.groupingSets([("subbasin", "step"), ("subbasin",), ("step",), ()], "subbasin", "step").agg(F.sum("source").alias("source"), F.sum("target").alias("target"), F.grouping_id().alias("level"))
    r = F.col("target") - F.col("source")
    tol = F.greatest(F.lit(absolute), relative * F.abs("source"))
    return g.select("subbasin", "step", "level", "source", "target", r.alias("residual"), F.abs(r).alias("absolute_residual"), tol.alias("tolerance"), (F.abs(r) <= tol).alias("accepted"))


def volume_effect(cells: DataFrame, keys: list[str], unit: str = "MM") -> DataFrame:
    """cells(keys, depth, area, direct): direct, filled and total volume, m3 and acre-feet, percent filled."""
    v = F.col("depth") * F.col("area") * METRES[unit]
    out = cells.groupBy(*keys).agg(F.sum(F.when(F.col("direct"), v).otherwise(0.0)).alias("direct_m3"), F.sum(F.when(F.col("direct"), 0.0).otherwise(v)).alias("filled_m3"))
    total = F.col("direct_m3") + F.col("filled_m3")
    return out.select("*", total.alias("total_m3"), (total / ACRE_FOOT_M3).alias("total_acft"), F.when(total == 0, 0.0).otherwise(F.col("filled_m3") / total * 100).alias("filled_pct"))


def largest_step_residual(pairs: DataFrame) -> DataFrame:
    """(subbasin, step, residual): the step with the largest absolute residual of each subbasin, ties by step."""
    r = F.col("target") - F.col("source")
    by_step = pairs.groupBy("subbasin", "step").agg(F.sum(r).alias("residual"))
    best = F.min_by(F.struct("step", "residual"), F.struct(-F.abs("residual"), F.col("step")))
    return by_step.groupBy("subbasin").agg(best.alias("_b")).select("subbasin", "_b.*")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 1024, limit: int = 100_000) -> DataFrame:
    """keys and one column for each of ``shares``: the percentile of the values, linear between ranks; nulls and NaN are left out.

    Exact, by refinement: a histogram of ``bins`` ranges of each key says which range holds a wanted rank, and only that one is
    counted on, until it has ``limit`` rows or a single value. Histograms are summed before the shuffle and the ranges that
    are ranked at last are small, so no key's values meet in one task. The input is read once a round and twice more.
    """
    from .network import checkpointed

    v = F.col("_v")
    rows = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = rows.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("total"))
    at = {name: (F.col("total") - 1) * p for name, p in shares.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)]))
    wanted = checkpointed(ends.select("_k", "total", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("total").alias("inside")))
    wide = "inside > {} and lo < hi".format(limit)
    while not wanted.where(wide).isEmpty():
        ranges = wanted.where(wide).select("_k", "lo", "hi").distinct()
        bin_ = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        hist = rows.join(ranges, "_k").where((v >= F.col("lo")) & (v <= F.col("hi"))).groupBy("_k", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("new_lo"), F.max("_v").alias("new_hi"))
        hist = hist.withColumn("upto", F.sum("n").over(W.partitionBy("_k", "lo", "hi").orderBy("bin")))
        rank = F.col("rank") - F.col("below")
        found = wanted.where(wide).join(hist, ["_k", "lo", "hi"]).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
        found = found.select("_k", "total", "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))
        wanted = checkpointed(wanted.where(f"not ({wide})").union(found))
    ranges = wanted.select("_k", "lo", "hi", "below").distinct()
    few = rows.join(ranges, "_k").where((v >= F.col("lo")) & (v <= F.col("hi"))).groupBy("_k", "lo", "hi", "below", "_v").agg(F.count("*").alias("n"))
    few = few.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy("_k", "lo", "hi").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    hit = wanted.join(few.drop("below"), ["_k", "lo", "hi"]).where("rank < upto and rank >= upto - n")
    out = hit.groupBy("_k").agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_at"))
    of = lambda x, f: F.element_at("_at", f(x).cast("long"))
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], *[(of(x, F.floor) + (x - F.floor(x)) * (of(x, F.ceil) - of(x, F.floor))).alias(name) for name, x in at.items()])


def distance_metrics(df: DataFrame, keys: list[str], d: str = "distance") -> DataFrame:
    """keys, min, max, mean and the exact percentiles p50, p90, p95, p99 of the distances."""
    out = df.groupBy(*keys).agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"))
    p = percentiles(df, keys, d, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return out.join(p.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left").drop(*[f"_{k}" for k in keys])


def nearest(points: DataFrame, targets: DataFrame, size: float | None = None, rings: int = 1, dense: int = 256) -> DataFrame:
    """Every row of points(x, y, ...) with tid and distance of the nearest of targets(tid, tx, ty), ties by tid.

    A point meets the targets of the grid buckets around its own; a hit within ``rings * size`` is certain to be the
    nearest. Points without one go on to rings twice as wide, until none is left or the rings hold every target. Without a
    size, buckets hold about eight targets if these are spread evenly; where one holds more than ``dense`` places, a quadtree
    takes the grid's place, in which a point meets a few small leaves however dense the targets are. Repeated
    points each come back; a point with a null or NaN coordinate, or any point without targets, has nulls.
    """
    from . import spatial
    from .network import checkpointed

    lost = [F.lit(None).cast("long").alias("tid"), F.lit(None).cast("double").alias("distance")]
    targets = targets.where("tx is not null and ty is not null and not isnan(tx) and not isnan(ty)")
    bounds = targets.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty"), F.count("*")).first()
    placed = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    seen = points.where(placed).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if bounds[0] is None or seen[0] is None or seen[2] is None:
        return points.select("*", *lost)
    reach = math.hypot(max(bounds[1], seen[1]) - min(bounds[0], seen[0]), max(bounds[3], seen[3]) - min(bounds[2], seen[2]))
    if size is None:
        size = math.sqrt((bounds[1] - bounds[0]) * (bounds[3] - bounds[2]) * 8 / bounds[4]) or max(bounds[1] - bounds[0], bounds[3] - bounds[2]) * 8 / bounds[4] or 1.0
    rows = checkpointed(points.select(F.monotonically_increasing_id().alias("k"), F.struct("*").alias("row")))  # numbers that stay the same
    left = rows.select("k", F.col("row.x").alias("x"), F.col("row.y").alias("y")).where(placed)
    cell = lambda c: F.floor(F.col(c) / size)
    fullest = targets.select("tx", "ty").distinct().groupBy(cell("tx"), cell("ty")).count().agg(F.max("count")).first()[0]
    if fullest > dense:
        out = spatial.nearest(rows.select("k", F.col("row.x").alias("x"), F.col("row.y").alias("y"), "row").where(placed), targets).select("row.*", "tid", "distance")
        return out.union(rows.select("row.*").where(f"not coalesce({placed}, false)").select("*", *lost))
    found = []
    while True:
        b = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        t = targets.select("tid", "tx", "ty", b("tx").alias("bx"), b("ty").alias("by"))
        span = F.sequence(F.lit(-rings), F.lit(rings))
        p = left.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span)).select("k", "x", "y", (b("x") + F.col("_dx")).alias("bx"), (b("y") + F.col("_dy")).alias("by"))
        d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
        hit = p.join(t, ["bx", "by"]).groupBy("k").agg(F.min(F.struct(d.alias("distance"), F.col("tid"))).alias("h")).select("k", "h.tid", "h.distance")
        whole = rings * size > reach
        found.append(checkpointed(hit if whole else hit.where(F.col("distance") <= rings * size)))
        left = checkpointed(left.join(found[-1], "k", "left_anti"))
        if whole or left.isEmpty():
            return rows.join(reduce(DataFrame.union, found), "k", "left").select("row.*", "tid", "distance")
        size *= 2


def cells(boxes: DataFrame, size: float) -> DataFrame:
    """Grid cells (row, col) that each of boxes(id, x0, y0, x1, y1) meets, with the area inside the box."""
    floor = lambda c: F.floor(F.col(c) / size)
    top = lambda c: F.ceil(F.col(c) / size) - 1
    out = boxes.withColumn("col", F.explode(F.sequence(floor("x0"), F.greatest(floor("x0"), top("x1"))))).withColumn("row", F.explode(F.sequence(floor("y0"), F.greatest(floor("y0"), top("y1")))))
    side = lambda k, a, b: F.greatest(F.lit(0.0), F.least((F.col(k) + 1) * size, F.col(b)) - F.greatest(F.col(k) * size, F.col(a)))
    return out.select("id", "row", "col", (side("col", "x0", "x1") * side("row", "y0", "y1")).alias("area"))


def overlap(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes of a(id, x0..y1) and b that overlap, with the area; each pair is formed once, in the bucket that
    holds the lower left corner of its intersection. Equal boxes are one until the pairs are written out."""
    ends = ["x0", "y0", "x1", "y1"]
    (a, same_a), (b, same_b) = copies.kinds(a, ends), copies.kinds(b, ends)
    bx = lambda df, p: df.select(*[F.col(c).alias(f"{p}{n}") for c, n in (("rep", "id"), *[(e, e) for e in ends])])
    spread = lambda df, p: df.withColumn("gx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / size), F.floor(F.col(f"{p}x1") / size)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / size), F.floor(F.col(f"{p}y1") / size))))
    j = spread(bx(a, "a_"), "a_").join(copies.shuffled(spread(bx(b, "b_"), "b_")), ["gx", "gy"])
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - x0, F.least("a_y1", "b_y1") - y0
    met = j.where((w > 0) & (h > 0) & (F.floor(x0 / size) == F.col("gx")) & (F.floor(y0 / size) == F.col("gy"))).select("a_id", "b_id", (w * h).alias("area"))
    return copies.paired(met, same_a, same_b)


def coverage(clips: DataFrame) -> DataFrame:
    """clips(subbasin, kind, area), kind covered, nodata or outside: areas and counts by subbasin and in all."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("area")).otherwise(0.0))
    return clips.rollup("subbasin").agg(of("covered").alias("covered"), of("nodata").alias("nodata"), of("outside").alias("outside"), F.count("*").alias("n"))


def assignments(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """points(id) with their one containing area; status missing or ambiguous where there is none or several."""
    n = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("area_id").alias("area_id"))
    return assigned(points.select("id").join(n, "id", "left")).drop("n")


def assigned(held: DataFrame) -> DataFrame:
    """held(n, area_id, ...), as geometry.holders tells it, with area_id only where there is one, and its status."""
    one = F.when(F.col("n") == 1, F.col("area_id"))
    return held.withColumns({"area_id": one, "status": F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("assigned")})


def travel_length(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Kilometres from each cell(keys, lon, lat) to (out_lon, out_lat); the longitude scale is that of the cells' mean latitude."""
    kx = KM_PER_DEGREE_X * F.cos(F.radians(F.avg("lat").over(W.partitionBy(*keys))))
    return cells.withColumn("length_km", F.sqrt(F.pow((F.col("lon") - F.col("out_lon")) * kx, 2) + F.pow((F.col("lat") - F.col("out_lat")) * KM_PER_DEGREE_Y, 2)))


def polygon_measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """Shoelace area and centroid of closed rings given as points(keys, ord, x, y)."""
    w = W.partitionBy(*keys).orderBy("ord")
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(w)), F.coalesce(F.lead("y").over(w), F.first("y").over(w))
    c = points.withColumn("_nx", nx).withColumn("_ny", ny).withColumn("_c", F.col("x") * F.col("_ny") - F.col("_nx") * F.col("y"))
    out = c.groupBy(*keys).agg((F.sum("_c") / 2).alias("_a"), F.sum((F.col("x") + F.col("_nx")) * F.col("_c")).alias("_x"), F.sum((F.col("y") + F.col("_ny")) * F.col("_c")).alias("_y"))
    return out.select(*keys, F.abs("_a").alias("area"), (F.col("_x") / (6 * F.col("_a"))).alias("cx"), (F.col("_y") / (6 * F.col("_a"))).alias("cy"))


def overlap_metrics(a: Column, b: Column, both: Column) -> list[Column]:
    """Figures for two areas and their intersection: difference, intersection over union, coverages, what each lacks."""
    return [(a - b).alias("area_difference"), (both / (a + b - both)).alias("iou"), (both / b).alias("reference_covered"), (both / a).alias("candidate_covered"), (b - both).alias("false_negative_area"), (a - both).alias("false_positive_area")]


def fingerprint_cost(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared distance of each pair of fingerprints(keys, id, pos, value) with equal keys."""
    x = a.select(*keys, "pos", F.col("id").alias("a_id"), F.col("value").alias("va"))
    y = b.select(*keys, "pos", F.col("id").alias("b_id"), F.col("value").alias("vb"))
    return x.join(y, [*keys, "pos"]).groupBy(*keys, "a_id", "b_id").agg(F.avg(F.pow(F.col("va") - F.col("vb"), 2)).alias("cost"))


def assign(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Least total cost one-to-one assignment of a_id to b_id within each key, by shortest augmenting paths.

    A key's cost matrix is one group (the elements of one record); rows over columns are left out.
    """
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a_id", columns="b_id", values="cost").to_numpy(float)
        m = np.where(np.isnan(m), 1e18, m)
        flip = m.shape[0] > m.shape[1]
        m = m.T if flip else m
        n, k = m.shape
        u, v, match = np.zeros(n + 1), np.zeros(k + 1), np.zeros(k + 1, int)
        for i in range(1, n + 1):
            match[0], j0 = i, 0
            least, way, used = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
            while match[j0]:
                used[j0] = True
                slack = m[match[j0] - 1] - u[match[j0]] - v[1:]
                better = ~used[1:] & (slack < least[1:])
                least[1:][better] = slack[better]
                way[1:][better] = j0
                j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
                delta = least[j1]
                u[match[used]] += delta
                v[used] -= delta
                least[~used] -= delta
                j0 = j1
            while j0:
                match[j0] = match[way[j0]]
                j0 = way[j0]
        rows, cols = sorted(set(pdf.a_id)), sorted(set(pdf.b_id))
        pairs = [(match[j] - 1, j - 1) for j in range(1, k + 1) if match[j]]
        pairs = [(j, i) for i, j in pairs] if flip else pairs
        out = pd.DataFrame([(rows[i], cols[j]) for i, j in pairs], columns=["a_id", "b_id"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out.merge(pdf, on=[*keys, "a_id", "b_id"])[[*keys, "a_id", "b_id", "cost"]]

    return costs.groupBy(*keys).applyInPandas(solve, costs.select(*keys, "a_id", "b_id", "cost").schema)
