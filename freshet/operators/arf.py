"""Areal reduction factors: curves by area, circular and non-circular factors by depth-distance segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.interp import interpolate, segment

# Published 1-day depth-distance segments, rows (lo, hi, S2 a, S2 b, ARF a, ARF b, ARF c), miles.
SEGMENTS = {
    "austin": [
        (0, 1, 1.0000, 0.1400, 1.0000, 0.0933, 0.0), (1, 2, 0.9490, 0.0890, 0.9490, 0.0593, 0.0170), (2, 3, 0.8410, 0.0350, 0.8410, 0.0233, 0.1610),
        (3, 4.5, 0.8080, 0.0240, 0.8080, 0.0160, 0.2600), (4.5, 9, 0.7750, 0.0167, 0.7750, 0.0111, 0.4828), (9, 13, 0.7420, 0.0130, 0.7420, 0.0087, 1.3737),
        (13, 19, 0.7203, 0.0113, 0.7203, 0.0076, 2.5943), (19, 28, 0.6950, 0.0100, 0.6950, 0.0067, 5.6427), (28, 33, 0.6502, 0.0084, 0.6502, 0.0056, 17.3505),
        (33, 41, 0.6040, 0.0070, 0.6040, 0.0047, 34.1211), (41, 50, 0.3717, 0.0013, 0.3717, 0.0009, 164.3052),
    ],
    "dallas": [
        (0, 2, 1.0000, 0.0600, 1.0000, 0.0400, 0.0), (2, 4, 0.9670, 0.0435, 0.9670, 0.0290, 0.0440), (4, 6, 0.8910, 0.0245, 0.8910, 0.0163, 0.4493),
        (6, 8, 0.8760, 0.0220, 0.8760, 0.0147, 0.6293), (8, 12, 0.8460, 0.0183, 0.8460, 0.0122, 1.2693), (12, 16, 0.8130, 0.0155, 0.8130, 0.0103, 2.8533),
        (16, 18, 0.7650, 0.0125, 0.7650, 0.0083, 6.9493), (18, 24, 0.7200, 0.0100, 0.7200, 0.0067, 11.8093), (24, 27, 0.6880, 0.0087, 0.6800, 0.0058, 17.9533),
        (27, 31, 0.6228, 0.0063, 0.6228, 0.0042, 33.8091), (31, 50, 0.5563, 0.0041, 0.5563, 0.0027, 55.1070),
    ],
    "houston": [
        (0, 1, 1.0000, 0.1200, 1.0000, 0.0800, 0.0), (1, 2, 0.9400, 0.0600, 0.9400, 0.0400, 0.0200), (2, 4, 0.8800, 0.0300, 0.8800, 0.0200, 0.1000),
        (4, 7, 0.8667, 0.0267, 0.8667, 0.0178, 0.1711), (7, 11, 0.8078, 0.0183, 0.8078, 0.0122, 1.1334), (11, 15, 0.7363, 0.0118, 0.7363, 0.0078, 4.0173),
        (15, 20, 0.6800, 0.0080, 0.6800, 0.0053, 8.2360), (20, 50, 0.6187, 0.0049, 0.6187, 0.0033, 16.4138),
    ],
}
CORRECTED_INTERCEPT = ("dallas", 24, 0.6880)
MAX_RADIUS = 50.0


def segments(spark: SparkSession, corrected: bool = False) -> DataFrame:
    """The segments as a table(city, lo, hi, s_a, s_b, f_a, f_b, f_c); optionally with the corrected intercept."""
    rows = []
    for city, some in SEGMENTS.items():
        for s in some:
            fa = CORRECTED_INTERCEPT[2] if corrected and (city, s[0]) == CORRECTED_INTERCEPT[:2] else s[4]
            rows.append((city, float(s[0]), float(s[1]), s[2], s[3], fa, s[5], s[6]))
    return spark.createDataFrame(rows, "city string, lo double, hi double, s_a double, s_b double, f_a double, f_b double, f_c double")


def radius(area: Column) -> Column:
    return F.sqrt(area / math.pi)


def depth_distance(points: DataFrame, corrected: bool = False) -> DataFrame:
    """points(city, r, ...) with s2 = a - b r and arf = a - b r + c / r^2; null outside (0, 1] or beyond 50 miles.

    The table has 30 rows, so each point looks its segment up by a join that broadcasts it.
    """
    hit = segment(points, F.broadcast(segments(points.sparkSession, corrected)), "r", keys=["city"])
    s2 = F.col("s_a") - F.col("s_b") * F.col("r")
    arf = F.col("f_a") - F.col("f_b") * F.col("r") + F.when(F.col("f_c") == 0, 0.0).otherwise(F.col("f_c") / (F.col("r") * F.col("r")))
    held = lambda v: F.when((v > 0) & (v <= 1) & (F.col("r") <= MAX_RADIUS * (1 + 1e-12)), v)
    return hit.withColumn("s2", held(s2)).withColumn("arf", held(arf)).drop("lo", "hi", "s_a", "s_b", "f_a", "f_b", "f_c")


def circular_factor(watersheds: DataFrame, corrected: bool = False) -> DataFrame:
    """watersheds(city, area_mi2, recurrence_yr, duration_hr, ...) with r and arf; null where the method does not hold
    (a duration other than 24 hours, a recurrence below 2 years)."""
    out = depth_distance(watersheds.withColumn("r", radius(F.col("area_mi2"))), corrected)
    return out.withColumn("arf", F.when((F.col("duration_hr") == 24) & (F.col("recurrence_yr") >= 2), F.col("arf"))).drop("s2")


def noncircular_factor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted mean of s2 over cells(keys, city, r, area)."""
    return depth_distance(cells).groupBy(*keys).agg((F.sum(F.col("s2") * F.col("area")) / F.sum("area")).alias("arf"))


def from_curve(points: DataFrame, curve: DataFrame) -> DataFrame:
    """points(duration, area, ...) with arf from curve(duration, area, factor): 1 up to the smallest area, linear, the last
    one beyond, held between the smallest factor and 1."""
    ends = curve.groupBy("duration").agg(F.min("area").alias("_smallest"), F.min("factor").alias("_least"))
    out = interpolate(points.join(ends, "duration"), curve.select("duration", "area", "factor"), "duration", x="area", y="factor", out="_f")
    return out.withColumn("arf", F.when(F.col("area") <= F.col("_smallest"), 1.0).otherwise(F.greatest(F.col("_least"), F.least(F.lit(1.0), F.col("_f"))))).drop("_smallest", "_least", "_f")


def nearest_duration(points: DataFrame, durations: DataFrame) -> DataFrame:
    """points(id, wanted, ...) with the nearest duration of a table(duration, ordinal), the first one at ties.

    The durations travel as one sorted array of one row; a table of durations has a few dozen entries.
    """
    whole = durations.agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("long").alias("o"), F.col("duration").alias("d")))).alias("_all"))
    best = F.array_min(F.transform("_all", lambda k: F.struct(F.abs(k["d"] - F.col("wanted")).alias("x"), k["o"].alias("o"), k["d"].alias("d"))))
    return points.join(F.broadcast(whole)).withColumn("duration", best["d"]).drop("_all")


def apply_factor(depths: DataFrame, factors: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """depths(key, depth, ...) with depth_reduced; a key without a factor takes the mean of all factors."""
    mean = factors.agg(F.avg("arf").alias("_mean"))
    return depths.join(factors.select(key, "arf"), key, "left").join(F.broadcast(mean)).withColumn("arf", F.coalesce("arf", "_mean")).withColumn("depth_reduced", F.round(F.col("depth") * F.col("arf"), digits)).drop("_mean")


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys without a row in the other table, either way."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("missing"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("extra"))
    return left.union(right)
