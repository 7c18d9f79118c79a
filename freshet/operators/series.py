"""Time series in long form: key, ts (naive), value; ``tie`` breaks equal stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.units import ACRE_FEET_PER_CFS_HOUR
from .transfer import percentiles

# Markers of missing samples.
MISSING = (-901.0, -902.0)
LOWEST = -3.4e38


def hours(a: Column, b: Column) -> Column:
    """Hours from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / 3.6e9


def valid(value: Column) -> Column:
    """Neither null, NaN, infinite nor a marker."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & ~value.isin(*MISSING) & (value > LOWEST), F.lit(False))


def window_of(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Samples from start to end, both included."""
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")
    out = df
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def first_peak(df: DataFrame, keys: list[str], tie: str = "ts", mask: bool = True) -> DataFrame:
    """keys, peak_value, peak_time (first maximum of the valid samples), n_values (all samples).

    One aggregation: struct order puts the larger value first, then the earlier stamp.
    """
    ok = valid(F.col("value")) if mask else F.col("value").isNotNull() & ~F.isnan("value")
    best = F.min(F.when(ok, F.struct((-F.col("value")).alias("v"), F.col("ts").alias("ts"), F.col(tie).alias("tie"))))
    return df.groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("n_values")).where("_b is not null").select(*keys, (-F.col("_b.v")).alias("peak_value"), F.col("_b.ts").alias("peak_time"), "n_values")


def with_previous(df: DataFrame, keys: list[str], tie: str = "ts", unit: str = "day") -> DataFrame:
    """Rows with ``_prev``: struct(ts, tie, value) of the sample before in the key, null for the first.

    Rows are sorted by key and ``unit``, so one long series spreads over tasks; only the last sample of each unit is
    carried to the next one that has any.
    """
    here = F.struct(F.col("ts").alias("ts"), F.col(tie).alias("tie"), F.col("value").alias("value"))
    rows = df.withColumn("_unit", F.date_trunc(unit, "ts"))
    ends = rows.groupBy(*keys, "_unit").agg(F.max(here).alias("_last"))
    ends = ends.select(*keys, "_unit", F.lag("_last").over(W.partitionBy(*keys).orderBy("_unit")).alias("_before"))
    own = F.lag(here).over(W.partitionBy(*keys, "_unit").orderBy("ts", tie))
    return rows.withColumn("_own", own).join(ends, [*keys, "_unit"]).withColumn("_prev", F.coalesce("_own", "_before")).drop("_own", "_before", "_unit")


def with_steps(df: DataFrame, keys: list[str], tie: str = "ts") -> DataFrame:
    """Trapezoid from the sample before: _area in value-hours, null for the first."""
    area = (F.col("value") + F.col("_prev.value")) / 2 * hours(F.col("_prev.ts"), F.col("ts"))
    return with_previous(df, keys, tie).withColumn("_area", area).drop("_prev")


def volume_summary(df: DataFrame, keys: list[str], tie: str = "ts") -> DataFrame:
    """Trapezoidal volume in acre-feet, mean and duration, rounded to 2, largest first. Markers are not masked."""
    out = with_steps(df, keys, tie).groupBy(*keys).agg(
        F.round(F.coalesce(F.sum("_area"), F.lit(0.0)) * ACRE_FEET_PER_CFS_HOUR, 2).alias("total_volume_af"),
        F.round(F.avg("value"), 2).alias("mean_flow"),
        F.round(hours(F.min("ts"), F.max("ts")), 2).alias("duration_hours"),
    )
    return out.orderBy(F.desc("total_volume_af"), *keys)


def statistics(df: DataFrame, keys: list[str], tie: str = "ts") -> DataFrame:
    """Hydrograph statistics: peak and its first time, minimum, mean, median, sample deviation, volume, timing, centroid."""
    origin = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    rows = with_steps(df, keys, tie).withColumn("_t", hours(origin, F.col("ts")))
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("ts").alias("ts")))
    out = rows.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), best.alias("_b"), F.min("value").alias("min_flow"), F.avg("value").alias("mean_flow"),
        F.stddev_samp("value").alias("std_flow"), F.coalesce(F.sum("_area"), F.lit(0.0)).alias("_v"),
        F.sum(F.col("_t") * F.col("value")).alias("_m"), F.sum("value").alias("_s"),
    )
    middle = percentiles(df, keys, "value", {"median_flow": 0.5})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    out = out.join(middle.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    return out.select(
        *keys, "start_time", "end_time", hours(F.col("start_time"), F.col("end_time")).alias("duration_hours"), (-F.col("_b.v")).alias("peak_flow"), F.col("_b.ts").alias("peak_time"),
        "min_flow", "mean_flow", "median_flow", "std_flow", F.round(F.col("_v") * ACRE_FEET_PER_CFS_HOUR, 2).alias("total_volume_af"),
        F.round(hours(F.col("start_time"), F.col("_b.ts")), 2).alias("time_to_peak_hours"), F.when(F.col("_s") != 0, F.round(F.col("_m") / F.col("_s") - hours(origin, F.col("start_time")), 2)).alias("centroid_time"),
    )


def precipitation_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum("value"), 2).alias("total_depth"), F.round(F.max("value"), 2).alias("max_intensity"), F.round(hours(F.min("ts"), F.max("ts")), 2).alias("duration_hours"))


def total_precipitation(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("value").alias("total"), F.count("*").alias("n_values"))


def compare_runs(df: DataFrame, run: str, runs: list[str]) -> DataFrame:
    """Full outer alignment on ts: one column for each run, null where it has no sample; of repeated stamps the largest value."""
    return df.groupBy("ts").pivot(run, runs).agg(F.max("value"))


def interval(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, interval_minutes, regular: whether every step is the same; one sample has no interval."""
    step = hours(F.col("_prev.ts"), F.col("ts")) * 60
    out = with_previous(df, keys).withColumn("_d", step).groupBy(*keys).agg(F.count("*").alias("n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    return out.select(*keys, "n", F.col("_lo").alias("interval_minutes"), F.coalesce((F.col("_lo") == F.col("_hi")) & (F.col("_lo") > 0), F.lit(False)).alias("regular"))


def qualify(df: DataFrame, keys: list[str], sentinel: float = -1e30, final_ratio: float = 0.1, post_peak_hours: float = 6.0, tie: str = "ts") -> DataFrame:
    """Counts of missing, sentinel and negative samples, peak, final value, recession and qualification by key."""
    v = F.col("value")
    low, lost = F.coalesce(v <= sentinel, F.lit(False)), v.isNull() | F.isnan(v)
    ok = ~low & ~lost
    rows = with_previous(df, keys, tie).withColumn("_d", hours(F.col("_prev.ts"), F.col("ts")))
    best = F.min(F.when(ok, F.struct((-v).alias("v"), F.col("ts").alias("ts"), F.col(tie).alias("tie"))))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("record_count"), F.count_if(lost).alias("missing_count"), F.count_if(low).alias("sentinel_count"), F.count_if(ok & (v < 0)).alias("negative_count"),
        F.min(F.when(ok, v)).alias("minimum_value"), best.alias("_b"), F.max(F.when(ok, F.struct("ts", tie, "value"))).alias("_f"), F.max("ts").alias("_e"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"),
    )
    peak, final = -F.col("_b.v"), F.col("_f.value")
    ratio = F.when(peak > 0, final / peak)
    after = hours(F.col("_b.ts"), F.col("_e"))
    regular = F.coalesce((F.col("_lo") == F.col("_hi")) & (F.col("_lo") > 0), F.lit(False))
    return out.select(
        *keys, "record_count", "missing_count", "sentinel_count", "negative_count", "minimum_value", peak.alias("peak_value"), F.col("_b.ts").alias("peak_time"), final.alias("final_value"),
        ratio.alias("final_to_peak_ratio"), after.alias("post_peak_hours"), regular.alias("regular_interval"),
        F.coalesce((ratio <= final_ratio) & (after >= post_peak_hours), F.lit(False)).alias("recession_accepted"),
        ((F.col("missing_count") + F.col("sentinel_count") + F.col("negative_count") == 0) & regular & peak.isNotNull()).alias("qualified"),
    )


def coverage(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched, missing, unexpected stamps of df against expected(keys, ts)."""
    a = df.select(*keys, "ts", F.lit(1).alias("have"))
    b = expected.select(*keys, "ts", F.lit(1).alias("want"))
    return a.join(b, [*keys, "ts"], "full").groupBy(*keys).agg(
        F.count_if(F.col("have").isNotNull() & F.col("want").isNotNull()).alias("matched"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected")
    )


def regular_stamps(df: DataFrame, keys: list[str], step: str = "1 hour") -> DataFrame:
    """The stamps that a regular record from each key's first to last hour would have."""
    span = df.groupBy(*keys).agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("a"), F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("b"))
    return span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("ts"))


def resample(df: DataFrame, keys: list[str], unit: str = "hour", how: str = "avg") -> DataFrame:
    """Left-closed, left-labelled bins."""
    return df.groupBy(*keys, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(getattr(F, how)("value").alias("value"), F.count("*").alias("n"))


def mask_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(valid(F.col("value"))).alias("n_valid"), F.count_if(F.col("value").isin(*MISSING)).alias("n_marked"))


def linear_handoff(df: DataFrame, mappings: DataFrame) -> DataFrame:
    """df(source, ts, value) through mappings(mapping_id, source, target, m, b): value * m + b by mapping."""
    return df.join(mappings, "source").select("mapping_id", "source", "target", "ts", (F.col("value") * F.col("m") + F.col("b")).alias("value"))


def collisions(mappings: DataFrame) -> DataFrame:
    """Targets that several mappings write with different signatures (source, m, b)."""
    return mappings.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("source", "m", "b").alias("signatures")).where("signatures > 1")


def check_regular(df: DataFrame, keys: list[str]) -> DataFrame:
    """Problems that bar a series from being written as a regular record, by key: counts, all zero when it may be."""
    step = hours(F.col("_prev.ts"), F.col("ts")) * 60
    rows = with_previous(df, keys).withColumn("_d", step).withColumn("_bad", (~F.coalesce(F.abs("value") < F.lit(float("inf")), F.lit(False)) | F.isnan("value")).cast("int"))
    return rows.groupBy(*keys).agg(
        F.sum("_bad").alias("non_finite"), F.count_if(F.col("_d") == 0).alias("duplicates"), F.count_if((F.col("_d") > 0) & (F.col("_d") < 1)).alias("sub_minute"),
        F.count_if(F.col("_d").isNotNull() & (F.col("_d") != 0)).alias("_s"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"),
    ).select(*keys, "non_finite", "duplicates", "sub_minute", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).cast("int").alias("irregular"))
