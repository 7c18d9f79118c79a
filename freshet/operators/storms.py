"""Rainfall events: sessions of wet hours apart by dry ones, their figures, percentile filter and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .series import hours

WET = 0.01


def storm_catalog(hourly: DataFrame, keys: list[str], gap_hours: int = 8, min_depth: float = 0.75, min_wet: int = 1, buffer_hours: int = 48, percentile: float | None = None) -> DataFrame:
    """Events of hourly(keys, ts, value): a new one after ``gap_hours`` dry hours.

    Depth sums the dry hours inside an event too; figures are rounded to 3 before the percentile and the rank
    (1 is the largest, ties share the smallest). storm_id follows the start times. Hours are sorted by key and day; only a
    day's last wet hour and last start are carried on, so one long series spreads over tasks.
    """
    rows = hourly.withColumn("_day", F.date_trunc("day", "ts")).withColumn("_wet", F.col("value") > WET)
    rows = _carried(rows, keys, F.when(F.col("_wet"), F.col("ts")), "_last", 1)
    start = F.col("_wet") & (F.col("_last").isNull() | (hours(F.col("_last"), F.col("ts")) > gap_hours))
    rows = _carried(rows.withColumn("_start", start), keys, F.when(F.col("_start"), F.col("ts")), "_e", 0).where("_e is not null")
    whole = W.partitionBy(*keys, "_e")
    rows = rows.withColumn("_end", F.max(F.when(F.col("_wet"), F.col("ts"))).over(whole)).where("ts <= _end")
    events = rows.groupBy(*keys, "_e").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("value").alias("_d"), F.max("value").alias("_p"), F.count_if("_wet").alias("wet_hours"))
    events = events.where((F.col("_d") >= min_depth) & (F.col("wet_hours") >= min_wet)).select(
        *keys, "start_time", "end_time",
        (F.col("start_time") - F.expr(f"interval {buffer_hours} hours")).alias("sim_start"), (F.col("end_time") + F.expr(f"interval {buffer_hours} hours")).alias("sim_end"),
        F.round("_d", 3).alias("total_depth_in"), F.round("_p", 3).alias("peak_intensity_in_hr"), (hours(F.col("start_time"), F.col("end_time")) + 1).cast("long").alias("duration_hours"), "wet_hours",
    )
    if percentile is not None:
        cut = events.groupBy(*keys).agg(F.percentile("total_depth_in", F.lit(percentile / 100)).alias("_cut")) if keys else events.agg(F.percentile("total_depth_in", F.lit(percentile / 100)).alias("_cut"))
        events = (events.join(cut, keys) if keys else events.join(F.broadcast(cut))).where("total_depth_in >= _cut").drop("_cut")
    return events.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.desc("total_depth_in")))).withColumn("storm_id", F.row_number().over(W.partitionBy(*keys).orderBy("start_time")))


def _carried(rows: DataFrame, keys: list[str], mark: Column, out: str, before: int) -> DataFrame:
    """Rows with the latest mark up to ``before`` rows back in ``out``: of the same day, else of the days before."""
    rows = rows.withColumn("_m", mark)
    days = rows.groupBy(*keys, "_day").agg(F.max("_m").alias("_m"))
    past = F.max("_m").over(W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    own = F.max("_m").over(W.partitionBy(*keys, "_day").orderBy("ts").rowsBetween(W.unboundedPreceding, -before))
    return rows.withColumn("_own", own).join(days.select(*keys, "_day", past.alias("_past")), [*keys, "_day"]).withColumn(out, F.coalesce("_own", "_past")).drop("_m", "_own", "_past")
