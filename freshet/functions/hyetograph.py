"""Design storms as DataFrame operators; every storm is a group of rows storm_id, i, ...

Curves come as tables, so published kernels are read from files and not kept here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.network import checkpointed
from .interp import interpolate

# Partial to annual duration factors by exceedance percent; limits of the areal reduction by duration.
PARTIAL_TO_ANNUAL = {50: 0.88, 20: 0.96, 10: 0.99}
AREAL_LIMITS = {30: 0.52, 60: 0.65, 180: 0.78, 360: 0.83, 1440: 0.91, 2880: 0.932, 5760: 0.945, 10080: 0.951, 14400: 0.956}
AREAL_DECAY = 0.015
ROWS = 1_000_000  # rows of storms that one task writes out
FEW = 100_000  # readings of curves that are broadcast
FREQUENCY_DURATIONS = (5, 15, 30, 60, 120, 180, 360, 1440)


def _of(storm: list[str], order: str = "i"):
    return W.partitionBy(*storm).orderBy(order)


def frame(increments: DataFrame, minutes: int | Column, storm: list[str] = ["storm_id"], value: str = "incremental_depth") -> DataFrame:
    """storm, i, hour (i * minutes / 60), incremental_depth, cumulative_depth."""
    step = F.lit(minutes) if isinstance(minutes, int) else minutes
    run = _of(storm).rowsBetween(W.unboundedPreceding, W.currentRow)
    return increments.select(*storm, "i", (F.col("i") * step / 60.0).alias("hour"), F.col(value).alias("incremental_depth"), F.sum(value).over(run).alias("cumulative_depth"))


def increments(cumulative: DataFrame, storm: list[str] = ["storm_id"], value: str = "cumulative", scale: Column | float = 1.0, depth: Column | float = 1.0) -> DataFrame:
    """Differences of a cumulative curve divided by ``scale`` and multiplied by ``depth``; the first row keeps its own value."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    c = F.col(value) / lit(scale) * lit(depth)
    return cumulative.withColumn("_c", c).withColumn("incremental_depth", F.col("_c") - F.coalesce(F.lag("_c").over(_of(storm)), F.lit(0.0))).drop("_c")


def steps_of(storms: DataFrame, count: Column) -> DataFrame:
    """A row i = 0 .. count - 1 for each storm."""
    return storms.withColumn("i", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))


def sample_cumulative(storms: DataFrame, knots: DataFrame, curve: str, duration: str = "duration_min", interval: str = "interval_min") -> DataFrame:
    """Cumulative curve read at duration // interval + 1 even places, with the reading before in ``before``; knots' x runs from 0 to 1.

    A curve is read once for each duration and interval, not for each storm; the readings are broadcast while they are few.
    """
    keys = [curve, duration, interval]
    n = F.floor(F.col(duration) / F.col(interval)) + 1
    kinds = checkpointed(storms.groupBy(*keys).agg(F.count("*").alias("storms")))
    total = kinds.agg(F.sum(F.col("storms") * n)).first()[0] or 0
    if total > ROWS:  # a small file of storms is few tasks
        storms = storms.repartition(max(storms.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS)))
    rows = steps_of(kinds.drop("storms"), n).withColumn("x", F.col("i") / (n - 1))
    read = interpolate(rows, knots, curve, out="cumulative").drop("x").withColumn("before", F.lag("cumulative").over(_of(keys)))
    read = checkpointed(read.withColumnsRenamed({k: f"_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return storms.join(F.broadcast(read) if read.count() <= FEW else read.hint("merge"), same).drop(*[f"_{k}" for k in keys])


def resample(pattern: DataFrame, count: int, storm: list[str] = ["storm_id"], value: str = "weight") -> DataFrame:
    """An incremental pattern over another number of steps: running sum, interpolation on [0, 1], differences, unit total."""
    whole = W.partitionBy(*storm)
    run = _of(storm).rowsBetween(W.unboundedPreceding, W.currentRow)
    key = F.concat_ws("\x1f", *storm)
    knots = pattern.select(key.alias("_k"), ((F.col("i") + 1) / F.count("*").over(whole)).alias("x"), F.sum(value).over(run).alias("y"))
    zero = pattern.select(key.alias("_k")).distinct().select("_k", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    points = steps_of(pattern.select(*storm, key.alias("_k")).distinct(), F.lit(count)).withColumn("x", (F.col("i") + 1) / count)
    cum = interpolate(points, knots.unionByName(zero), "_k", out="cumulative").drop("_k", "x")
    inc = increments(cum, storm)
    total = F.sum("incremental_depth").over(whole)
    return inc.select(*storm, "i", F.when(total != 0, F.col("incremental_depth") / total).otherwise(F.col("incremental_depth")).alias(value))


def shift_peak(pattern: DataFrame, percent: Column | float, storm: list[str] = ["storm_id"], value: str = "weight") -> DataFrame:
    """Pattern rolled so that its first maximum lies at int(percent / 100 * n); the vacated end repeats the value next to it."""
    whole = W.partitionBy(*storm)
    n = F.count("*").over(whole)
    top = F.first("i").over(W.partitionBy(*storm).orderBy(F.desc(value), "i"))
    p = percent if isinstance(percent, Column) else F.lit(percent)
    rows = pattern.withColumn("_n", n).withColumn("_s", (p / 100 * n).cast("int") - top)
    rows = rows.withColumn("i", F.pmod(F.col("i") + F.col("_s"), F.col("_n")).cast("int"))
    edge = F.max(F.when(F.col("i") == F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_n") + F.col("_s") - 1), F.col(value))).over(whole)
    filled = F.when((F.col("_s") > 0) & (F.col("i") < F.col("_s")), edge).when((F.col("_s") < 0) & (F.col("i") >= F.col("_n") + F.col("_s")), edge).otherwise(F.col(value))
    rows = rows.withColumn("_v", filled)
    total = F.sum("_v").over(whole)
    return rows.select(*storm, "i", F.when(total != 0, F.col("_v") / total).otherwise(F.col("_v")).alias(value))


def cumulative_storm(storms: DataFrame, knots: DataFrame, curve: str, scale: float = 1.0) -> DataFrame:
    """storm_id, i, hour, incremental_depth, cumulative_depth of storms(storm_id, curve, depth, duration_min, interval_min)
    under cumulative curves(curve, x in 0..1, y in 0..scale). The first row is the curve's value at 0."""
    of = lambda c: F.col(c) / F.lit(scale) * F.col("depth")
    rows = sample_cumulative(storms, knots, curve)
    return rows.select("storm_id", "i", (F.col("i") * F.col("interval_min") / 60.0).alias("hour"), (of("cumulative") - F.coalesce(of("before"), F.lit(0.0))).alias("incremental_depth"), of("cumulative").alias("cumulative_depth"))


def all_types(storms: DataFrame, knots: DataFrame, types: list[str]) -> DataFrame:
    """cumulative_storm of each of storms(storm_id, depth, duration_min, interval_min) under every one of the curves named."""
    every = storms.withColumn("curve", F.explode(F.array(*[F.lit(t) for t in types])))
    own = every.withColumn("storm_id", F.struct("storm_id", "curve"))
    return cumulative_storm(own, knots, "curve").select("storm_id.storm_id", "storm_id.curve", "i", "hour", "incremental_depth", "cumulative_depth")


def pattern_storm(storms: DataFrame, pattern: DataFrame, count: int, native_percent: float = 67.0) -> DataFrame:
    """storms(storm_id, depth, interval_min, peak_pct) under an incremental pattern(storm_id, i, weight): resampled when
    its length differs, shifted when the peak is over half a percent off, with a zero row at time 0."""
    same = pattern.groupBy("storm_id").agg(F.count("*").alias("_n"))
    whole = pattern.join(same, "storm_id")
    sized = whole.where(F.col("_n") == count).select("storm_id", "i", "weight").unionByName(resample(whole.where(F.col("_n") != count).drop("_n"), count))
    p = sized.join(storms.select("storm_id", "peak_pct"), "storm_id")
    off = F.abs(F.col("peak_pct") - native_percent) > 0.5
    moved = shift_peak(p.where(off), F.col("peak_pct")).unionByName(p.where(~off).select("storm_id", "i", "weight"))
    rows = moved.join(storms, "storm_id").select("storm_id", (F.col("i") + 1).alias("i"), (F.col("weight") * F.col("depth")).alias("incremental_depth"), "interval_min")
    first = storms.select("storm_id", F.lit(0).alias("i"), F.lit(0.0).alias("incremental_depth"), "interval_min")
    return frame(rows.unionByName(first), F.col("interval_min"))


def areal_factor(minutes: Column, area: Column) -> Column:
    """Depth-area reduction: 1 - (1 - limit) * (1 - exp(-0.015 * area)); ln-ln interpolation of the loss between the
    tabled durations, whose ends hold beyond them; 1 for no area."""
    xs = sorted(AREAL_LIMITS)
    d = F.greatest(F.lit(float(xs[0])), F.least(F.lit(float(xs[-1])), minutes.cast("double")))
    loss = F.lit(1 - AREAL_LIMITS[xs[-1]])
    for a, b in list(zip(xs, xs[1:]))[::-1]:
        la, lb = 1 - AREAL_LIMITS[a], 1 - AREAL_LIMITS[b]
        share = (F.log(d) - F.log(F.lit(float(a)))) / (F.log(F.lit(float(b))) - F.log(F.lit(float(a))))
        loss = F.when(d <= b, F.exp(F.log(F.lit(la)) + share * (F.log(F.lit(lb)) - F.log(F.lit(la))))).otherwise(loss)
    return F.when(area <= 0, F.lit(1.0)).otherwise(1 - loss * (1 - F.exp(-AREAL_DECAY * area)))


def partial_to_annual(depth: Column, percent: Column) -> Column:
    out = depth
    for p, f in PARTIAL_TO_ANNUAL.items():
        out = F.when(percent == p, depth * f).otherwise(out)
    return out


def augment_depths(depths: DataFrame, storm: str = "storm_id") -> DataFrame:
    """storm, duration, depth with the 10 and 30 minute depths added where they are absent and their neighbours known."""
    at = lambda d: F.max(F.when(F.col("duration") == d, F.col("depth")))
    wide = depths.groupBy(storm).agg(*[at(d).alias(f"d{d}") for d in (5, 10, 15, 30, 60)])
    new = wide.selectExpr(storm, "stack(2, 10, if(d10 is null, 0.59 * d15 + 0.41 * d5, null), 30, if(d30 is null, 0.49 * d60 + 0.51 * d15, null)) as (duration, depth)")
    return depths.select(storm, "duration", "depth").unionByName(new.where("depth is not null"))


def block_place(k: Column, n: Column, percent: Column) -> Column:
    """Place of the k-th placed block: the peak, then left, right, left ..., then whatever side is left."""
    p = F.greatest(F.lit(0), F.least(n - 1, F.floor(percent / 100 * n + 1e-9)))
    left, right = p, n - 1 - p
    turn = F.when(k % 2 == 1, p - (k + 1) / 2).otherwise(p + k / 2)
    return F.when(k == 0, p).when(k <= 2 * F.least(left, right), turn).when(left < right, p + k - left).otherwise(p - (k - right)).cast("int")


def balanced_storm(storms: DataFrame, depths: DataFrame) -> DataFrame:
    """Alternating-block storms of storms(storm_id, duration_min, interval_min, peak_pct, area_sqmi, exceedance_pct)
    and depths(storm_id, duration, depth): reduced by area, log-log cumulative depths, blocks in nested order, zero row first."""
    knots = augment_depths(depths).join(storms.select("storm_id", "area_sqmi", "exceedance_pct"), "storm_id")
    knots = knots.select("storm_id", F.col("duration").cast("double").alias("x"), (partial_to_annual(F.col("depth"), F.col("exceedance_pct")) * areal_factor(F.col("duration"), F.col("area_sqmi"))).alias("y"))
    n = F.floor(F.col("duration_min") / F.col("interval_min")).cast("int")
    rows = steps_of(storms, n).withColumn("x", ((F.col("i") + 1) * F.col("interval_min")).cast("double")).withColumn("n", n)
    cum = interpolate(rows, knots, "storm_id", scale="loglog", out="cumulative")
    inc = increments(cum)
    placed = inc.select("storm_id", (block_place(F.col("i"), F.col("n"), F.col("peak_pct")) + 1).alias("i"), "incremental_depth", "interval_min")
    first = storms.select("storm_id", F.lit(0).alias("i"), F.lit(0.0).alias("incremental_depth"), "interval_min")
    return frame(placed.unionByName(first), F.col("interval_min"))


def triangular(f: Column, a: Column) -> Column:
    """Dimensionless triangular hyetograph, peak at a, b = 1 - a."""
    b = 1 - a
    return F.when(f <= a, f * f / a).otherwise(-f * f / b + (2 * a / b + 2) * f - (a * a / b + a))


def l_gamma(f: Column, b: Column, c: Column) -> Column:
    return F.when(f <= 0, F.lit(0.0)).otherwise(F.pow(f, b) * F.exp(c * (1 - f)))


def monotone(curve: DataFrame, storm: list[str] = ["storm_id"], order: str = "x", value: str = "y") -> DataFrame:
    """Running maximum of a curve, with the number and the largest of the adjustments of each curve."""
    run = W.partitionBy(*storm).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = curve.withColumn("_top", F.max(value).over(run))
    whole = W.partitionBy(*storm)
    lift = F.col("_top") - F.col(value)
    return rows.withColumn("adjusted", F.count_if(lift > 0).over(whole)).withColumn("max_adjustment", F.max(lift).over(whole)).withColumn(value, F.col("_top")).drop("_top")


def compare(storm: DataFrame, golden: DataFrame, on: list[str], value: str = "incremental_depth", other: str = "golden") -> DataFrame:
    """rmse, max_abs_diff, mean_diff, correlation, total_diff, peak_diff by storm; golden has a column ``other``."""
    d = F.col(value) - F.col(other)
    rows = storm.join(golden, on)
    return rows.groupBy("storm_id").agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs_diff"), F.avg(d).alias("mean_diff"), F.corr(value, other).alias("correlation"),
        (F.sum(value) - F.sum(other)).alias("total_diff"), (F.max(value) - F.max(other)).alias("peak_diff"),
    )


def frequency_vector(depths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depths: the depths of FREQUENCY_DURATIONS in order, from depths(keys, duration, depth); missing lists those
    durations that are not there."""
    at = {d: F.max(F.when(F.col("duration") == d, F.col("depth"))) for d in FREQUENCY_DURATIONS}
    wide = depths.groupBy(*keys).agg(*[v.alias(f"d{d}") for d, v in at.items()])
    names = [f"d{d}" for d in FREQUENCY_DURATIONS]
    missing = F.array_compact(F.array(*[F.when(F.col(f"d{d}").isNull(), F.lit(d)) for d in FREQUENCY_DURATIONS]))
    return wide.select(*keys, F.array(*names).alias("depths"), missing.alias("missing"))


def total_of_curve(depths: DataFrame, keys: list[str], order: str | Column = "duration") -> DataFrame:
    """The depth of the longest duration, which alone scales a pattern storm; ``order`` decides instead where durations tie."""
    return depths.groupBy(*keys).agg(F.max("duration").alias("duration"), F.max_by("depth", order).alias("depth"))


def empirical_storm(storms: DataFrame, curves: DataFrame) -> DataFrame:
    """storms(storm_id, curve, depth, duration_min, interval_min) under curves(curve, x, y) in percent, with (0, 0) and
    (100, 100) added and made monotone by a running maximum."""
    ends = curves.select("curve").distinct().select("curve", F.explode(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(100.0).alias("x"), F.lit(100.0).alias("y")))).alias("p"))
    whole = curves.where("x > 0 and x < 100").select("curve", "x", "y").union(ends.select("curve", "p.x", "p.y"))
    up = monotone(whole, ["curve"]).select("curve", (F.col("x") / 100).alias("x"), "y")
    return cumulative_storm(storms, up, "curve", scale=100.0)


def duration_class(storms: DataFrame, classes: DataFrame) -> DataFrame:
    """storms(storm_id, hours) with the one class(lo, hi, name) that holds it, ends included; status ambiguous at a shared
    end, missing outside all."""
    hit = storms.join(F.broadcast(classes), (F.col("hours") >= F.col("lo")) & (F.col("hours") <= F.col("hi")), "left")
    out = hit.groupBy("storm_id").agg(F.count("name").alias("n"), F.min("name").alias("name"))
    return out.select("storm_id", F.when(F.col("n") == 1, F.col("name")).alias("name"), F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))
