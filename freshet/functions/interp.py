"""Bracket interpolation: each query point meets the knots on either side of it.

Knots and points are unioned and a window carries the nearest knot before and after each point, so the work is one
sort and no range join. A curve with more than SHARE points is dealt to several shares, each with all its knots, so that
one curve with most points does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.network import checkpointed


SHARE = 1_000_000


def interpolate(points: DataFrame, knots: DataFrame, curve: str, x: str = "x", y: str = "y", scale: str = "linear", out: str = "y") -> DataFrame:
    """``points(curve, x, ...)`` with ``out`` read off ``knots(curve, x, y)``.

    Outside the knots the end value holds. ``scale``: linear, or log-log (positive x and y).
    """
    if scale not in ("linear", "loglog"):
        raise ValueError(f"unknown scale {scale!r}")
    hot = checkpointed(points.groupBy(curve).count().where(F.col("count") > SHARE).select(F.col(curve).alias("_c"), F.ceil(F.col("count") / SHARE).cast("int").alias("_n")))
    if hot.isEmpty():
        points, knots = points.withColumn("_share", F.lit(0)), knots.withColumn("_share", F.lit(0))
    else:
        n = F.coalesce("_n", F.lit(1))
        same = lambda df: df.join(hot, F.col(curve).eqNullSafe(F.col("_c")), "left").drop("_c")
        points = same(points).withColumn("_share", F.pmod(F.xxhash64(*points.columns), n).cast("int")).drop("_n")
        knots = same(knots).withColumn("_share", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    back = W.partitionBy(curve, "_share").orderBy("_x", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    # downwards: a frame to the end of the partition would be read anew for every row
    ahead = W.partitionBy(curve, "_share").orderBy(F.desc("_x"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))
    knot = F.when(F.col("_kind") == 0, here)
    rows = points.withColumn("_x", F.col(x).cast("double")).withColumn("_kind", F.lit(1)).withColumn("_y", F.lit(None).cast("double"))
    known = knots.select(F.col(curve), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_kind"), "_share")
    both = rows.unionByName(known, allowMissingColumns=True)
    both = both.withColumn("_lo", F.last(knot, True).over(back)).withColumn("_hi", F.last(knot, True).over(ahead)).where("_kind = 1")
    return both.withColumn(out, between(F.col("_x"), F.col("_lo"), F.col("_hi"), scale)).drop("_x", "_y", "_kind", "_share", "_lo", "_hi")


def between(x: Column, lo: Column, hi: Column, scale: str = "linear") -> Column:
    """Value at x between two knots struct(x, y); the one that is there, if the other is null."""
    f, g = (F.log, F.exp) if scale == "loglog" else ((lambda c: c), (lambda c: c))
    share = (f(x) - f(lo["x"])) / (f(hi["x"]) - f(lo["x"]))
    return F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == x) | (lo["x"] == hi["x"]), lo["y"]).otherwise(g(f(lo["y"]) + share * (f(hi["y"]) - f(lo["y"]))))


def segment(points: DataFrame, segments: DataFrame, x: str, lo: str = "lo", hi: str = "hi", keys: list[str] | None = None) -> DataFrame:
    """Range join: the segment with lo <= x < hi; a point at a join takes the upper one, beyond the last one the last."""
    last = segments.groupBy(*(keys or [])).agg(F.max(hi).alias("_top")) if keys else segments.agg(F.max(hi).alias("_top"))
    seg = segments.join(last, keys) if keys else segments.join(F.broadcast(last))
    hit = (F.col(x) >= F.col(lo)) & ((F.col(x) < F.col(hi)) | (F.col(hi) == F.col("_top")))
    if keys:
        p, s = points.alias("p"), seg.alias("s")
        on = hit
        for k in keys:
            on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
        return p.join(s, on).drop(*[F.col(f"s.{k}") for k in keys]).drop("_top")
    return points.join(seg, hit).drop("_top")
