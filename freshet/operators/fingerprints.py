"""Vectors that agree within a tolerance in every component: pairs, groups, and groups whose results differ."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import copies
from .network import components, stored

COORDINATES = 10
WIDTHS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 8.0, 16.0, 64.0, 256.0)  # of a cell, in tolerances
ROW = 100  # comparisons that cost as much as one look into a cell
FEW = 1_000_000  # numbers in vectors that are broadcast
UNROLLED = 64


def _moments(vectors: DataFrame) -> list:
    """(k, lo, hi, sd, n) of each component of vectors(id, v)."""
    return vectors.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n")).collect()


def _grid(per: list, tolerance: float) -> list[tuple[int, float, float]]:
    """(component, origin, width) of the grid in which vectors meet, over the components that vary most.

    Number and width are those of the least work: a vector looks into all cells around it that the tolerance touches, (1 + 2
    tolerances / width) for each component, and is compared with what lies there, taken as normally spread. So cells get
    narrower as vectors get more.
    """
    n = max((r.n for r in per), default=0)
    best, least = [], float(ROW + n)
    wide = sorted((r for r in per if r.hi > r.lo and r.sd), key=lambda r: -r.sd)[:COORDINATES]
    for f in WIDTHS:
        grid, looks, share = [], 1.0, 1.0
        for r in wide:
            width = max(f * tolerance, (r.hi - r.lo) / 1024)
            if r.hi - r.lo <= width:
                continue
            grid = [*grid, (r.k, r.lo, width)]
            looks, share = looks * (1 + 2 * tolerance / width), share * min(1.0, width / (2 * math.sqrt(math.pi) * r.sd))
            work = looks * (ROW + n * share)
            if work < least:
                best, least = grid, work
    return best


def _close(n: int, tolerance: float) -> Column:
    """a_v and b_v, of at most n components, differ by the tolerance at most in each; their sizes are equal."""
    if n > UNROLLED:
        return ~F.exists(F.zip_with("a_v", "b_v", lambda x, y: F.abs(x - y) > tolerance), lambda z: z)
    out = F.lit(True)
    for k in range(n):
        out &= F.coalesce(F.abs(F.get("a_v", F.lit(k)) - F.get("b_v", F.lit(k))) <= tolerance, F.lit(True))
    return out


def _whole() -> Column:
    return ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _met(v: DataFrame, per: list, tolerance: float) -> DataFrame:
    """(a_id, b_id), a_id < b_id, once each: the differing labels of vectors(id, v, label) within the tolerance, with their _moments."""
    grid = _grid(per, tolerance)
    at = lambda k, lo, w, shift: F.coalesce(F.floor((F.get("v", F.lit(k)) - F.lit(lo) + F.lit(shift)) / F.lit(w)), F.lit(0))
    own = v.select(F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), F.xxhash64(F.size("v"), *[at(k, lo, w, 0.0) for k, lo, w in grid]).alias("cell"))
    look = v
    slack = tolerance * (1 + 1e-9)
    for n, (k, lo, w) in enumerate(grid):
        low = at(k, lo, w, -slack) if n else at(k, lo, w, 0.0)  # of a pair the one that is lower in the first component looks
        look = look.withColumn(f"_c{n}", F.explode(F.sequence(low, at(k, lo, w, slack))))
    look = look.select(F.col("id").alias("b_id"), F.col("label").alias("b_label"), F.col("v").alias("b_v"), F.xxhash64(F.size("v"), *[F.col(f"_c{n}") for n in range(len(grid))]).alias("cell"))
    once = F.col("a_id") < F.col("b_id")
    if grid:
        a, b = F.get("a_v", F.lit(grid[0][0])), F.get("b_v", F.lit(grid[0][0]))
        once = F.coalesce((a > b) | ((a == b) & once), once)
    own = F.broadcast(own) if sum(r.n for r in per) <= FEW else copies.shuffled(own)
    near = look.join(own, "cell").where((F.col("a_label") != F.col("b_label")) & (F.size("a_v") == F.size("b_v")) & once & _close(len(per), tolerance))
    return near.select(F.least("a_label", "b_label").alias("a_id"), F.greatest("a_label", "b_label").alias("b_id")).distinct()


def near_pairs(vectors: DataFrame, tolerance: float) -> DataFrame:
    """(a_id, b_id), a_id < b_id, of vectors(id, v) of equal length whose components all differ by ``tolerance`` at most.

    Each vector lies in one cell of a grid over a few components; the other one of a pair looks into every cell that the
    tolerance around it touches, so a pair meets once, and is then compared in all components. Vectors with a null id,
    a null or a not finite component take no part. Equal vectors are pairs too: near_groups collapses them first.
    """
    v = stored(vectors.select("id", "v").where("id is not null and v is not null").where(_whole()).withColumn("label", F.col("id")))
    return _met(v, _moments(v), tolerance)


def near_groups(vectors: DataFrame, tolerance: float) -> DataFrame:
    """(id, group) of the vectors that reach another by steps within the tolerance; group is the smallest id of them.

    Equal vectors are one before they are compared, so copies make no pairs. Vectors in one cell of a tolerance's width in every
    component are near each other and have one label, the smallest id; only vectors of different labels are compared, and what is kept
    of them is a pair of labels.
    """
    v = vectors.select("id", "v").where("id is not null and v is not null").where(_whole())
    each = stored(v.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    per = _moments(each)
    label = F.col("first")
    if tolerance > 0 and all(max(abs(r.lo), abs(r.hi)) < 1e5 * tolerance for r in per):  # beyond that the quotients are not exact enough
        cell = F.transform("v", lambda x: F.floor(x / F.lit(tolerance * (1 - 1e-9))))
        label = F.min("first").over(W.partitionBy(cell))
    named = stored(each.select(F.col("first").alias("id"), "v", label.alias("label")))
    pairs = _met(named, per, tolerance).union(named.where("id <> label").select("label", "id"))
    found = components(pairs.toDF("src", "dst"))
    group = each.join(found, each["first"] == found.node, "left").where("n > 1 or component is not null").select("v", F.coalesce("component", "first").alias("group"))
    return v.join(group, "v").select("id", "group").distinct()


def ambiguities(groups: DataFrame, results: DataFrame, tolerance: float) -> DataFrame:
    """(group, n, spread, ambiguous): vectors that cannot be told apart must have results(id, v) that agree within the
    tolerance; spread is the largest difference in one component."""
    rows = groups.join(results, "id")
    n = rows.groupBy("group").agg(F.countDistinct("id").alias("n"))
    per = rows.select("group", F.posexplode("v").alias("k", "x")).groupBy("group", "k").agg((F.max("x") - F.min("x")).alias("d")).groupBy("group").agg(F.max("d").alias("spread"))
    return n.join(per, "group", "left").select("group", "n", F.coalesce("spread", F.lit(0.0)).alias("spread"), (F.coalesce("spread", F.lit(0.0)) > tolerance).alias("ambiguous"))
