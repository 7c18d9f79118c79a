"""Nearest targets through a quadtree whose cells follow the targets' density, walked by cells of points together."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .network import checkpointed

STEP, DEEPEST = 2, 50  # levels that one node is split by at once, and the last level
FEW = 4096  # nodes of a level that are broadcast
KEYS = 250_000  # places of cells, without bounds, that are broadcast
TOGETHER, LEAVES = 1024, 64  # points or targets in one row, and leaves


class Quadtree:
    """Nodes (level, ix, iy, px, py, n, x0, x1, y0, y1) over distinct targets(tid, tx, ty): square cells of a box that halve from level
    to level, each with the bounds of its targets and its parent. A cell with more than ``cap`` targets has children.

    One count at the level that even targets would need gives all levels above it; only cells that are still too full are
    counted on below, so even targets take one pass and a dense spot one more pass for each two levels.
    """

    def __init__(self, targets: DataFrame, cap: int, box: tuple | None = None):
        """``box`` (x0, x1, y0, y1) widens the targets' own."""
        b = list(targets.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty"), F.count("*")).first())
        self.targets, self.cap, self.empty = targets, cap, not b[4]
        if self.empty:
            return
        if box is not None:
            b[:4] = [f(x, y) for f, x, y in zip((min, max, min, max), b, box)]
        self.left, self.low, self.width = b[0], b[2], max(b[1] - b[0], b[3] - b[2]) or 1.0
        first = STEP * max(0, math.ceil(math.log(max(b[4] / cap, 1.0), 4) / STEP))
        base = checkpointed(self._bounds(self.at(targets, first), F.lit(1), "tx", "tx", "ty", "ty"))
        self.levels = {level: checkpointed(self._bounds(base.withColumns({c: F.shiftright(c, first - level) for c in ("ix", "iy")}), F.col("n"), "x0", "x1", "y0", "y1")) for level in range(0, first, STEP)}
        self.levels[first] = base
        level = first
        while level + STEP <= DEEPEST:
            full = self.levels[level].where(F.col("n") > cap).select("ix", "iy")
            n = full.count()
            if n == 0:
                break
            inside = self.at(targets, level).join(F.broadcast(full) if n <= FEW else full, ["ix", "iy"], "left_semi")
            level += STEP
            self.levels[level] = checkpointed(self._bounds(self.at(inside, level), F.lit(1), "tx", "tx", "ty", "ty"))
        self.sizes = {level: d.count() for level, d in self.levels.items()}
        self.fullest = cap if level + STEP <= DEEPEST else max(cap, self.levels[level].agg(F.max("n")).first()[0] or 0)  # targets of a leaf
        self.deepest = level

    def cell(self, level: int, x: str, y: str) -> tuple[Column, Column]:
        """The square a place lies in; what lies out of the box belongs to the outermost ones."""
        one = lambda c, start: F.greatest(F.least(F.floor((F.col(c) - F.lit(start)) / F.lit(self.width) * F.lit(2.0**level)), F.lit(2**level - 1)), F.lit(0)).cast("long")
        return one(x, self.left), one(y, self.low)

    def at(self, rows: DataFrame, level: int, x: str = "tx", y: str = "ty") -> DataFrame:
        ix, iy = self.cell(level, x, y)
        return rows.withColumns({"ix": ix, "iy": iy})

    def _bounds(self, rows: DataFrame, n: Column, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
        return rows.groupBy("ix", "iy").agg(F.sum(n).alias("n"), F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1"))

    def children(self, level: int) -> DataFrame:
        """Nodes of the level, keyed (ix, iy) by their parents; broadcast while they are few."""
        d = self.levels[level].select(*[F.shiftright(c, STEP).alias(c) for c in ("ix", "iy")], F.col("ix").alias("cx"), F.col("iy").alias("cy"), "n", "x0", "x1", "y0", "y1")
        return F.broadcast(d) if self.sizes[level] <= FEW else d

    def members(self, levels: list[int]) -> DataFrame:
        """The targets, once for each of the levels, with their cell there."""
        return reduce(DataFrame.union, [self.at(self.targets, i).withColumn("level", F.lit(i)) for i in levels])


def _gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    """The least distance of two ranges."""
    return F.greatest(F.col(b0) - F.col(a1), F.col(a0) - F.col(b1), F.lit(0.0))


def _far(a0: str, a1: str, b0: str, b1: str) -> Column:
    """The largest distance of a place of the first range from the farther end of the second."""
    return F.greatest(F.col(a1) - F.col(b0), F.col(b1) - F.col(a0))


def _near(a0: str, a1: str, b0: str, b1: str) -> Column:
    """The largest distance of a place of the first range from the nearer end of the second."""
    end = lambda v: F.least(F.abs(F.col(v) - F.col(b0)), F.abs(F.col(v) - F.col(b1)))
    middle = (F.col(b0) + F.col(b1)) / 2
    return F.greatest(end(a0), end(a1), F.when((F.col(a0) < middle) & (F.col(a1) > middle), (F.col(b1) - F.col(b0)) / 2).otherwise(F.lit(0.0)))


def _squared(a: Column, b: Column) -> Column:
    return a * a + b * b


_X, _Y = ("px0", "px1", "x0", "x1"), ("py0", "py1", "y0", "y1")
SLACK = 1 + 1e-9
CELL, NODE = ["px", "py"], ["level", "ix", "iy"]
BOX, BOUNDS = ["px0", "px1", "py0", "py1"], ["x0", "x1", "y0", "y1"]


def _lo() -> Column:
    """No point of the cell has a target of the node nearer (squared)."""
    return _squared(_gap(*_X), _gap(*_Y))


def _hi() -> Column:
    """Each point of the cell has a target of the node at most as far: a side of a node's bounds touches one."""
    return F.least(_squared(_near(*_X), _far(*_Y)), _squared(_far(*_X), _near(*_Y)))


def _left(pairs: DataFrame) -> DataFrame:
    """Pairs of a cell of points and a node that can hold the nearest target of one of them; more: the cell has nodes to open."""
    cell = W.partitionBy(*CELL)
    found = pairs.withColumns({"lo": _lo(), "hi": _hi()}).withColumn("best", F.least("best", F.min("hi").over(cell)))
    return found.where(F.col("lo") <= F.col("best") * SLACK).drop("lo", "hi").withColumn("more", F.max("open").over(cell))


def _closest():
    import numpy as np
    import pandas as pd

    def closest(x, y, tid, tx, ty):
        """For each of a row's points the nearest of its targets, which ascend by tid."""
        out = []
        for px, py, i, cx, cy in zip(x, y, tid, tx, ty):
            d = np.full(len(px), np.inf)
            best = np.full(len(px), i[0])
            for a in range(0, len(i), 256):
                some = np.sqrt((px[:, None] - cx[None, a : a + 256]) ** 2 + (py[:, None] - cy[None, a : a + 256]) ** 2)
                at = some.argmin(1)
                low = some[np.arange(len(px)), at]
                nearer = low < d
                d[nearer], best[nearer] = low[nearer], i[a : a + 256][at[nearer]]
            out.append((best, d))
        return pd.DataFrame(out, columns=["tid", "distance"])

    return F.pandas_udf(closest, "tid array<long>, distance array<double>", F.PandasUDFType.SCALAR)


def nearest(points: DataFrame, targets: DataFrame, cap: int = 32) -> DataFrame:
    """Every row of points(k, x, y, ...) with tid and distance of the nearest of targets(tid, tx, ty), ties by tid; no coordinate is null.

    Targets in one place count as one. Cells of points and nodes of targets halve together over one box: a cell keeps the nodes
    that can hold the nearest target of any of its points, and is split until all of these are leaves of at most ``cap``
    targets. So a round writes cells and not points, which are told their cell once at the end, however dense either are.
    """
    targets = checkpointed(targets.groupBy("tx", "ty").agg(F.min("tid").alias("tid")))
    end = float("inf")
    box = points.where((F.abs("x") < end) & (F.abs("y") < end)).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    tree = Quadtree(targets, cap, None if box[0] is None else tuple(box))
    none = points.select("*", F.lit(None).cast("long").alias("tid"), F.lit(None).cast("double").alias("distance"))
    if tree.empty:
        return none
    few = lambda d, n: F.broadcast(d) if n <= KEYS else d

    def cells(rows: DataFrame, level: int) -> DataFrame:
        at = tree.at(rows, level, "x", "y").groupBy("ix", "iy").agg(F.min("x").alias("px0"), F.max("x").alias("px1"), F.min("y").alias("py0"), F.max("y").alias("py1"))
        return at.withColumnsRenamed({"ix": "cx", "iy": "cy"})

    node = [*NODE, *BOUNDS, "open"]
    opens = lambda level: (F.col("n") > cap) & F.lit(level < tree.deepest)
    root = tree.levels[0].select(F.lit(0).alias("level"), "ix", "iy", *BOUNDS, opens(0).alias("open"))
    first = cells(points, 0).select(F.col("cx").alias("px"), F.col("cy").alias("py"), *BOX, F.lit(end).alias("best"))
    walk = checkpointed(_left(first.crossJoin(F.broadcast(root))))  # a row each
    ended = []
    for level in range(0, tree.deepest + 1, STEP):
        ended.append(walk.where("not more").select(F.lit(level).alias("plevel"), *CELL, *NODE))
        walk = walk.where("more")
        split = walk.groupBy(*CELL).agg(F.min("best").alias("best"))
        n = split.count()
        if not n:
            break
        below = level + STEP
        inside = tree.at(points, level, "x", "y").join(few(split.select(F.col("px").alias("ix"), F.col("py").alias("iy")), n), ["ix", "iy"], "left_semi").drop("ix", "iy")
        child = cells(inside, below).withColumns({"px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)}).join(few(split, n), CELL)
        here = tree.levels[below].select(F.col("ix").alias("cx"), F.col("iy").alias("cy"), *BOUNDS)  # a node in the cell's own place bounds the rest
        child = child.join(here, ["cx", "cy"], "left").withColumn("best", F.least("best", _hi())).drop(*BOUNDS)
        opened = walk.where("open").select(*CELL, *BOX, "ix", "iy", "best").join(tree.children(below), ["ix", "iy"]).where(_lo() <= F.col("best") * SLACK)
        opened = opened.select(*CELL, F.lit(below).alias("level"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), *BOUNDS, opens(below).alias("open"))
        pairs = walk.where("not open").select(*CELL, *node).union(opened).join(child, CELL).where(_lo() <= F.col("best") * SLACK)
        walk = checkpointed(_left(pairs.select(F.col("cx").alias("px"), F.col("cy").alias("py"), *BOX, "best", *node)))
    met = reduce(DataFrame.union, ended)
    own = ["plevel", *CELL]
    places = checkpointed(met.groupBy(*own).agg(F.count("*").alias("nodes")))
    n, most = places.agg(F.count("*"), F.max("nodes")).first()
    if not n:
        return none
    at = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("plevel"), *[c.alias(a) for a, c in zip(CELL, tree.cell(r[0], "x", "y"))]) for r in places.select("plevel").distinct().collect()]))
    placed = points.select("*", at.alias("_at")).select(*points.columns, "_at.*").join(few(places.select(*own), n), own)
    shares = checkpointed(placed.groupBy(*own).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares")))
    placed = placed.join(few(shares, n), own).withColumn("share", F.pmod(F.xxhash64("k"), F.col("shares")).cast("int"))
    placed = placed.groupBy(*own, "share").agg(F.collect_list(F.struct(*points.columns)).alias("_p"))

    leaves = checkpointed(met.select(*NODE).distinct())
    levels = sorted(r[0] for r in leaves.select("level").distinct().collect())
    members = tree.members(levels).join(few(leaves, leaves.count()), NODE, "left_semi").withColumn("part", F.floor((F.row_number().over(W.partitionBy(*NODE).orderBy("tid")) - 1) / TOGETHER))
    members = members.groupBy(*NODE, "part").agg(F.collect_list(F.struct("tid", "tx", "ty")).alias("some"))
    lists = met.join(members, NODE).withColumn("part", F.floor((F.row_number().over(W.partitionBy(*own).orderBy(*NODE, "part")) - 1) / LEAVES))
    lists = lists.groupBy(*own, "part").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("some"))
    lists = lists.join(few(shares, n), own).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    each = lambda c, f: F.transform(c, lambda t: t[f])
    hit = placed.join(lists.hint("merge"), [*own, "share"]).withColumn("_h", _closest()(each("_p", "x"), each("_p", "y"), each("some", "tid"), each("some", "tx"), each("some", "ty")))
    hit = hit.select(F.explode(F.arrays_zip(F.col("_p").alias("p"), F.col("_h.tid").alias("tid"), F.col("_h.distance").alias("distance"))).alias("_r"))
    if most * -(-tree.fullest // TOGETHER) > LEAVES:  # some cell's targets come in several rows
        best = hit.groupBy("_r.p.k").agg(F.min(F.struct("_r.distance", "_r.tid")).alias("_h"))
        return points.join(best, "k").select(*points.columns, "_h.tid", "_h.distance")
    return hit.select("_r.p.*", "_r.tid", "_r.distance")
