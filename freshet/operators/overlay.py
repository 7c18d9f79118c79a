"""Polygons of several parts and rings, as vertices(id, part, ring, ord, x, y): areas, intersections, cells, dissolved outlines.

Ring 0 of a part is its outline, the others are holes; rings may run either way and need not repeat their first point.
A side that a polygon has on its left or right adds or takes off all that lies to the left of it, so a polygon is a sum of
half-open bands and every area here is a sum of integrals over pairs of sides, in plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import copies
from .network import checkpointed

RING = ["id", "part", "ring"]


def whole(vertices: DataFrame) -> DataFrame:
    """vertices with part and ring, zero where the table has no such column; rows without coordinates are left out."""
    for c in ("part", "ring"):
        if c not in vertices.columns:
            vertices = vertices.withColumn(c, F.lit(0))
    return vertices.select(*RING, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def sides(vertices: DataFrame, level: bool = False) -> DataFrame:
    """(id, x1, y1, x2, y2, sign): the sides that are not level, from their lower to their upper end; with ``level`` the level
    ones too, with sign 0.

    sign is 1 where the polygon lies to the left of the side and -1 where it lies to the right; outlines and holes are turned
    by the sign of their own area, so the way they run does not matter. Rings of fewer than three points have no inside
    and cancel out.
    """
    v = whole(vertices)
    ordered, ring = W.partitionBy(*RING).orderBy("ord"), W.partitionBy(*RING)
    ends = v.select("id", "part", "ring", "x", "y", F.coalesce(F.lead("x").over(ordered), F.first("x").over(ordered)).alias("nx"), F.coalesce(F.lead("y").over(ordered), F.first("y").over(ordered)).alias("ny"), F.first("x").over(ordered).alias("ox"), F.first("y").over(ordered).alias("oy"))
    cross = (F.col("x") - F.col("ox")) * (F.col("ny") - F.col("oy")) - (F.col("nx") - F.col("ox")) * (F.col("y") - F.col("oy"))
    turned = F.signum(F.sum(cross).over(ring)) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    up = F.col("ny") > F.col("y")
    kept = "turn <> 0" if level else "y <> ny and turn <> 0"
    sign = F.when(F.col("y") == F.col("ny"), 0.0).when(up, 1.0).otherwise(-1.0)
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return ends.withColumn("turn", turned).where(kept).select("id", pick("x", "nx").alias("x1"), pick("y", "ny").alias("y1"), pick("nx", "x").alias("x2"), pick("ny", "y").alias("y2"), (sign * F.col("turn")).alias("sign"))


def kinds(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, copies) of a table of sides: the sides of the first polygon, by id, of each shape, and copies(id, rep) with every polygon's."""
    ends = ("x1", "y1", "x2", "y2", "sign")
    one, same = copies.kinds(s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*ends))).alias("shape")), ["shape"])
    return checkpointed(one.select(F.col("rep").alias("id"), F.inline("shape"))), same


def areas(vertices: DataFrame) -> DataFrame:
    """(id, area, cx, cy): area and centroid, holes taken off; a polygon without area has null centroid."""
    s = sides(vertices)
    h = F.col("y2") - F.col("y1")
    s = s.withColumn("x0", F.min("x1").over(W.partitionBy("id"))).withColumn("y0", F.min("y1").over(W.partitionBy("id")))  # figures near zero lose no digits
    a, b = F.col("x1") - F.col("x0"), F.col("x2") - F.col("x0")
    area = F.col("sign") * h * (a + b) / 2
    mx = F.col("sign") * h * (a * a + a * b + b * b) / 6
    my = F.col("sign") * h * ((a + b) / 2 * (F.col("y1") - F.col("y0")) + h * (a + 2 * b) / 6)
    out = s.groupBy("id").agg(F.sum(area).alias("area"), F.sum(mx).alias("mx"), F.sum(my).alias("my"), F.min("x0").alias("x0"), F.min("y0").alias("y0"))
    of = lambda m, o: F.when(F.col("area") > 0, F.col(o) + F.col(m) / F.col("area"))
    return out.select("id", "area", of("mx", "x0").alias("cx"), of("my", "y0").alias("cy"))


def banded(s: DataFrame, band: float) -> DataFrame:
    """Sides cut at the multiples of ``band``: each piece with its band k."""
    first, last = F.floor(F.col("y1") / band), F.ceil(F.col("y2") / band) - 1
    cut = s.withColumn("k", F.explode(F.sequence(first, F.greatest(first, last))))
    lo, hi = F.greatest(F.col("y1"), F.col("k") * F.lit(band)), F.least(F.col("y2"), (F.col("k") + 1) * F.lit(band))
    at = lambda y: F.when(y == F.col("y1"), F.col("x1")).when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    return cut.select(*[c for c in s.columns if c not in ("x1", "y1", "x2", "y2")], "k", at(lo).alias("x1"), lo.alias("y1"), at(hi).alias("x2"), hi.alias("y2")).where("y2 > y1")


def smaller_integral(a1: Column, a2: Column, b1: Column, b2: Column, h: Column) -> Column:
    """Integral over a height h of the smaller of two values that run from a1 to a2 and from b1 to b2."""
    d1, d2 = b1 - a1, b2 - a2
    t = d1 / (d1 - d2)
    meet = a1 + t * (a2 - a1)
    crossed = h * (t * (F.least(a1, b1) + meet) + (1 - t) * (meet + F.least(a2, b2))) / 2
    return F.when((d1 >= 0) & (d2 >= 0), h * (a1 + a2) / 2).when((d1 <= 0) & (d2 <= 0), h * (b1 + b2) / 2).otherwise(crossed)


def scale(*tables: DataFrame) -> tuple[float, float]:
    """(band, width) from the mean height of the sides and the mean extent of the polygons, for tables of sides."""
    s = tables[0].select("id", "x1", "x2", "y1", "y2")
    for t in tables[1:]:
        s = s.union(t.select("id", "x1", "x2", "y1", "y2"))
    per = s.groupBy("id").agg(F.sum(F.col("y2") - F.col("y1")).alias("h"), F.count("*").alias("n"), (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"))
    r = per.agg(F.sum("h") / F.sum("n"), F.avg("w")).first()
    band = float(r[0] or 1.0)
    return band, float(r[1] or band)


def intersections(a: DataFrame, b: DataFrame, band: float | None = None, width: float | None = None, least: float = 0.0, own: bool = False) -> DataFrame:
    """(a_id, b_id, area) of each pair of polygons of vertices a and b that share an area over ``least``; with ``own`` only of those with one id.

    Sides are cut at bands of y. In a band only polygons whose spans of x overlap meet, found through cells of ``width``; a
    pair counts in the one cell where its overlap begins. The shared area of a band is the signed sum, over pairs of
    sides with common heights, of the integral of the smaller x: crossing sides need no cutting, and what lies left of both
    cancels out. band and width default to the mean height of a side and the mean extent of a polygon, so that a band
    holds few sides of one polygon. Polygons of one shape are one until the pairs are written out. Polygons with one id are
    one; parts that overlap each other count twice.
    """
    sa, sb = sides(a), sides(b)
    if not own:
        (sa, same_a), (sb, same_b) = kinds(sa), kinds(sb)
    if band is None or width is None:
        found = scale(sa, sb)
        band, width = band or found[0], width or found[1]
    sa, sb = checkpointed(banded(sa, band)), checkpointed(banded(sb, band))
    span = lambda s, p: s.groupBy("k", F.col("id").alias(f"{p}_id")).agg(F.min(F.least("x1", "x2")).alias(f"{p}_lo"), F.max(F.greatest("x1", "x2")).alias(f"{p}_hi"))
    cell = lambda c: F.floor(F.col(c) / width)
    cells = lambda s, p: span(s, p).withColumn("cell", F.explode(F.sequence(cell(f"{p}_lo"), cell(f"{p}_hi"))))
    begins = F.greatest("a_lo", "b_lo")
    meet = begins < F.least("a_hi", "b_hi")
    if own:
        spans = span(sa, "a").join(copies.shuffled(span(sb, "b").withColumnRenamed("k", "_k")), (F.col("k") == F.col("_k")) & (F.col("a_id") == F.col("b_id")))
    else:
        spans = cells(sa, "a").join(copies.shuffled(cells(sb, "b")), ["k", "cell"]).where(F.floor(begins / width) == F.col("cell"))
    pairs = spans.where(meet).select("k", "a_id", "b_id", begins.alias("x0"))
    named = lambda s, p: s.select("k", F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2", "sign")])
    both = pairs.join(copies.shuffled(named(sa, "a")), ["k", "a_id"]).join(copies.shuffled(named(sb, "b")), ["k", "b_id"])
    lo, hi = F.greatest("ay1", "by1"), F.least("ay2", "by2")
    both = both.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    at = lambda p, y: F.col(f"{p}x1") - F.col("x0") + (F.col(y) - F.col(f"{p}y1")) * (F.col(f"{p}x2") - F.col(f"{p}x1")) / (F.col(f"{p}y2") - F.col(f"{p}y1"))
    both = both.select("a_id", "b_id", (F.col("asign") * F.col("bsign")).alias("sign"), (F.col("hi") - F.col("lo")).alias("h"), at("a", "lo").alias("a1"), at("a", "hi").alias("a2"), at("b", "lo").alias("b1"), at("b", "hi").alias("b2"))
    piece = F.col("sign") * smaller_integral(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"), F.col("h"))
    shared = both.groupBy("a_id", "b_id").agg(F.greatest(F.sum(piece), F.lit(0.0)).alias("area")).where(F.col("area") > least)
    return shared if own else copies.paired(shared, same_a, same_b)


def overlap(reference: DataFrame, candidate: DataFrame, band: float | None = None) -> DataFrame:
    """For each id of both coverages the areas, their intersection and union, intersection over union, the shares of either
    that the other covers, and what the candidate misses or adds. An id without a partner, or apart from it, shares nothing."""
    both = intersections(reference, candidate, band, own=True).select(F.col("a_id").alias("id"), F.col("area").alias("shared"))
    r, c = areas(reference).select("id", F.col("area").alias("reference_area")), areas(candidate).select("id", F.col("area").alias("candidate_area"))
    all_ = r.join(copies.shuffled(c), "id", "full").join(copies.shuffled(both), "id", "left").fillna(0.0, ["reference_area", "candidate_area", "shared"])
    one, other, shared = F.col("reference_area"), F.col("candidate_area"), F.col("shared")
    joined = one + other - shared
    part = lambda n, d: F.when(d != 0, n / d)
    return all_.select(
        "id", "reference_area", "candidate_area", (other - one).alias("area_difference"), part((other - one) * 100, one).alias("percent_difference"), shared.alias("intersection_area"), joined.alias("union_area"),
        part(shared, joined).alias("iou"), part(shared, one).alias("reference_covered"), part(shared, other).alias("candidate_covered"), (one - shared).alias("false_negative_area"), (other - shared).alias("false_positive_area"),
    )


def cell_areas(vertices: DataFrame, size: float, least: float = 0.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(id, col, row, area): the area of each polygon, holes taken off, inside each cell of a square grid, those over ``least``.

    Sides are cut at the rows. A side adds to every cell of its row from the polygon's first column there to its own last
    one: the part of the cell's width that lies to its left.
    """
    s = sides(vertices)
    s = s.select("id", "sign", *[(F.col(c) - (x0 if c[0] == "x" else y0)).alias(c) for c in ("x1", "y1", "x2", "y2")])
    cut = banded(s, size)
    first = cut.groupBy("id", "k").agg(F.floor(F.min(F.least("x1", "x2")) / size).alias("first"))
    cut = cut.join(first, ["id", "k"]).withColumn("last", F.ceil(F.greatest("x1", "x2") / size) - 1).where("last >= first")
    each = cut.withColumn("col", F.explode(F.sequence("first", "last")))
    a, b, h = F.col("x1") - F.col("col") * size, F.col("x2") - F.col("col") * size, F.col("y2") - F.col("y1")
    zero, full = F.lit(0.0), F.lit(float(size))
    width = smaller_integral(a, b, full, full, h) - smaller_integral(a, b, zero, zero, h)
    return each.groupBy("id", "col", F.col("k").alias("row")).agg(F.sum(F.col("sign") * width).alias("area")).where(F.col("area") > least)


def coverage(cells: DataFrame, mask: DataFrame, rows: int, cols: int, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """By keys, and in all (null keys): how much of polygons(id, area, keys) the grid's cells of mask(col, row) cover, what lies
    on its other cells (nodata) and what lies outside its extent; from cell_areas of the polygons."""
    inside = (F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols)
    m = mask.select("col", "row").distinct().withColumn("in_mask", F.lit(True))
    c = cells.where(inside).join(m, ["col", "row"], "left")
    c = c.groupBy("id").agg(F.sum(F.when(F.col("in_mask"), F.col("area")).otherwise(0.0)).alias("covered"), F.sum(F.when(F.col("in_mask"), 0.0).otherwise(F.col("area"))).alias("nodata"))
    per = polygons.select("id", "area", *keys).join(c, "id", "left").fillna(0.0, ["covered", "nodata"]).withColumn("outside", F.greatest(F.col("area") - F.col("covered") - F.col("nodata"), F.lit(0.0)))
    total = lambda x: F.sum(x).alias(x)
    out = per.rollup(*keys).agg(total("area"), total("covered"), total("nodata"), total("outside"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    whole_or_all = F.col("_g").isin(0, (1 << len(keys)) - 1)
    return out.where(whole_or_all).select(*keys, "area", "covered", "nodata", "outside", F.when(F.col("area") > 0, F.col("covered") / F.col("area")).alias("coverage"), "n")


def directed(vertices: DataFrame, group: str) -> DataFrame:
    """(group, ax, ay, bx, by): all sides, level ones too, with the polygon to their left."""
    extra = [group] if group != "id" else []
    v = vertices
    for c in ("part", "ring"):
        if c not in v.columns:
            v = v.withColumn(c, F.lit(0))
    v = v.where("x is not null and y is not null")
    ordered, ring = W.partitionBy(*RING).orderBy("ord"), W.partitionBy(*RING)
    nxt = lambda c: F.coalesce(F.lead(c).over(ordered), F.first(c).over(ordered)).alias(f"n{c}")
    ends = v.select(*RING, *extra, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), nxt("x"), nxt("y"))
    turn = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).over(ring) * F.when(F.col("ring") == 0, 1).otherwise(-1)
    ends = ends.withColumn("turn", turn).where("turn <> 0 and (x <> nx or y <> ny)")
    pick = lambda a, b: F.when(F.col("turn") > 0, F.col(a)).otherwise(F.col(b))
    return ends.select(F.col(group).alias("group"), pick("x", "nx").alias("ax"), pick("y", "ny").alias("ay"), pick("nx", "x").alias("bx"), pick("ny", "y").alias("by"))


def dissolve(vertices: DataFrame, group: str, max_rounds: int = 64) -> DataFrame:
    """(group, ring, hole, ord, x, y): the outlines and holes of the union of the polygons of each group of a coverage.

    In a coverage neighbours share whole sides: those have a polygon on either hand and cancel. What is left is chained to
    rings: at a corner where several sides leave, the leftmost turn is taken, so areas that touch in a point stay apart.
    A ring's number is its smallest side, found by pointer doubling, and so is each side's place in its ring: rounds follow
    the logarithm of the longest ring. Outlines run anticlockwise, holes clockwise. Polygons of a group that overlap or
    sides that are shared in part are not noded first; a chain that does not close raises.
    """
    d = directed(vertices, group)
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    net = d.groupBy("group", F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).agg(F.sum(F.when(a < b, 1).otherwise(-1)).alias("n")).where("n <> 0")
    pick = lambda u, v: F.when(F.col("n") > 0, F.col(u)).otherwise(F.col(v))
    s = checkpointed(net.select("group", pick("p", "q").alias("a"), pick("q", "p").alias("b")).withColumn("k", F.monotonically_increasing_id()))
    heading = lambda u, v: F.atan2(v["y"] - u["y"], v["x"] - u["x"])
    leaves = s.select(F.col("group").alias("_g"), F.col("a").alias("_b"), F.col("k").alias("next"), heading(F.col("a"), F.col("b")).alias("out"))
    turn = F.pmod(F.col("out") - heading(F.col("a"), F.col("b")) + F.lit(3.141592653589793), F.lit(6.283185307179586))
    at = checkpointed(s.join(leaves, F.col("group").eqNullSafe(F.col("_g")) & (F.col("b") == F.col("_b"))).groupBy("k").agg(F.max_by("next", turn).alias("next")))
    if at.count() != s.count() or at.select("next").distinct().count() != at.count():
        raise ValueError("the sides of a group do not close to rings: the polygons overlap or share sides in part")
    low = _doubled(at.select("k", "next", F.col("k").alias("v")), lambda own, ahead: F.least(own, ahead), max_rounds).select("k", F.col("v").alias("ring"))
    open_ = at.join(low, "k").select("k", "ring", F.when(F.col("next") == F.col("ring"), F.lit(None).cast("long")).otherwise(F.col("next")).alias("next"), F.lit(1).cast("long").alias("v"))
    places = _doubled(open_.select("k", "next", "v"), lambda own, ahead: own + ahead, max_rounds).select("k", F.col("v").alias("left"))
    rings = s.join(low, "k").join(places, "k")
    size = F.max("left").over(W.partitionBy("ring"))
    area = F.sum(F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")).over(W.partitionBy("ring"))
    return rings.select("group", "ring", (area < 0).alias("hole"), (size - F.col("left")).cast("int").alias("ord"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))


def _doubled(rows: DataFrame, join, max_rounds: int) -> DataFrame:
    """rows(k, next, v) with v joined over all that follow, by pointer doubling; a chain ends at a null next, and a ring, whose
    join must not mind repeats, when no value changes."""
    rows = checkpointed(rows)
    for _ in range(max_rounds):
        ahead = rows.select(F.col("k").alias("next"), F.col("next").alias("_n"), F.col("v").alias("_v"))
        new = rows.join(ahead, "next", "left").select("k", F.when(F.col("next").isNotNull(), F.col("_n")).alias("next"), F.coalesce(join(F.col("v"), F.col("_v")), F.col("v")).alias("v"), F.col("v").alias("was"))
        new = checkpointed(new)
        same = new.where("v <> was").isEmpty()
        rows = new.select("k", "next", "v")
        if same:
            return rows
    raise RuntimeError("pointer doubling: no fixed point")
