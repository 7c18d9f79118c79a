"""Points in polygons given as vertices(id, part, ring, ord, x, y)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies, overlay
from .network import checkpointed

BOUNDARIES = ("half-open", "covers", "contains")
HELD = 250_000  # places that are broadcast to the points


def _met(places: DataFrame, s: DataFrame, band: float | None, boundary: str) -> DataFrame:
    """(a_id, b_id, contains) of places(rep, px, py) inside the polygons of sides s; contains where the place is not on a side."""
    found = overlay.scale(s)
    band, width = band or found[0], found[1]
    s = s.withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") / band), F.floor(F.col("y2") / band))))
    cell = lambda c: F.floor(F.col(c) / width)
    span = s.groupBy("id", "band").agg(F.min(F.least("x1", "x2")).alias("lo"), F.max(F.greatest("x1", "x2")).alias("hi"))
    # all sides that a polygon has in a band, once for each cell of x that it spans there
    s = s.join(copies.shuffled(span), ["id", "band"]).withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    p = places.withColumn("band", F.floor(F.col("py") / band)).withColumn("cell", cell("px"))
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))
    beside = (y1 <= py) & (py <= y2) & (F.least(x1, x2) <= px) & (px <= F.greatest(x1, x2))
    on = beside & ((x2 - x1) * (py - y1) == (px - x1) * (y2 - y1))
    cross = (y1 <= py) & (py < y2) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    met = p.join(copies.shuffled(s), ["band", "cell"]).where((px >= F.col("lo")) & (px <= F.col("hi"))).where(cross if boundary == "half-open" else cross | on)
    met = met.groupBy(F.col("rep").alias("a_id"), F.col("id").alias("b_id")).agg(F.count_if(cross).alias("n"), F.max(on).alias("on"))
    inside = F.col("n") % 2 == 1
    kept = {"half-open": inside, "covers": inside | F.col("on"), "contains": inside & ~F.col("on")}[boundary]
    return met.where(kept).select("a_id", "b_id", (inside & ~F.col("on")).alias("contains"))


def _shapes(vertices: DataFrame, boundary: str) -> tuple[DataFrame, DataFrame]:
    if boundary not in BOUNDARIES:
        raise ValueError(boundary)
    return overlay.kinds(overlay.sides(vertices, level=boundary != "half-open"))


def within(points: DataFrame, vertices: DataFrame, band: float | None = None, boundary: str = "half-open", told: bool = False) -> DataFrame:
    """(point, id) for points(point, px, py) inside polygons, holes left out, by crossings of a ray to the right; with ``told``
    also contains, which is false for a point on a side.

    Sides and points meet in bands of y (by default as high as a side is on average) and in the cells of x that a polygon
    spans there, so a point sees only the sides of polygons near it. Points in one place and polygons of one shape are one
    until the pairs are written out. ``boundary`` says what counts
    for a point on a side: 'half-open' (in for the lower and left ones, so that areas that share a side share no point),
    'covers' (in) or 'contains' (out). Points without coordinates are in no polygon.
    """
    shapes, same_shape = _shapes(vertices, boundary)
    places, same_place = copies.kinds(points, ["px", "py"], "point")
    met = _met(places, shapes, band, boundary)
    out = copies.paired(met if told else met.select("a_id", "b_id"), same_place, same_shape)
    return out.withColumnsRenamed({"a_id": "point", "b_id": "id"})


def holders(points: DataFrame, vertices: DataFrame, band: float | None = None, boundary: str = "half-open") -> DataFrame:
    """Every row of points(px, py, ...) with n, how many polygons hold it as in ``within``, and area_id, the smallest of them; null where none does.

    They are counted by places and shapes, so no pair is written out. While the places held are at most ``HELD`` they are broadcast and
    the points stay where they are; to more the points go by their place, and those without one stay apart.
    """
    shapes, same_shape = _shapes(vertices, boundary)
    places = checkpointed(points.select("px", "py").dropna().distinct()).withColumn("rep", F.struct("px", "py"))
    size = same_shape.groupBy(F.col("rep").alias("b_id")).agg(F.count("*").alias("_n"))
    met = _met(places, shapes, band, boundary).join(copies.shuffled(size), "b_id")
    held = checkpointed(met.groupBy("a_id").agg(F.sum("_n").alias("n"), F.min("b_id").alias("area_id")).select("a_id.*", "n", "area_id"))
    if held.count() <= HELD:
        return points.join(F.broadcast(held), ["px", "py"], "left")
    placed = F.col("px").isNotNull() & F.col("py").isNotNull()
    out = points.where(placed).join(copies.shuffled(held), ["px", "py"], "left")
    return out.unionByName(points.where(~placed).select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast(held.schema["area_id"].dataType).alias("area_id")))
