"""Queries on polygons: overlays, dissolved outlines, projections."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import projection
from ..operators import fingerprints, geometry, overlay, transfer
from .registry import query, table

# A frame is a diamond with a diamond hole; in u = x + y and v = x - y both are squares, which the SQL uses.
CORNERS = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))


def frames(rows, keep=()):
    """Frames around (x, y) of outer radius r and hole radius q as vertices: rows(id, x, y, r, q), the outline clockwise for odd ids."""
    ring = F.explode(F.array(*[F.struct(F.lit(k).alias("ring"), F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k in (0, 1) for i, (a, b) in enumerate(CORNERS)]))
    size = F.when(F.col("c.ring") == 0, F.col("r")).otherwise(F.col("q"))
    turn = F.when(F.col("id") % 2 == 1, -F.col("c.i")).otherwise(F.col("c.i"))
    return rows.withColumn("c", ring).where(size > 0).select("id", *keep, F.lit(0).alias("part"), "c.ring", turn.alias("ord"), (F.col("x") + size * F.col("c.a")).alias("x"), (F.col("y") + size * F.col("c.b")).alias("y"))


CUSTOMER = ("c_custkey", "c_custkey % 89 * 1.7d", "c_custkey % 97 * 1.3d", "1 + c_custkey % 5 * 0.5d", "c_custkey % 3 * 0.3d")
SUPPLIER = ("s_suppkey", "s_suppkey % 31 * 4.9d", "s_suppkey % 29 * 4.1d", "3 + s_suppkey % 4 * 1.1d", "s_suppkey % 2 * 1.5d")


def shapes(spark, sf, name, columns, *more):
    return table(spark, sf, name).selectExpr(*[f"{c} as {n}" for c, n in zip(columns, ("id", "x", "y", "r", "q"))], *more)


def sql_shapes(name, columns):
    k, x, y, r, q = (re.sub(r"(\d)d", r"\1", c) for c in columns)
    return f"SELECT {k} AS id, {x} + {y} AS u, {x} - ({y}) AS v, {r} AS r, {q} AS q FROM {name}"


# Shared area of two diamonds: half that of their squares in u and v.
MACRO = "greatest(0, least(a.u + a.{0}, b.u + b.{1}) - greatest(a.u - a.{0}, b.u - b.{1})) * greatest(0, least(a.v + a.{0}, b.v + b.{1}) - greatest(a.v - a.{0}, b.v - b.{1})) / 2"
SHARED = f"({MACRO.format('r', 'r')} - {MACRO.format('q', 'r')} - {MACRO.format('r', 'q')} + {MACRO.format('q', 'q')})"


@query(f"WITH a AS ({sql_shapes('customer', CUSTOMER)}), b AS ({sql_shapes('supplier', SUPPLIER)}) SELECT a.id AS a_id, b.id AS b_id, round(CAST({SHARED} AS DOUBLE), 6) AS area FROM a JOIN b ON abs(a.u - b.u) < a.r + b.r AND abs(a.v - b.v) < a.r + b.r WHERE {SHARED} > 1e-6")
def polygon_overlay(spark, sf):
    """Shared areas of the customers' and the suppliers' frames."""
    a, b = frames(shapes(spark, sf, "customer", CUSTOMER)), frames(shapes(spark, sf, "supplier", SUPPLIER))
    return overlay.intersections(a, b, least=1e-6).withColumn("area", F.round("area", 6))


MOVED = ("c_custkey", "c_custkey % 89 * 1.7d + c_custkey % 7 * 0.4d", "c_custkey % 97 * 1.3d", "1.2d + c_custkey % 5 * 0.5d", "c_custkey % 3 * 0.2d")


@query(
    f"""WITH a AS ({sql_shapes('customer', CUSTOMER)}), b AS ({sql_shapes('customer', MOVED)}),
m AS (SELECT a.id, CAST(2 * (a.r * a.r - a.q * a.q) AS DOUBLE) AS ra, CAST(2 * (b.r * b.r - b.q * b.q) AS DOUBLE) AS ca, CAST({SHARED} AS DOUBLE) AS s FROM a JOIN b ON a.id = b.id)
SELECT id, round(ra, 11) AS reference_area, round(ca, 11) AS candidate_area, round(ca - ra, 11) AS area_difference, round((ca - ra) / ra * 100, 11) AS percent_difference, round(s, 11) AS intersection_area, round(ra + ca - s, 11) AS union_area, round(s / (ra + ca - s), 11) AS iou,
round(s / ra, 11) AS reference_covered, round(s / ca, 11) AS candidate_covered, round(ra - s, 11) AS false_negative_area, round(ca - s, 11) AS false_positive_area FROM m"""
)
def watershed_overlap(spark, sf):
    """The customers' frames against moved and resized ones: each pair's areas, overlap and coverage."""
    out = overlay.overlap(frames(shapes(spark, sf, "customer", CUSTOMER)), frames(shapes(spark, sf, "customer", MOVED)))
    return out.select("id", *[F.round(c, 11).alias(c) for c in out.columns if c != "id"])


# The part of a diamond's area left of x = s and below y = t, by its corner's distances, is a difference of squares.
@query(
    """WITH f AS (SELECT c_custkey AS id, c_nationkey AS nation, CAST(c_custkey % 89 * 1.7 AS DOUBLE) AS x, CAST(c_custkey % 97 * 1.3 AS DOUBLE) AS y, CAST(1 + c_custkey % 5 * 0.5 AS DOUBLE) AS r, CAST(c_custkey % 3 * 0.3 AS DOUBLE) AS q FROM customer),
g AS (SELECT id, nation, x, y, r, 1 AS s FROM f UNION ALL SELECT id, nation, x, y, q, -1 FROM f WHERE q > 0),
c AS (SELECT *, unnest(range(CAST(floor((x - r) / 2) AS INT), CAST(floor((x + r) / 2) AS INT) + 1)) AS col FROM g),
d AS (SELECT *, unnest(range(CAST(floor((y - r) / 2) AS INT), CAST(floor((y + r) / 2) AS INT) + 1)) AS "row" FROM c),
-- area of |x| + |y| <= r in [0, a] x [0, b] for a, b >= 0
m AS (SELECT *, 2.0 * col - x AS x1, 2.0 * col + 2 - x AS x2, 2.0 * "row" - y AS y1, 2.0 * "row" + 2 - y AS y2 FROM d),
k AS (SELECT id, nation, col, "row", s * list_sum(list_transform([[x1, y1, 1], [x2, y1, -1], [x1, y2, -1], [x2, y2, 1]], lambda p: p[3] * sign(p[1]) * sign(p[2]) * (r * r - greatest(0, r - abs(p[1])) ** 2 - greatest(0, r - abs(p[2])) ** 2 + greatest(0, r - abs(p[1]) - abs(p[2])) ** 2) / 2)) AS a FROM m),
n AS (SELECT id, nation, col, "row", sum(a) AS a FROM k GROUP BY ALL),
p AS (SELECT id, any_value(nation) AS nation, any_value(2 * (r * r - q * q)) AS area FROM f GROUP BY id),
t AS (SELECT p.id, p.nation, p.area, coalesce(sum(a) FILTER (col BETWEEN 0 AND 59 AND "row" BETWEEN 0 AND 44 AND (col * 7 + "row" * 3) % 5 <> 0), 0) AS covered, coalesce(sum(a) FILTER (col BETWEEN 0 AND 59 AND "row" BETWEEN 0 AND 44 AND (col * 7 + "row" * 3) % 5 = 0), 0) AS nodata FROM p LEFT JOIN n ON n.id = p.id GROUP BY ALL)
SELECT nation, round(sum(area), 6) AS area, round(sum(covered), 6) AS covered, round(sum(nodata), 6) AS nodata, round(sum(area - covered - nodata), 6) AS outside, round(sum(covered) / sum(area), 6) AS coverage, count(*) AS n FROM t GROUP BY ROLLUP (nation)"""
)
def forcing_coverage_polygons(spark, sf):
    """How much of each nation's frames a grid of 2 x 2 cells, some of them empty, covers."""
    rows = shapes(spark, sf, "customer", CUSTOMER, "c_nationkey as nation")
    v = frames(rows, keep=["nation"])
    cells = overlay.cell_areas(v, 2.0)
    mask = spark.range(60 * 45).selectExpr("cast(id % 60 as bigint) as col", "cast(id div 60 as bigint) as row").where("(col * 7 + row * 3) % 5 <> 0")
    own = overlay.areas(v).join(rows.select("id", "nation"), "id")
    out = overlay.coverage(cells, mask, 45, 60, own, ["nation"])
    return out.select("nation", *[F.round(c, 6).alias(c) for c in ("area", "covered", "nodata", "outside", "coverage")], "n")


@query(
    f"""WITH f AS ({sql_shapes('supplier', SUPPLIER)}), p AS (SELECT o_orderkey AS id, o_orderkey % 163 * 0.9 + 0.03 + (o_orderkey % 141 * 0.8 + 0.01) AS u, o_orderkey % 163 * 0.9 + 0.03 - (o_orderkey % 141 * 0.8 + 0.01) AS v FROM orders),
h AS (SELECT p.id, f.id AS area_id FROM p JOIN f ON abs(p.u - f.u) < f.r AND abs(p.v - f.v) < f.r AND NOT (abs(p.u - f.u) < f.q AND abs(p.v - f.v) < f.q))
SELECT p.id, CASE WHEN count(area_id) = 1 THEN min(area_id) END AS area_id, CASE count(area_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'assigned' ELSE 'ambiguous' END AS status FROM p LEFT JOIN h ON h.id = p.id GROUP BY p.id"""
)
def polygon_assignment(spark, sf):
    """The one supplier's frame that holds each order's point, holes left out."""
    p = table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderkey % 163 * 0.9d + 0.03d as px", "o_orderkey % 141 * 0.8d + 0.01d as py")
    return transfer.assigned(geometry.holders(p, frames(shapes(spark, sf, "supplier", SUPPLIER)), 4.0)).select("id", "area_id", "status")


@query(
    """WITH f AS (SELECT s_suppkey AS id, s_suppkey % 31 * 5 AS x, s_suppkey % 29 * 4 AS y, 1 + s_suppkey % 4 AS r, s_suppkey % 2 AS q FROM supplier), p AS (SELECT c_custkey AS point, c_custkey % 150 AS px, c_custkey % 110 AS py FROM customer),
d AS (SELECT point, id, abs(px - x) + abs(py - y) AS d, r, q FROM p JOIN f ON abs(px - x) <= r AND abs(py - y) <= r)
SELECT point, id, d < r AND NOT (q > 0 AND d <= q) AS contains FROM d WHERE d <= r AND NOT d < q"""
)
def points_on_boundaries(spark, sf):
    """Lattice points that diamonds with holes cover, and whether they lie inside and not on a side."""
    p = table(spark, sf, "customer").selectExpr("c_custkey as point", "double(c_custkey % 150) as px", "double(c_custkey % 110) as py")
    v = frames(table(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_suppkey % 31 * 5d as x", "s_suppkey % 29 * 4d as y", "1d + s_suppkey % 4 as r", "double(s_suppkey % 2) as q"))
    return geometry.within(p, v, 3.0, "covers", told=True)


def sql_conic(e2, a, lat0, lat1, lat2):
    """Constants n, c (Albers) of the SQL below, computed the same way."""
    import math

    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    e = math.sqrt(e2)
    q = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
    f0, f1, f2 = map(math.radians, (lat0, lat1, lat2))
    n = (m(f1) ** 2 - m(f2) ** 2) / (q(f2) - q(f1))
    return n, m(f1) ** 2 + n * q(f1), q(f0), a, e2, e


N, C, Q0, A, E2, E = sql_conic(0.0066943800229007876, 6378137.0, 23.0, 29.5, 45.5)


@query(
    f"""WITH p AS (SELECT c_custkey AS id, -120 + c_custkey % 977 * 0.05 AS lon, 26 + c_custkey % 463 * 0.05 AS lat FROM customer),
q AS (SELECT *, sin(radians(lat)) AS s FROM p), r AS (SELECT *, {A!r} * sqrt({C!r} - {N!r} * {1 - E2!r} * (s / (1 - {E2!r} * s * s) - ln((1 - {E!r} * s) / (1 + {E!r} * s)) / (2 * {E!r}))) / {N!r} AS rho, {N!r} * radians(lon + 96) AS t FROM q)
SELECT id, round(rho * sin(t), 3) AS x, round({A!r} * sqrt({C!r} - {N!r} * {Q0!r}) / {N!r} - rho * cos(t), 3) AS y, round(CAST(lon AS DOUBLE), 9) AS albers_lon, round(CAST(lat AS DOUBLE), 9) AS albers_lat, round(CAST(lon AS DOUBLE), 9) AS utm_lon, round(CAST(lat AS DOUBLE), 9) AS utm_lat, round(CAST(lon AS DOUBLE), 9) AS lambert_lon, round(CAST(lat AS DOUBLE), 9) AS lambert_lat FROM r"""
)
def reprojection(spark, sf):
    """Equal-area coordinates of the customers' points, and the points again by the inverse of three projections."""
    p = table(spark, sf, "customer").selectExpr("c_custkey as id", "-120 + c_custkey % 977 * 0.05d as lon", "26 + c_custkey % 463 * 0.05d as lat")
    p = projection.inverse(projection.forward(p, projection.crs(5070)), projection.crs(5070), lon="albers_lon", lat="albers_lat")
    for name, code in (("utm", 26914), ("lambert", 2278)):
        p = projection.inverse(projection.forward(p, projection.crs(code), x="px", y="py"), projection.crs(code), "px", "py", f"{name}_lon", f"{name}_lat")
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), *[F.round(f"{name}_{c}", 9).alias(f"{name}_{c}") for name in ("albers", "utm", "lambert") for c in ("lon", "lat")])


LATTICE = "c_custkey % 60 AS x, c_custkey // 60 AS y, c_nationkey % 3 AS zone"


@query(
    f"""WITH c AS (SELECT {LATTICE} FROM customer WHERE c_custkey % 11 <> 0),
w AS (SELECT zone, x + dx AS wx, y + dy AS wy, dx + 2 * dy AS corner FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS d(dx, dy)),
q AS (SELECT zone, wx, wy, count(*) AS n, sum(corner) AS s FROM w GROUP BY ALL),
e AS (SELECT zone, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) // 4 AS euler FROM q GROUP BY zone),
a AS (SELECT zone, count(*) AS n FROM c GROUP BY zone),
j AS (SELECT u.zone, count(*) AS n FROM c u JOIN c v ON u.zone = v.zone AND (v.x = u.x + 1 AND v.y = u.y OR v.x = u.x AND v.y = u.y + 1) GROUP BY u.zone)
SELECT a.zone, CAST(a.n AS DOUBLE) AS area, CAST(4 * a.n - 2 * coalesce(j.n, 0) AS BIGINT) AS sides, CAST(e.euler AS BIGINT) AS outlines_less_holes FROM a JOIN e ON e.zone = a.zone LEFT JOIN j ON j.zone = a.zone"""
)
def dissolved_zones(spark, sf):
    """Unit squares of a lattice dissolved by zone: area, length of the outlines, and outlines less holes (the Euler number)."""
    c = table(spark, sf, "customer").where("c_custkey % 11 <> 0").selectExpr("c_custkey as id", "c_custkey % 60 as x0", "c_custkey div 60 as y0", "c_nationkey % 3 as zone")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for i, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    v = c.withColumn("c", corner).select("id", "zone", "c.ord", (F.col("x0") + F.col("c.dx")).alias("x"), (F.col("y0") + F.col("c.dy")).alias("y"))
    rings = overlay.dissolve(v, "zone")
    nxt = lambda k: F.coalesce(F.lead(k).over(W.partitionBy("ring").orderBy("ord")), F.first(k).over(W.partitionBy("ring").orderBy("ord")))
    per = rings.withColumn("cross", F.col("x") * nxt("y") - nxt("x") * F.col("y")).groupBy("group", "ring", "hole").agg((F.sum("cross") / 2).alias("area"), F.count("*").alias("sides"))
    return per.groupBy(F.col("group").alias("zone")).agg(F.sum("area").alias("area"), F.sum("sides").alias("sides"), (F.count_if(~F.col("hole")) - F.count_if(F.col("hole"))).alias("outlines_less_holes"))


@query(
    """WITH RECURSIVE e AS (SELECT vec_id AS id, embedding[1:6] AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id AND list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) <= 0.05),
r AS (SELECT DISTINCT a AS node, a AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
g AS (SELECT node, min(seen) AS g FROM r GROUP BY node), m AS (SELECT g.g, count(DISTINCT g.node) AS n, max(l.label) - min(l.label) AS spread FROM g JOIN embeddings l ON l.vec_id = g.node GROUP BY g.g)
SELECT g AS "group", n, CAST(spread AS DOUBLE) AS spread, spread > 0 AS ambiguous FROM m"""
)
def ambiguous_fingerprints(spark, sf):
    """Groups of vectors whose first six components are within 0.05 of each other, and whether their results (labels) differ."""
    e = table(spark, sf, "embeddings")
    groups = fingerprints.near_groups(e.selectExpr("vec_id as id", "cast(slice(embedding, 1, 6) as array<double>) as v"), 0.05)
    return fingerprints.ambiguities(groups, e.selectExpr("vec_id as id", "array(cast(label as double)) as v"), 0.0)
