"""Queries on transfer maps: orders or customers are the cells of a grid, suppliers' frames or nations the subbasins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import transfer, transfer_maps
from .geometry_queries import SHARED, SUPPLIER, frames, shapes, sql_shapes
from .registry import query, table

UNITS = ("m2", "Sq. km", "acres", " square miles ", "ACRE", "feet")
UNIT_AREAS = (1.0, 1e6, 4046.8564224, 2589988.110336, 4046.8564224, None)
CELL = 100.0

SQL = f"""WITH f AS ({sql_shapes('supplier', SUPPLIER)}),
s AS (SELECT s_suppkey AS id, (1 + s_suppkey % 7) * CASE s_suppkey % 6 {' '.join(f'WHEN {i} THEN {a!r}' for i, a in enumerate(UNIT_AREAS) if a)} END AS source_area FROM supplier),
c AS (SELECT o_orderkey AS cell_id, o_orderkey % 163 * 0.9 + 0.03 + (o_orderkey % 141 * 0.8 + 0.01) AS u, o_orderkey % 163 * 0.9 + 0.03 - (o_orderkey % 141 * 0.8 + 0.01) AS v, o_orderkey % 5 * 25 + CASE WHEN o_orderkey % 97 = 0 THEN 200 ELSE 0 END AS area FROM orders),
h AS (SELECT c.cell_id, count(*) AS n, min(f.id) AS id, any_value(c.area) AS area FROM c JOIN f ON abs(c.u - f.u) <= f.r AND abs(c.v - f.v) <= f.r AND NOT (abs(c.u - f.u) < f.q AND abs(c.v - f.v) < f.q) WHERE c.area > 0 AND c.area <= 100 GROUP BY c.cell_id),
g AS (SELECT s.id, s.source_area, count(h.id) AS cells, coalesce(sum(h.area), 0) AS receiving_area FROM s LEFT JOIN h ON h.id = s.id AND h.n = 1 GROUP BY s.id, s.source_area)
"""


def supplier_map(spark, sf, problems=False):
    """The map of the orders' cells to the suppliers' frames, which overlap here and there, with a unit that none knows."""
    v = frames(shapes(spark, sf, "supplier", SUPPLIER))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.expr("cast(s_suppkey % 6 + 1 as int)"))
    sources = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subbasin"), F.expr("double(1 + s_suppkey % 7)").alias("declared"), unit.alias("unit"))
    cells = table(spark, sf, "orders").selectExpr("o_orderkey as cell_id", "o_orderkey div 100 as row_index", "o_orderkey % 100 as column_index", "o_orderkey % 163 * 0.9d + 0.03d as cx", "o_orderkey % 141 * 0.8d + 0.01d as cy", "double(o_orderkey % 5 * 25 + if(o_orderkey % 97 = 0, 200, 0)) as area")
    return transfer_maps.compile_map(cells, v, sources, CELL, strict=False, problems=problems)


@query(SQL + "SELECT id AS subbasin, round(CAST(source_area AS DOUBLE), 6) AS source_area, cells, CAST(receiving_area AS DOUBLE) AS receiving_area, round(CASE WHEN receiving_area > 0 THEN CAST(source_area AS DOUBLE) / receiving_area END, 6) AS multiplier FROM g")
def transfer_map_subbasins(spark, sf):
    """Each subbasin's own area, cells, receiving area and depth factor."""
    return supplier_map(spark, sf).subbasins.select("subbasin", F.round("source_area", 6).alias("source_area"), "cells", "receiving_area", F.round("multiplier", 6).alias("multiplier"))


@query(SQL + "SELECT c.cell_id, CASE WHEN h.n = 1 THEN h.id END AS subbasin, CAST(c.area AS DOUBLE) AS area, CASE WHEN h.n = 1 THEN round(CAST(g.source_area AS DOUBLE) / g.receiving_area, 6) ELSE 0 END AS multiplier FROM c LEFT JOIN h ON h.cell_id = c.cell_id LEFT JOIN g ON g.id = h.id AND h.n = 1")
def transfer_map_cells(spark, sf):
    """Each cell's subbasin, area and depth factor."""
    return supplier_map(spark, sf).cells.select("cell_id", "subbasin", "area", F.round("multiplier", 6).alias("multiplier"))


@query(
    SQL
    + f"""SELECT 'area or unit' AS problem, CAST(id AS VARCHAR) AS subject FROM g WHERE source_area IS NULL
UNION ALL SELECT 'no receiving cells', CAST(id AS VARCHAR) FROM g WHERE receiving_area <= 0
UNION ALL SELECT 'cell area', CAST(cell_id AS VARCHAR) FROM c WHERE area > 100
UNION ALL SELECT 'ambiguous cell', CAST(cell_id AS VARCHAR) FROM h WHERE n > 1
UNION ALL SELECT 'polygons overlap', a.id || ',' || b.id FROM f a JOIN f b ON a.id < b.id AND abs(a.u - b.u) < a.r + b.r AND abs(a.v - b.v) < a.r + b.r WHERE {SHARED} > 1e-6"""
)
def transfer_map_problems(spark, sf):
    """Everything that keeps this map from being compiled strictly."""
    return supplier_map(spark, sf, problems=True).problems


@query(
    """WITH i AS (SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_custkey % 41 <> 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 67 = 5),
c AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 53 = 0 THEN 'X' ELSE 'N' || nation END AS s, id % 5 * 25 + CASE WHEN id % 97 = 0 THEN 500 ELSE 0 END AS area FROM i),
g AS (SELECT n_nationkey AS n, 'N' || n_nationkey AS s, coalesce(sum(area), 0) AS area FROM nation LEFT JOIN c ON c.s = 'N' || n_nationkey GROUP BY n_nationkey),
r AS (SELECT c_custkey AS id FROM customer)
SELECT 'missing cell' AS problem, CAST(id AS VARCHAR) AS subject FROM r WHERE id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'repeated cell', CAST(id AS VARCHAR) FROM i GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'not in order', CAST(id AS VARCHAR) FROM c WHERE id % 37 = 5
UNION ALL SELECT 'cell values', CAST(id AS VARCHAR) FROM c WHERE area > 100
UNION ALL SELECT 'factor without subbasin', CAST(id AS VARCHAR) FROM c WHERE s IS NULL AND id % 45 = 0
UNION ALL SELECT 'unknown subbasin', CAST(id AS VARCHAR) FROM c WHERE s = 'X'
UNION ALL SELECT 'factor differs', CAST(id AS VARCHAR) FROM c WHERE s <> 'X' AND id % 29 = 0
UNION ALL SELECT 'source area differs', s FROM g WHERE n % 8 = 3
UNION ALL SELECT 'no receiving cells', s FROM g WHERE area <= 0
UNION ALL SELECT 'denominator differs', s FROM g WHERE area > 0 AND (n % 6 = 1 OR n % 10 = 4)"""
)
def transfer_map_check(spark, sf):
    """What is wrong with a stored map of the customers' cells to the nations, with faults of every kind in it."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    i = customer.where("c_custkey % 41 <> 0").union(customer.where("c_custkey % 67 = 5")).selectExpr("c_custkey as id", "c_nationkey as nation")
    c = i.selectExpr("id as cell_id", "id div 50 + if(id % 37 = 5, 1, 0) as row_index", "id % 50 as column_index", "case when id % 9 = 0 then null when id % 53 = 0 then 'X' else concat('N', nation) end as subbasin", "double(id % 5 * 25 + if(id % 97 = 0, 500, 0)) as area")
    got = c.groupBy("subbasin").agg(F.count("*").alias("n"), F.sum("area").alias("sum"))
    s = nation.selectExpr("n_nationkey as k", "concat('N', n_nationkey) as subbasin", "double(1 + n_nationkey % 4) as declared", "'acres' as unit").join(got, "subbasin", "left").fillna(0, ["n"]).fillna(0.0, ["sum"])
    s = s.selectExpr("subbasin", "declared", "unit", "declared * 4046.8564224d + if(k % 8 = 3, 1, 0) as source_area", "n + if(k % 6 = 1, 1, 0) as cells", "sum + if(k % 10 = 4, 1, 0) as receiving_area")
    s = s.selectExpr("*", "coalesce(try_divide(source_area, receiving_area), 0d) as multiplier")
    c = c.join(s.select("subbasin", F.col("multiplier").alias("own")), "subbasin", "left")
    c = c.selectExpr("cell_id", "row_index", "column_index", "subbasin", "area", "if(subbasin is null, if(cell_id % 45 = 0, 0.5d, 0d), coalesce(own, 1d) * if(cell_id % 29 = 0, 1.5d, 1d)) as multiplier")
    return transfer_maps.check_map(c, s, customer.count() // 50, 50, CELL)


@query(
    """WITH t AS (SELECT c_custkey AS tid, CAST(CASE WHEN c_custkey % 20 = 0 THEN c_custkey % 97 ELSE 50 + c_custkey % 1021 * 0.000001 END AS DOUBLE) AS tx, CAST(CASE WHEN c_custkey % 20 = 0 THEN c_custkey % 89 ELSE 50 + c_custkey % 1013 * 0.000001 END AS DOUBLE) AS ty FROM customer),
p AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 101 * 0.97 ELSE 50 + o_orderkey % 2003 * 0.0000007 END AS DOUBLE) AS x, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 103 * 0.93 ELSE 50 + o_orderkey % 1999 * 0.0000006 END AS DOUBLE) AS y FROM orders)
SELECT p.id, round(min(sqrt((p.x - t.tx) ** 2 + (p.y - t.ty) ** 2)), 9) AS distance FROM p, t GROUP BY p.id"""
)
def nearest_in_one_spot(spark, sf):
    """Distance of each order's point to the nearest of the customers', nearly all of which lie in one spot."""
    t = table(spark, sf, "customer").selectExpr("c_custkey as tid", "double(if(c_custkey % 20 = 0, c_custkey % 97, 50 + c_custkey % 1021 * 0.000001bd)) as tx", "double(if(c_custkey % 20 = 0, c_custkey % 89, 50 + c_custkey % 1013 * 0.000001bd)) as ty")
    p = table(spark, sf, "orders").selectExpr("o_orderkey as id", "double(if(o_orderkey % 3 = 0, o_orderkey % 101 * 0.97bd, 50 + o_orderkey % 2003 * 0.0000007bd)) as x", "double(if(o_orderkey % 3 = 0, o_orderkey % 103 * 0.93bd, 50 + o_orderkey % 1999 * 0.0000006bd)) as y")
    return transfer.nearest(p, t, dense=64).select("id", F.round("distance", 9).alias("distance"))


SQL_EXCESS = """WITH v AS (SELECT o_orderkey % 25 AS n, o_orderkey // 25 % 24 + 1 AS h, sum(o_totalprice) / 1000000 AS depth FROM orders GROUP BY ALL),
m AS (SELECT c_nationkey AS n, CAST(c_custkey AS BIGINT) AS cell, CAST(c_custkey % 4 * 25 AS DOUBLE) AS area FROM customer),
s AS (SELECT n_nationkey AS n, 1000.0 * (1 + n_nationkey % 7) AS source_area, coalesce(sum(area), 0) AS receiving FROM nation LEFT JOIN m ON m.n = n_nationkey GROUP BY n_nationkey HAVING coalesce(sum(area), 0) > 0),
g AS (SELECT s.*, v.h, v.depth * 0.0254 * s.source_area AS volume FROM s JOIN v ON v.n = s.n WHERE s.n % 9 <> 4 AND s.n % 11 <> 6 AND s.n % 13 <> 5 AND s.n % 17 <> 8)
"""


def nation_excess(spark, sf):
    """(cells, subbasins, depths, problems): hourly excess of the nations over a day; some have no path, a gap, another unit or a path twice."""
    v = table(spark, sf, "orders").selectExpr("o_orderkey % 25 as n", "o_orderkey div 25 % 24 + 1 as h", "o_totalprice").groupBy("n", "h").agg((F.sum("o_totalprice") / 1000000).alias("value"))
    path = "concat('/Basin/n', n, '/PRECIP-EXCESS/01JAN2024/1HOUR/RUN:Q/')"
    values = v.where("not (n % 11 = 6 and h = 24)").selectExpr(f"{path} as path", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(h as int), 0, 0) as ts", "value")
    nation = table(spark, sf, "nation").selectExpr("n_nationkey as n")
    catalog = nation.where("n % 13 <> 5").union(nation.where("n % 17 = 8")).selectExpr(f"{path} as path", "if(n % 9 = 4, 'mm', 'in') as unit", "'per_cum' as type")
    catalog = catalog.union(nation.selectExpr("concat('/BASIN/N', n, '/PRECIP-INC/01JAN2024/1HOUR/RUN:Q/') as path", "'IN' as unit", "'PER-CUM' as type"))
    m = table(spark, sf, "customer").selectExpr("concat('N', c_nationkey) as subbasin", "c_custkey div 50 as row_index", "c_custkey % 50 as column_index", "double(c_custkey % 4 * 25) as area")
    s = nation.selectExpr("concat('N', n) as subbasin", "1000d * (1 + n % 7) as source_area").join(m.groupBy("subbasin").agg(F.round(F.sum("area"), 9).alias("receiving_area")), "subbasin").where("receiving_area > 0")
    cells = m.join(s.select("subbasin", (F.col("source_area") / F.col("receiving_area")).alias("multiplier")), "subbasin")
    depths, problems = transfer_maps.excess(s, catalog, values, "BASIN", "q", datetime(2024, 1, 1), datetime(2024, 1, 2), 60, "IN", strict=False)
    return cells, s, depths, problems


@query(
    SQL_EXCESS
    + """SELECT 'no path' AS problem, 'N' || n AS subject FROM s WHERE n % 13 = 5 AND n % 17 <> 8
UNION ALL SELECT 'path listed twice', 'N' || n FROM s WHERE n % 17 = 8 AND n % 13 <> 5
UNION ALL SELECT 'other unit', 'N' || n FROM s WHERE n % 9 = 4 AND (n % 13 <> 5 OR n % 17 = 8)
UNION ALL SELECT 'stamps differ', 'N' || n FROM s WHERE n % 11 = 6 AND (n % 13 <> 5 OR n % 17 = 8)"""
)
def excess_problems(spark, sf):
    """Why a nation's excess cannot be read exactly."""
    return nation_excess(spark, sf)[3]


@query(SQL_EXCESS + "SELECT CASE WHEN grouping(n) = 0 THEN 'N' || n END AS subbasin, CASE WHEN grouping(h) = 0 THEN h END AS \"hour\", round(CAST(sum(volume) AS DOUBLE), 9) AS source, round(CAST(sum(volume) AS DOUBLE), 9) AS target, true AS accepted FROM g GROUP BY GROUPING SETS ((n, h), (n), (h), ())")
def excess_evidence(spark, sf):
    """Volumes of the nations' excess and of the frames made of it, by nation and hour and summed over either."""
    cells, s, depths, _ = nation_excess(spark, sf)
    out = transfer_maps.frame_evidence(transfer_maps.frames(cells, depths), s, depths)
    hour = F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("step"))
    return out.select("subbasin", hour.alias("hour"), F.round("source", 9).alias("source"), F.round("target", 9).alias("target"), "accepted")
