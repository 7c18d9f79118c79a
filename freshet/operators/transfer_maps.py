"""Transfer maps: which subbasin each receiving cell of a grid takes its depth from, and by what factor, so that volumes are kept.

Cells and subbasins are two tables, as a map of a large grid is: Map(cells, subbasins).
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from . import catalog as cat
from . import geometry, overlay, transfer
from .network import checkpointed

# Names of area units and their square metres.
SQUARE_METRES = {
    ("M2", "SQ_M", "SQUARE_METER", "SQUARE_METERS"): 1.0,
    ("KM2", "SQ_KM", "SQUARE_KILOMETER", "SQUARE_KILOMETERS"): 1_000_000.0,
    ("ACRE", "ACRES"): 4_046.8564224,
    ("MI2", "SQ_MI", "SQUARE_MILE", "SQUARE_MILES"): 2_589_988.110336,
}
PLACES = 9  # decimals of a receiving area


class Map(NamedTuple):
    """cells(cell_id, row_index, column_index, subbasin, area, multiplier), subbasins(subbasin, declared, unit, source_area, cells,
    receiving_area, multiplier) and problems(problem, subject), if they were asked for."""

    cells: DataFrame
    subbasins: DataFrame
    problems: DataFrame | None


def square_metres(value: Column, unit: Column) -> Column:
    """An area in square metres; null for an unknown unit and for a value that is not finite and positive."""
    name = F.regexp_replace(F.upper(F.trim(unit)), "[^A-Z0-9]+", "_")
    name = F.regexp_replace(name, "^_+|_+$", "")
    factor = F.lit(None).cast("double")
    for names, f in SQUARE_METRES.items():
        factor = F.when(name.isin(*names), F.lit(f)).otherwise(factor)
    return F.when(finite(value) & (value > 0), value * factor)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def told(df: DataFrame, subject: Column, **when: Column) -> DataFrame:
    """(problem, subject): a row for each condition that holds; a name's underscores stand for spaces."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n.replace("_", " "))) for n, c in when.items()]))
    return df.select(F.explode(each).alias("problem"), subject.cast("string").alias("subject"))


def compile_map(cells: DataFrame, vertices: DataFrame, sources: DataFrame, cell_area: float, full_cells: bool = False, strict: bool = True, problems: bool = True) -> Map:
    """The map of cells(cell_id, row_index, column_index, cx, cy, area) that lie in the subbasins of vertices(id, part, ring, ord, x, y).

    ``area`` is the part of a cell that receives, from 0 to ``cell_area``. sources(subbasin, declared, unit) selects the
    subbasins and states their areas; other polygons take no part. A cell with a positive area belongs to the one subbasin
    that covers its centre, and a subbasin's multiplier is its own area over the sum of its cells', rounded to 9 decimals. With
    ``full_cells`` the centre must lie inside and not on a side, cells count whole or not at all, and a subbasin's area is that of its polygon.

    Cells that no subbasin covers get factor 0. Told as problems, and raised when ``strict``: a name selected twice or without
    a polygon, an area or unit that is not valid, polygons that share an area, a cell in several subbasins, a subbasin
    without receiving cells, a cell area out of bounds. Not strict, such cells are left without a subbasin and such subbasins have
    no factor; of a name selected twice one row stays. Without ``problems`` (and not strict) none are looked for, and no polygon meets another.
    """
    names = checkpointed(sources.groupBy("subbasin").agg(F.min(F.struct(F.col("declared").cast("double").alias("declared"), "unit")).alias("s"), F.count("*").alias("rows")))
    names = names.select("subbasin", "rows", "s.declared", "s.unit")
    v = checkpointed(overlay.whole(vertices).join(names.select(F.col("subbasin").alias("id")), "id", "left_semi"))
    shapes = overlay.areas(v).select(F.col("id").alias("subbasin"), F.col("area").alias("shape"))
    own = F.col("shape") if full_cells else square_metres(F.col("declared"), F.col("unit"))
    names = names.join(shapes, "subbasin", "left").withColumn("source_area", own)

    area = F.col("area").cast("double")
    bad = ~finite(area) | (area < 0) | (area > cell_area)
    if full_cells:
        bad |= (area != 0) & (area != cell_area)
    c = cells.select("cell_id", "row_index", "column_index", "cx", "cy", area.alias("area"), F.coalesce(bad, F.lit(True)).alias("bad"))
    taken = F.expr("not bad and area > 0")
    c = c.select("*", F.when(taken, F.col("cx")).alias("px"), F.when(taken, F.col("cy")).alias("py")).drop("cx", "cy")
    c = transfer.assigned(geometry.holders(c, v, boundary="contains" if full_cells else "covers")).withColumnRenamed("area_id", "subbasin")

    got = c.where("subbasin is not null").groupBy("subbasin").agg(F.count("*").alias("cells"), F.round(F.sum("area"), PLACES).alias("receiving_area"))
    per = names.join(got, "subbasin", "left").fillna(0, ["cells"]).fillna(0.0, ["receiving_area"])
    per = checkpointed(per.withColumn("multiplier", F.when(F.col("receiving_area") > 0, F.col("source_area") / F.col("receiving_area"))))
    found = None
    if problems or strict:
        total = per.agg(F.sum("shape")).first()[0] or 0.0
        shared = overlay.intersections(v, v, least=max(1e-6, total * 1e-12)).where("a_id < b_id")
        found = told(per, F.col("subbasin"), name_selected_twice=F.col("rows") > 1, no_polygon=F.coalesce(F.col("shape") <= 0, F.lit(True)), area_or_unit=F.col("source_area").isNull() & F.lit(not full_cells), no_receiving_cells=F.col("receiving_area") <= 0)
        found = found.union(shared.select(F.lit("polygons overlap").alias("problem"), F.concat_ws(",", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("subject")))
        found = found.union(told(c, F.col("cell_id"), cell_area=F.col("bad"), ambiguous_cell=F.col("status") == "ambiguous"))
    if strict:
        first = found.orderBy("problem", "subject").limit(5).collect()
        if first:
            raise ValueError("; ".join(f"{r.problem}: {r.subject}" for r in first))
    c = c.join(per.select("subbasin", "multiplier"), "subbasin", "left").withColumn("multiplier", F.when(F.col("subbasin").isNull(), 0.0).otherwise(F.col("multiplier")))
    return Map(c.select("cell_id", "row_index", "column_index", "subbasin", "area", "multiplier"), per.select("subbasin", "declared", "unit", "source_area", "cells", "receiving_area", "multiplier"), found)


def totals(cells: DataFrame, subbasins: DataFrame) -> DataFrame:
    """One row: counts and areas of a map, sums rounded to 9 decimals."""
    free = F.col("subbasin").isNull() & (F.col("area") > 0)
    a = cells.agg(F.count("*").alias("target_cells"), F.count("subbasin").alias("assigned_cells"), F.count_if(free).alias("unassigned_cells"), F.round(F.coalesce(F.sum(F.when(free, F.col("area"))), F.lit(0.0)), PLACES).alias("unassigned_area"))
    b = subbasins.agg(F.count("*").alias("subbasins"), F.round(F.sum("source_area"), PLACES).alias("source_area"), F.round(F.sum("receiving_area"), PLACES).alias("receiving_area"))
    return b.join(F.broadcast(a))  # a row each


def check_map(cells: DataFrame, subbasins: DataFrame, rows: int, cols: int, cell_area: float, full_cells: bool = False, stated: dict | None = None) -> DataFrame:
    """(problem, subject): what is wrong with a stored map, and no row if nothing is.

    Cells: each number from 0 to rows * cols - 1 once, with row and column in row-major order; areas and factors finite and in
    bounds; no factor without a subbasin, and with one that subbasin's own. Subbasins: names once, the area that value
    and unit give, and count, receiving area and factor as the cells add up to. ``stated`` are figures of ``totals`` to compare.
    Sums are compared to 1e-12 of their size, as the order of adding is not fixed.
    """
    off = lambda a, b, least=0.0: ~F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-12 + least, F.lit(False))
    n = rows * cols
    spark = cells.sparkSession
    ids = cells.groupBy("cell_id").agg(F.count("*").alias("n")).join(spark.range(n).withColumnRenamed("id", "_i"), F.col("cell_id") == F.col("_i"), "full")
    out = told(ids, F.coalesce("cell_id", "_i"), missing_cell=F.col("n").isNull(), unexpected_cell=F.col("_i").isNull(), repeated_cell=F.col("n") > 1)
    one = subbasins.groupBy("subbasin").agg(F.count("*").alias("n"), F.min("multiplier").alias("own"))
    c = cells.join(one.select(F.col("subbasin").alias("_s"), "own"), F.col("subbasin") == F.col("_s"), "left")
    area, factor, named = F.col("area"), F.col("multiplier"), F.col("subbasin").isNotNull()
    misplaced = ~(F.col("row_index").eqNullSafe(F.floor(F.col("cell_id") / cols)) & F.col("column_index").eqNullSafe(F.col("cell_id") % cols))
    values = ~finite(area) | (area < 0) | (area > cell_area) | ~finite(factor) | (factor < 0)
    out = out.union(
        told(
            c, F.col("cell_id"), not_in_order=misplaced, cell_values=values, not_a_full_cell=F.lit(full_cells) & (area != 0) & (area != cell_area), factor_without_subbasin=~named & (factor != 0),
            unknown_subbasin=named & F.col("_s").isNull(), factor_differs=F.col("_s").isNotNull() & ~factor.eqNullSafe(F.col("own")),
        )
    )
    got = cells.where(named).groupBy(F.col("subbasin").alias("_s")).agg(F.count("*").alias("_n"), F.round(F.sum("area"), PLACES).alias("_area"))
    s = subbasins.join(got, F.col("subbasin") == F.col("_s"), "left").join(one.select(F.col("subbasin").alias("_o"), "n"), F.col("subbasin").eqNullSafe(F.col("_o")), "left")
    drift = ~F.col("cells").eqNullSafe(F.col("_n")) | off(F.col("receiving_area"), F.col("_area"), 1e-9) | off(F.col("multiplier"), F.try_divide("source_area", "receiving_area"))
    supported = F.coalesce(F.col("_area") > 0, F.lit(False))
    declared = F.lit(False) if full_cells else off(F.col("source_area"), square_metres(F.col("declared"), F.col("unit")))
    out = out.union(told(s, F.col("subbasin"), repeated_subbasin=F.col("n") > 1, no_name=F.coalesce(F.trim(F.col("subbasin").cast("string")) == "", F.lit(True)), source_area_differs=declared, no_receiving_cells=~supported, denominator_differs=supported & drift))
    if stated:
        t = totals(cells, subbasins)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("found"), F.lit(float(x)).alias("stated")) for k, x in stated.items()]))
        out = out.union(told(t.select(each.alias("t")).select("t.*"), F.col("k"), totals_differ=off(F.col("found"), F.col("stated"))))
    return out


def steps_of(start: datetime, end: datetime, minutes: int) -> int:
    """How many intervals a window has; it must be naive, of whole minutes, and a whole number of intervals long."""
    odd = any(t.tzinfo is not None or t.second or t.microsecond for t in (start, end))
    span = None if odd else int((end - start).total_seconds()) // 60
    if odd or span <= 0 or minutes <= 0 or span % minutes:
        raise ValueError("the window must be naive whole minutes, increasing, and a whole number of intervals")
    return span // minutes


def excess(subbasins: DataFrame, catalog: DataFrame, values: DataFrame, a: str, run: str, start: datetime, end: datetime, minutes: int, unit: str = "IN", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(depths(subbasin, t, depth), problems(problem, subject)): each subbasin's excess depths at the interval ends of the window.

    catalog(path, unit, type) lists the paths of values(path, ts, value). A subbasin's paths have A part ``a``, its name as B part,
    C part PRECIP-EXCESS, an E part of ``minutes`` and the run, case ignored; of several, which differ by their D part, the
    first is read. Told as problems, and raised when ``strict``: no path, a path listed twice, E parts that differ, another unit, a
    type that is not PER-CUM, stamps other than exactly the interval ends, values that are negative or not finite. Not strict, a
    subbasin with a problem has no depths.
    """
    n = steps_of(start, end, minutes)
    if unit.upper() not in transfer.METRES:
        raise ValueError(f"unknown unit of depth: {unit}")
    low = lambda c: F.lower(F.col(c))
    asked = (low("a") == a.strip().lower()) & (low("c") == "precip-excess") & (low("f") == f"run:{run.strip().lower()}") & (units.interval_minutes(F.col("e")) == minutes)
    listed = cat.parse(catalog).where(asked).groupBy(low("b").alias("_b")).agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.count_distinct(low("e")).alias("encodings"), F.min(F.struct(low("path").alias("k"), "path", "unit", "type")).alias("first")
    )
    one = subbasins.select("subbasin", F.lower(F.col("subbasin").cast("string")).alias("_b")).distinct().join(listed, "_b", "left")
    one = checkpointed(one.select("subbasin", "n", "paths", "encodings", "first.path", "first.unit", "first.type"))
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    on = (F.col("ts") > first) & (F.col("ts") <= last) & (F.timestamp_diff("MICROSECOND", first, F.col("ts")) % (minutes * 60_000_000) == 0)
    read = values.join(one.select("path", "subbasin"), "path").select("subbasin", "ts", F.col("value").cast("double").alias("value"))
    v = F.col("value")
    seen = read.groupBy("subbasin").agg(F.count("*").alias("rows"), F.count_distinct("ts").alias("stamps"), F.count_if(F.coalesce(on, F.lit(False))).alias("on"), F.count_if(~finite(v) | F.coalesce(v < 0, F.lit(True))).alias("bad"))
    all_ = one.join(seen, "subbasin", "left")
    there = F.col("path").isNotNull()
    exact = (F.col("rows") == n) & (F.col("stamps") == n) & (F.col("on") == n)
    same = lambda c, text: F.coalesce(F.regexp_replace(F.upper(F.trim(c)), "_", "-") == text, F.lit(False))
    problems = checkpointed(
        told(
            all_, F.col("subbasin"), no_path=~there, path_listed_twice=F.col("n") > F.col("paths"), intervals_compete=F.col("encodings") > 1, other_unit=there & ~same("unit", unit.upper()),
            not_per_cum=there & ~same("type", "PER-CUM"), stamps_differ=there & ~F.coalesce(exact, F.lit(False)), values_not_valid=F.col("bad") > 0,
        )
    )
    if strict:
        some = problems.orderBy("problem", "subject").limit(5).collect()
        if some:
            raise ValueError("; ".join(f"{r.problem}: {r.subject}" for r in some))
    faulty = problems.select(F.col("subject").alias("_s")).distinct()
    good = read.join(faulty, F.col("subbasin").cast("string") == F.col("_s"), "left_anti")
    return good.select("subbasin", F.col("ts").alias("t"), F.col("value").alias("depth")), problems


def frames(cells: DataFrame, depths: DataFrame) -> DataFrame:
    """(t, row_index, column_index, subbasin, depth, area): the depth of every assigned cell at every step; all other cells are 0."""
    c = cells.where("subbasin is not null").select("subbasin", "row_index", "column_index", "area", "multiplier")
    return depths.join(c, "subbasin").select("t", "row_index", "column_index", "subbasin", (F.col("depth") * F.col("multiplier")).alias("depth"), "area")


def frame_evidence(product: DataFrame, subbasins: DataFrame, depths: DataFrame, unit: str = "IN", absolute: float = 1e-6, relative: float = 1e-9) -> DataFrame:
    """Volumes of the depths over the subbasins' own areas against those of the frames, as ``transfer.volume_evidence`` tells them."""
    m = transfer.METRES[unit.upper()]
    source = depths.join(subbasins.select("subbasin", "source_area"), "subbasin").select("subbasin", F.col("t").alias("step"), (F.col("depth") * m * F.col("source_area")).alias("source"))
    target = product.groupBy("subbasin", F.col("t").alias("step")).agg((F.sum(F.col("depth") * F.col("area")) * m).alias("target"))
    return transfer.volume_evidence(source.join(target, ["subbasin", "step"], "full").fillna(0.0, ["source", "target"]), absolute, relative)


def delivered(product: DataFrame, minutes: int) -> DataFrame:
    """Frames stamped at the end of the interval after their own, for readers that take a stamp for an interval's start."""
    return product.withColumn("t", F.col("t") + F.expr(f"interval {minutes} minutes"))


def delivered_origin(origin: tuple[float, float], size: float) -> tuple[float, float]:
    """The origin moved down to a multiple of the cell size."""
    return tuple((c // size) * size for c in origin)
