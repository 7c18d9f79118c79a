"""Transfer maps: strict compilation, areas by polygon, stored maps with faults."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from freshet.operators import transfer_maps


def box(name, x0, y0, x1, y1):
    return [(name, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))]


def grid(areas, cols=3, size=10.0):
    return [(i, i // cols, i % cols, (i % cols + 0.5) * size, (i // cols + 0.5) * size, float(a)) for i, a in enumerate(areas)]


CELLS = "cell_id long, row_index long, column_index long, cx double, cy double, area double"
VERTICES = "id string, part int, ring int, ord int, x double, y double"
SOURCES = "subbasin string, declared double, unit string"
START = datetime(2024, 1, 1)
TWO = [("A", 300.0, "m2"), ("B", 1.0, "acre")]


def compiled(spark, areas, shapes, sources=TWO, **kw):
    v = spark.createDataFrame([r for s in shapes for r in box(*s)], VERTICES)
    return transfer_maps.compile_map(spark.createDataFrame(grid(areas), CELLS), v, spark.createDataFrame(sources, SOURCES), 100.0, **kw)


def test_a_map_keeps_volumes(spark):
    m = compiled(spark, [100, 50, 0, 100, 25, 100], [("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20), ("C", 20, 0, 30, 20)])
    per = {r.subbasin: r for r in m.subbasins.collect()}
    assert (per["A"].cells, per["A"].receiving_area, per["A"].multiplier) == (2, 200.0, 1.5)
    assert (per["B"].cells, per["B"].receiving_area) == (2, 75.0) and per["B"].multiplier == 4046.8564224 / 75
    cells = {r.cell_id: r for r in m.cells.collect()}
    assert [cells[i].subbasin for i in range(6)] == ["A", "B", None, "A", "B", None]  # C is not selected, and an empty cell takes no part
    assert sum(r.area * r.multiplier for r in cells.values()) == pytest.approx(300 + 4046.8564224)
    stated = transfer_maps.totals(m.cells, m.subbasins).first().asDict()
    assert (stated["target_cells"], stated["assigned_cells"], stated["unassigned_cells"], stated["unassigned_area"]) == (6, 4, 1, 100.0)
    assert transfer_maps.check_map(m.cells, m.subbasins, 2, 3, 100.0, stated=stated).isEmpty()
    drift = m.subbasins.withColumn("receiving_area", F.when(F.col("subbasin") == "A", 101.0).otherwise(F.col("receiving_area")))
    assert [tuple(r) for r in transfer_maps.check_map(m.cells, drift, 2, 3, 100.0).collect()] == [("denominator differs", "A")]
    got = transfer_maps.check_map(m.cells, m.subbasins, 2, 3, 100.0, stated=stated | {"unassigned_area": 99.0})
    assert [tuple(r) for r in got.collect()] == [("totals differ", "unassigned_area")]


@pytest.mark.parametrize(
    "shapes,sources,said",
    [
        ([("A", 0, 0, 15, 20), ("B", 15, 0, 30, 20)], TWO, "ambiguous cell: 1"),  # centres on the common side
        ([("A", 0, 0, 20, 20), ("B", 10, 0, 30, 20)], TWO, "polygons overlap: A,B"),
        ([("A", 0, 0, 10, 20), ("B", 100, 100, 110, 110)], TWO, "no receiving cells: B"),
        ([("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20)], [("A", 3.0, "feet"), TWO[1]], "area or unit: A"),
        ([("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20)], [("A", float("nan"), "m2"), TWO[1]], "area or unit: A"),
        ([("A", 0, 0, 10, 20)], TWO, "no polygon: B"),
        ([("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20)], [*TWO, TWO[0]], "name selected twice: A"),
    ],
)
def test_refused_maps(spark, shapes, sources, said):
    with pytest.raises(ValueError, match=said):
        compiled(spark, [100] * 6, shapes, sources)


def test_full_cells_by_centre(spark):
    shapes = [("A", 0, 0, 15, 20), ("B", 15, 0, 30, 20)]
    m = compiled(spark, [100, 100, 100, 100, 0, 100], shapes, [("A", None, None), ("B", None, None)], full_cells=True)
    assert {r.cell_id: r.subbasin for r in m.cells.collect()} == {0: "A", 1: None, 2: "B", 3: "A", 4: None, 5: "B"}  # a centre on a side is in neither
    assert {r.subbasin: r.multiplier for r in m.subbasins.collect()} == {"A": 1.5, "B": 1.5}
    assert transfer_maps.check_map(m.cells, m.subbasins, 2, 3, 100.0, full_cells=True).isEmpty()
    with pytest.raises(ValueError, match="cell area: 0"):
        compiled(spark, [50, 100, 100, 100, 0, 100], shapes, full_cells=True)


def test_empty_tables_and_nulls(spark):
    m = compiled(spark, [], [("A", 0, 0, 10, 20)], [("A", 1.0, "m2")], strict=False)
    assert m.cells.count() == 0 and [tuple(r) for r in m.problems.collect()] == [("no receiving cells", "A")]
    assert {r.problem for r in transfer_maps.check_map(m.cells, m.subbasins, 1, 2, 100.0).collect()} == {"missing cell", "no receiving cells"}
    v = spark.createDataFrame(box("A", 0, 0, 10, 20), VERTICES)
    odd = spark.createDataFrame([(0, 0, 0, 5.0, 5.0, None), (1, 0, 1, None, 5.0, 100.0), (2, 0, 2, 5.0, 6.0, 100.0)], CELLS)
    m = transfer_maps.compile_map(odd, v, spark.createDataFrame([("A", 1.0, "m2")], SOURCES), 100.0, strict=False)
    assert {r.cell_id: r.subbasin for r in m.cells.collect()} == {0: None, 1: None, 2: "A"}
    assert [tuple(r) for r in m.problems.collect()] == [("cell area", "0")]


def read(spark, rows, listed=None, **kw):
    path = "/X/{}/PRECIP-EXCESS/D{}/1HOUR/RUN:R/"
    listed = listed or [(path.format("A", 1), "in", "PER-CUM"), (path.format("A", 2), "in", "PER-CUM")]
    values = spark.createDataFrame([(path.format("A", 1), START + timedelta(minutes=m), v) for m, v in rows], "path string, ts timestamp_ntz, value double")
    names = spark.createDataFrame([("a",)], "subbasin string")
    return transfer_maps.excess(names, spark.createDataFrame(listed, "path string, unit string, type string"), values, " x ", "r", START, START + timedelta(hours=3), 60, "IN", **kw)


def test_excess_is_read_exactly_or_refused(spark):
    good = [(60, 0.1), (120, 0.0), (180, 0.3)]
    depths, problems = read(spark, good)
    assert problems.isEmpty() and sorted((r.subbasin, r.depth) for r in depths.collect()) == [("a", 0.0), ("a", 0.1), ("a", 0.3)]
    one = "/X/A/PRECIP-EXCESS/D1/1HOUR/RUN:R/"
    for rows, listed, said in (
        (good[:2], None, "stamps differ"),
        ([*good, (240, 0.1)], None, "stamps differ"),
        ([*good[:2], (179, 0.3)], None, "stamps differ"),
        ([*good[:2], (120, 0.3)], None, "stamps differ"),
        ([*good[:2], (180, -0.1)], None, "values not valid"),
        ([*good[:2], (180, None)], None, "values not valid"),
        (good, [(one, "MM", "PER-CUM")], "other unit"),
        (good, [(one, "IN", "INST-VAL")], "not per cum"),
        (good, [(one, "IN", "per_cum")] * 2, "path listed twice"),
        (good, [(one, "IN", "PER-CUM"), (one.replace("1HOUR", "60MIN"), "IN", "PER-CUM")], "intervals compete"),
        (good, [(one.replace("RUN:R", "RUN:S"), "IN", "PER-CUM")], "no path"),
    ):
        with pytest.raises(ValueError, match=said):
            read(spark, rows, listed)
    depths, problems = read(spark, good[:2], strict=False)
    assert depths.isEmpty() and [tuple(r) for r in problems.collect()] == [("stamps differ", "a")]
    with pytest.raises(ValueError, match="window"):
        transfer_maps.steps_of(START, START + timedelta(minutes=90), 60)


def test_frames_keep_volumes(spark):
    m = compiled(spark, [100, 50, 0, 100, 25, 100], [("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20)])
    depths = spark.createDataFrame([(n, START + timedelta(hours=h), d) for n, d in (("A", 2.0), ("B", 0.5)) for h in (1, 2)], "subbasin string, t timestamp_ntz, depth double")
    product = transfer_maps.frames(m.cells, depths)
    assert {(r.row_index, r.column_index): r.depth for r in product.collect()} == {(0, 0): 3.0, (1, 0): 3.0, (0, 1): 0.5 * 4046.8564224 / 75, (1, 1): 0.5 * 4046.8564224 / 75}
    evidence = transfer_maps.frame_evidence(product, m.subbasins, depths)
    assert evidence.count() == 9 and evidence.where("not accepted").isEmpty()
    assert transfer_maps.frame_evidence(product.where("row_index = 0"), m.subbasins, depths).where("not accepted").count() == 9
    assert {r.t for r in transfer_maps.delivered(product, 60).select("t").collect()} == {START + timedelta(hours=2), START + timedelta(hours=3)}
    assert transfer_maps.delivered_origin((-5.0, 27.0), 10.0) == (-10.0, 20.0)


def test_holders_of_cells_make_no_pairs(spark, monkeypatch):
    from freshet.operators import copies

    corners = [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0)]
    v = spark.createDataFrame([(i, k, x + i // 3, y) for i in range(4) for k, x, y in corners], "id long, ord int, x double, y double")  # three alike
    cells = spark.createDataFrame([(1, 0, 0, 0.5, 1.0, 50.0), (2, 0, 1, 2.5, 1.0, 50.0), (3, 0, 2, 2.5, 1.0, 0.0), (4, 0, 3, None, 1.0, 50.0), (5, 0, 4, 2.5, 1.0, 500.0)], "cell_id int, row_index int, column_index int, cx double, cy double, area double")
    sources = spark.range(4).selectExpr("id as subbasin", "1d as declared", "'m2' as unit")
    paired = []
    monkeypatch.setattr(copies, "paired", lambda pairs, a, b, real=copies.paired: paired.append(pairs.columns) or real(pairs, a, b))
    m = transfer_maps.compile_map(cells, v, sources, 100.0, strict=False)
    assert paired == [["a_id", "b_id", "area"]]  # of polygons that overlap, none of cells
    assert {r.cell_id: r.subbasin for r in m.cells.collect()} == {1: None, 2: 3, 3: None, 4: None, 5: None}
    assert {(r.problem, r.subject) for r in m.problems.collect()} >= {("ambiguous cell", "1"), ("cell area", "5"), ("polygons overlap", "0,1"), ("polygons overlap", "0,3")}


def test_no_polygon_meets_another_when_problems_are_not_asked_for(spark, monkeypatch):
    from freshet.operators import overlay

    monkeypatch.setattr(overlay, "intersections", lambda *a, **k: pytest.fail("polygons met"))
    m = compiled(spark, [100, 50, 0, 100, 25, 100], [("A", 0, 0, 10, 20), ("B", 10, 0, 20, 20)], strict=False, problems=False)
    assert m.problems is None and {r.subbasin: r.cells for r in m.subbasins.collect()} == {"A": 2, "B": 2}
