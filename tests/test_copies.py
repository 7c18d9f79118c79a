"""Copies of points, polygons and boxes are worked once and all paired out."""

from pyspark.sql import functions as F

from freshet.operators import copies, geometry, overlay, transfer


def squares(spark, n, side=1.0):
    """n squares in two places, every other one run the other way and begun elsewhere."""
    rows = [(i, (-1) ** (i // 2 % 2) * k, i % 2 * 0.5 + side * x, side * y) for i in range(n) for k, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    return spark.createDataFrame(rows, "id long, ord int, x double, y double")


def test_pairs_of_many_copies_are_all_written(spark, monkeypatch):
    monkeypatch.setattr(copies, "CHUNK", 7)
    monkeypatch.setattr(copies, "ROWS", 100)
    p = spark.range(60).selectExpr("id as point", "0.25d + id % 3 as px", "0.5d as py")
    v = squares(spark, 40)
    want = {(i, j) for i in range(60) for j in range(40) if j % 2 * 0.5 <= 0.25 + i % 3 < j % 2 * 0.5 + 1}
    got = [tuple(r) for r in geometry.within(p, v).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    held = {r.point: (r.n, r.area_id) for r in geometry.holders(p, v).collect()}
    assert held == {i: ((20, min(b for a, b in want if a == i)) if any(a == i for a, _ in want) else (None, None)) for i in range(60)}
    both = {(r.a_id, r.b_id): r.area for r in overlay.intersections(v, squares(spark, 30)).collect()}
    assert both == {(i, j): 1.0 if i % 2 == j % 2 else 0.5 for i in range(40) for j in range(30)}
    box = lambda n: spark.range(n).selectExpr("id", "id % 2 * 0.5d as x0", "0d as y0", "id % 2 * 0.5d + 1 as x1", "1d as y1")
    assert {(r.a_id, r.b_id): r.area for r in transfer.overlap(box(40), box(30), 2.0).collect()} == both


def test_shapes_and_places_are_told_apart_once(spark):
    shapes, same = overlay.kinds(overlay.sides(squares(spark, 100)))
    assert shapes.select("id").distinct().count() == 2 and shapes.count() == 4  # two upright sides each
    assert same.groupBy("rep").count().collect() and same.count() == 100
    one, _ = copies.kinds(spark.range(90).selectExpr("id as point", "double(id % 3) as px", "0d as py"), ["px", "py"], "point")
    assert sorted(map(tuple, one.select("rep", "n").collect())) == [(0, 30), (1, 30), (2, 30)]


def test_overlap_of_one_id_meets_no_other(spark):
    a = squares(spark, 12)
    b = a.withColumn("x", F.col("x") + 0.25)
    own = {(r.a_id, r.b_id): r.area for r in overlay.intersections(a, b, own=True).collect()}
    assert own == {(i, i): 0.75 for i in range(12)}
    assert {r.id: r.intersection_area for r in overlay.overlap(a, b).collect()} == {i: 0.75 for i in range(12)}


def test_told_boundaries(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.5), (3, 0.0, 0.5), (4, 9.0, 9.0), (5, None, 1.0)], "point int, px double, py double")
    got = {(r.point, r.id, r.contains) for r in geometry.within(p, squares(spark, 1), boundary="covers", told=True).collect()}
    assert got == {(1, 0, True), (2, 0, False), (3, 0, False)}


def test_held_places_go_to_the_points(spark, monkeypatch):
    corners = [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0)]
    v = spark.createDataFrame([(i, k, x + i // 3, y) for i in range(4) for k, x, y in corners], "id long, ord int, x double, y double")
    p = spark.createDataFrame([(1, 0.5, 1.0), (2, 2.5, 1.0), (3, None, 1.0), (4, 9.0, 9.0), (5, 2.5, 1.0), (6, float("nan"), 1.0), (7, 0.5, None)], "point int, px double, py double")
    want = {1: (3, 0), 2: (1, 3), 3: (None, None), 4: (None, None), 5: (1, 3), 6: (None, None), 7: (None, None)}
    few = geometry.holders(p, v)
    plan = few._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no point is shuffled
    monkeypatch.setattr(geometry, "HELD", 1)
    many = geometry.holders(p, v)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().sparkPlan().toString()
    for found in (few, many):
        assert found.count() == 7 and {r.point: (r.n, r.area_id) for r in found.collect()} == want
