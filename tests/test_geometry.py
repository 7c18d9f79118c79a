"""Overlay, coverage, dissolve and projections against plain versions and published figures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions import projection
from freshet.operators import geometry, overlay

VERTICES = "id int, part int, ring int, ord int, x double, y double"


def rows_of(polygons):
    """Vertices of {id: [[outline, hole, ...], ...]}."""
    return [(i, p, r, k, float(x), float(y)) for i, parts in polygons.items() for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]


def star(rng, x, y, size, n):
    """A ring around (x, y), not convex, run either way."""
    ring = [(x + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return ring if rng.random() < 0.5 else ring[::-1]


def inside(parts, x, y):
    odd = False
    for rings in parts:
        for ring in rings:
            for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
                if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                    odd = not odd
    return odd


def strip_area(tests, lo, hi, n=400):
    """Area where all tests hold, by exact spans along many level lines."""
    step, total = (hi - lo) / n, 0.0
    for k in range(n):
        y = lo + (k + 0.5) * step
        cuts = sorted({(c - a) * (y - b) / (d - b) + a for parts in tests for rings in parts for ring in rings for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]) if (b > y) != (d > y)})
        total += sum(q - p for p, q in zip(cuts, cuts[1:]) if all(inside(t, (p + q) / 2, y) for t in tests)) * step
    return total


def shapes(seed, n):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        x, y = rng.uniform(0, 12), rng.uniform(0, 12)
        parts = [[star(rng, x, y, 3, rng.randint(3, 9)), star(rng, x, y, 0.8, 4)]]
        if i % 3 == 0:
            parts.append([star(rng, x + 8, y, 1.5, 5)])
        out[i] = parts
    return out


@pytest.mark.parametrize("band,width", [(None, None), (0.7, 1.3)])
def test_intersections_of_polygons_with_holes_and_parts(spark, band, width):
    a, b = shapes(1, 6), shapes(2, 5)
    b[9] = [[[(100, 100), (101, 100), (101, 101)]]]
    got = {(r.a_id, r.b_id): r.area for r in overlay.intersections(spark.createDataFrame(rows_of(a), VERTICES), spark.createDataFrame(rows_of(b), VERTICES), band, width, 1e-9).collect()}
    for i, p in a.items():
        for j, q in b.items():
            want = strip_area([p, q], -4, 17, 2000)
            assert abs(got.get((i, j), 0) - want) < 0.02 + 0.01 * want, (i, j)
    own = {r.id: r.area for r in overlay.areas(spark.createDataFrame(rows_of(a), VERTICES)).collect()}
    same = {r.a_id: r.area for r in overlay.intersections(*[spark.createDataFrame(rows_of(a), VERTICES)] * 2, band, width).where("a_id = b_id").collect()}
    assert all(abs(own[i] - same[i]) < 1e-9 for i in a)


def test_areas_centroids_and_odd_tables(spark):
    hole = {1: [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]], 2: [[[(0, 0), (1, 1)]]], 3: [[[(1e6, 1e6), (1e6 + 3, 1e6), (1e6, 1e6 + 3)]]]}
    rows = rows_of(hole) + [(1, 0, 0, 9, None, 1.0), (4, 0, 0, 0, 1.0, 1.0)]
    got = {r.id: (r.area, r.cx, r.cy) for r in overlay.areas(spark.createDataFrame(rows, VERTICES)).collect()}
    assert got[1] == (12.0, 2.0, 2.0) and 2 not in got and 4 not in got
    assert got[3] == pytest.approx((4.5, 1e6 + 1, 1e6 + 1), abs=1e-9)
    empty = spark.createDataFrame([], VERTICES)
    assert overlay.areas(empty).count() == 0 and overlay.intersections(empty, empty).count() == 0
    assert overlay.cell_areas(empty, 1.0).count() == 0 and overlay.overlap(empty, empty).count() == 0


def test_cells_of_a_ring_with_a_hole(spark):
    p = shapes(5, 1)
    v = spark.createDataFrame(rows_of(p), VERTICES)
    cells = {(r.col, r.row): r.area for r in overlay.cell_areas(v, 0.9, 1e-12, 0.2, -0.3).collect()}
    assert sum(cells.values()) == pytest.approx(overlay.areas(v).first().area)
    for (c, r), area in cells.items():
        x, y = 0.2 + 0.9 * c, -0.3 + 0.9 * r
        box = [[[(x, y), (x + 0.9, y), (x + 0.9, y + 0.9), (x, y + 0.9)]]]
        assert area == pytest.approx(strip_area([p[0], box], y, y + 0.9), abs=2e-3)


def test_overlap_of_two_watersheds(spark):
    a = spark.createDataFrame(rows_of({1: [[[(0, 0), (4, 0), (4, 4), (0, 4)]]], 2: [[[(0, 0), (1, 0), (1, 1)]]]}), VERTICES)
    b = spark.createDataFrame(rows_of({1: [[[(2, 0), (6, 0), (6, 4), (2, 4)], [(3, 1), (3, 2), (5, 2), (5, 1)]]], 3: [[[(9, 9), (8, 9), (8, 8)]]]}), VERTICES)
    got = {r.id: r.asDict() for r in overlay.overlap(a, b).collect()}
    one = got[1]
    assert (one["reference_area"], one["candidate_area"], one["intersection_area"], one["union_area"]) == (16, 14, 7, 23)
    assert (one["iou"], one["false_negative_area"], one["false_positive_area"]) == (7 / 23, 9, 7) and one["percent_difference"] == -12.5
    assert got[2]["iou"] == 0 and got[2]["candidate_area"] == 0 and got[3]["reference_covered"] is None


def test_coverage_by_grid(spark):
    cells = overlay.cell_areas(spark.createDataFrame(rows_of({1: [[[(0.5, 0.5), (2.5, 0.5), (2.5, 1.5), (0.5, 1.5)]]], 2: [[[(-1, 0), (1, 0), (1, 1), (-1, 1)]]]}), VERTICES), 1.0)
    polygons = spark.createDataFrame([(1, 2.0, "a"), (2, 2.0, "a"), (3, 5.0, "b")], "id int, area double, name string")
    mask = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "col long, row long")
    got = {r.name: (r.area, r.covered, r.nodata, r.outside, r.n) for r in overlay.coverage(cells, mask, 2, 3, polygons, ["name"]).collect()}
    assert got == {"a": (4.0, 2.25, 0.75, 1.0, 2), "b": (5.0, 0.0, 0.0, 5.0, 1), None: (9.0, 2.25, 0.75, 6.0, 3)}


def test_points_on_sides(spark):
    ring = {1: [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]]}
    v = spark.createDataFrame(rows_of(ring), VERTICES)
    points = [("corner", 0, 0), ("low", 2, 0), ("right", 4, 2), ("top", 2, 4), ("hole side", 1, 2), ("hole", 2, 2), ("in", 0.5, 2), ("out", 5, 2), ("none", None, 2)]
    p = spark.createDataFrame([(n, None if x is None else float(x), float(y)) for n, x, y in points], "point string, px double, py double")
    got = {b: {r.point for r in geometry.within(p, v, 1.5, b).collect()} for b in ("half-open", "covers", "contains")}
    assert got["contains"] == {"in"} and got["covers"] == {"corner", "low", "right", "top", "hole side", "in"}
    assert {"in"} <= got["half-open"] <= got["covers"]
    with pytest.raises(ValueError):
        geometry.within(p, v, 1.0, "touches")


# Published examples: Lambert (Texas south central on the 1866 ellipsoid, survey feet), Albers, transverse Mercator (1830 ellipsoid).
EXAMPLES = [
    (projection.Projection("lambert", -99.0, 27 + 50 / 60, (28 + 23 / 60, 30 + 17 / 60), east=2_000_000 * projection.US_FOOT, unit=projection.US_FOOT, ellipsoid=projection.CLARKE_1866), -96.0, 28.5, 2963503.91, 254759.80, 0.01),
    (projection.Projection("albers", -96.0, 23.0, (29.5, 45.5), ellipsoid=projection.CLARKE_1866), -75.0, 35.0, 1885472.7, 1535925.0, 0.1),
    (projection.Projection("mercator", -2.0, 49.0, scale=0.9996012717, east=400_000.0, north=-100_000.0, ellipsoid=projection.AIRY), 0.5, 50.5, 577274.99, 69740.50, 0.01),
]


@pytest.mark.parametrize("p,lon,lat,x,y,near", EXAMPLES)
def test_published_examples(spark, p, lon, lat, x, y, near):
    r = projection.forward(spark.createDataFrame([(lon, lat)], "lon double, lat double"), p).first()
    assert abs(r.x - x) <= near and abs(r.y - y) <= near


@pytest.mark.parametrize("code", [5070, 2278, 26914])
def test_projections_come_back(spark, code):
    p = projection.crs(code)
    rng = random.Random(code)
    far = 3 if p.kind == "mercator" else 12
    rows = [(p.lon0 + rng.uniform(-far, far), rng.uniform(20, 55)) for _ in range(300)] + [(None, 30.0), (p.lon0, 89.0), (p.lon0 + 360, 31.0)]
    df = projection.inverse(projection.forward(spark.createDataFrame(rows, "a double, b double"), p, "a", "b"), p)
    assert df.columns == ["a", "b", "x", "y", "lon", "lat"]
    for r in df.collect():
        if r.a is None:
            assert r.x is None and r.lat is None
        else:
            metre = 1 / 111_320
            assert abs((r.lon - r.a + 180) % 360 - 180) * math.cos(math.radians(r.b)) < 1e-6 * metre and abs(r.lat - r.b) < 1e-6 * metre
    again = projection.reproject(projection.reproject(df.where("x is not null and b < 60").select("x", "y", F.col("x").alias("x0"), F.col("y").alias("y0")), p, projection.crs(5070)), projection.crs(5070), p)
    assert all(abs(r.x - r.x0) < 1e-6 * (1 / p.unit) * 10 and abs(r.y - r.y0) < 1e-6 * (1 / p.unit) * 10 for r in again.collect())
    with pytest.raises(ValueError):
        projection.crs(4326)


def test_equal_area_projection_keeps_areas(spark):
    """A box of a tenth of a degree has the same area anywhere along its parallel."""
    ring = lambda i, x: (i, [[[(x, 35.0), (x + 0.1, 35.0), (x + 0.1, 35.1), (x, 35.1)]]])
    v = spark.createDataFrame(rows_of(dict([ring(1, -96.0), ring(2, -80.0)])), VERTICES)
    flat = projection.forward(v, projection.crs(5070), "x", "y", "px", "py").select("id", "part", "ring", "ord", F.col("px").alias("x"), F.col("py").alias("y"))
    a = {r.id: r.area for r in overlay.areas(flat).collect()}
    assert abs(a[1] / a[2] - 1) < 1e-5


# --- dissolve, near-equal fingerprints, networks ---


def cells_of(zones):
    return [(k, 0, 0, i, float(x + dx), float(y + dy), z) for k, ((x, y), z) in enumerate(zones.items()) for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)) if k % 2 else ((0, 1), (1, 1), (1, 0), (0, 0)))]


def ring_area(points):
    return sum(a * d - c * b for (a, b), (c, d) in zip(points, points[1:] + points[:1])) / 2


def test_dissolve_finds_outlines_and_holes(spark):
    """A frame with two holes that touch in a point, a cell inside one of them, and two cells that touch in a point."""
    frame = {(x, y): "f" for x in range(5) for y in range(5) if (x, y) not in ((1, 1), (2, 2), (3, 3))}
    zones = frame | {(2, 2): "g", (9, 9): "h", (10, 10): "h", (7, 0): None}
    v = spark.createDataFrame(cells_of(zones), VERTICES + ", zone string")
    rings = {}
    for r in overlay.dissolve(v, "zone").orderBy("ring", "ord").collect():
        rings.setdefault((r.group, r.ring, r.hole), []).append((r.ord, r.x, r.y))
    seen = {}
    for (g, _, hole), points in rings.items():
        assert [o for o, _, _ in points] == list(range(len(points)))
        assert all(abs(a - c) + abs(b - d) == 1 for (_, a, b), (_, c, d) in zip(points, points[1:] + points[:1]))
        area = ring_area([(x, y) for _, x, y in points])
        assert (area < 0) == hole
        seen.setdefault(g, []).append(area)
    assert sorted(seen["f"])[-1] == 25 and sum(seen["f"]) == 22
    assert seen["g"] == [1] and sorted(seen["h"]) == [1, 1] and seen[None] == [1]
    assert overlay.dissolve(v.limit(0), "zone").count() == 0
    torn = spark.createDataFrame([(1, 0, 0, i, float(x), float(y), "z") for i, (x, y) in enumerate(((0, 0), (2, 0), (2, 2), (0, 2)))], VERTICES + ", zone string")
    assert overlay.dissolve(torn.union(torn.withColumn("id", F.lit(2))), "zone").select("ring").distinct().count() == 1


def test_dissolve_of_a_long_snake(spark):
    """Rings of very different lengths: rounds follow the logarithm."""
    snake = {(x, 2 * y): "s" for y in range(6) for x in range(15)} | {((14 if y % 2 == 0 else 0), 2 * y + 1): "s" for y in range(5)}
    rings = overlay.dissolve(spark.createDataFrame(cells_of(snake), VERTICES + ", zone string"), "zone", max_rounds=12)
    points = [(r.x, r.y) for r in rings.orderBy("ord").collect()]
    assert ring_area(points) == len(snake) and len(points) == 2 * len(snake) + 2


@pytest.mark.parametrize("tolerance", [0.0, 0.1])
def test_near_pairs_equal_all_pairs(spark, tolerance):
    from freshet.operators import fingerprints

    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = [(i, [x + rng.choice([0, 0, tolerance, tolerance * 1.01, -tolerance / 2]) for x in rng.choice(base)]) for i in range(250)]
    rows += [(900, None), (None, base[0]), (901, [float("nan")] * 6), (902, base[0][:3]), (903, base[0][:3]), (904, [None] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    close = {(a, b) for a, v in good for b, w in good if a < b and len(v) == len(w) and max(abs(x - y) for x, y in zip(v, w)) <= tolerance}
    assert {tuple(r) for r in fingerprints.near_pairs(df, tolerance).collect()} == close
    root = {i: i for i, _ in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in close:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {i for p in close for i in p}
    groups = fingerprints.near_groups(df, tolerance)
    assert {tuple(r) for r in groups.collect()} == {(i, find(i)) for i in linked}
    results = spark.createDataFrame([(i, [float(find(i) if i % 7 else i)]) for i, _ in good], "id long, v array<double>")
    got = {r.group: (r.n, r.ambiguous) for r in fingerprints.ambiguities(groups, results, 0.5).collect()}
    for g, (n, bad) in got.items():
        own = [i for i in linked if find(i) == g]
        values = [find(i) if i % 7 else i for i in own]
        assert n == len(own) and bad == (max(values) - min(values) > 0.5)
    plan = fingerprints.near_pairs(df, tolerance)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dense_vectors_make_few_pairs(spark, monkeypatch):
    from freshet.operators import fingerprints

    rng = random.Random(5)
    spot = [(i, [rng.uniform(0.1, 0.19) for _ in range(3)]) for i in range(200)]
    rows = [*spot, (500, [0.25, 0.15, 0.15]), (501, [0.34, 0.15, 0.15]), (502, [0.45, 0.15, 0.15]), (503, [0.9] * 3), (503, [2.0] * 3), (504, [2.05] * 3), (505, [0.95] * 3)]
    met = []
    monkeypatch.setattr(fingerprints, "components", lambda pairs, real=fingerprints.components: met.append(pairs.count()) or real(pairs))
    for few in (0, fingerprints.FEW):
        monkeypatch.setattr(fingerprints, "FEW", few)
        got = {tuple(r) for r in fingerprints.near_groups(spark.createDataFrame(rows, "id long, v array<double>"), 0.1).collect()}
        assert got == {(i, 0) for i, _ in [*spot, (500, 0), (501, 0)]} | {(503, 503), (504, 503), (505, 503)}
    assert max(met) < 210  # all pairs of the spot are 19,900


def test_cells_get_narrower_as_vectors_get_more():
    from types import SimpleNamespace

    from freshet.operators import fingerprints

    per = lambda n: [SimpleNamespace(k=k, lo=-0.4, hi=0.4, sd=0.12, n=n) for k in range(6)]
    widths = [max(w for _, _, w in fingerprints._grid(per(n), 0.05)) for n in (10_000, 1_000_000, 100_000_000)]
    assert widths[0] > widths[1] > widths[2] and len(fingerprints._grid(per(1_000_000), 0.05)) == 6


@pytest.mark.parametrize("seed,diversions", [(0, 0), (2, 12)])
def test_upstream_of_random_networks(spark, seed, diversions):
    """Long chains, trees, diversions and cycles against a walk."""
    from freshet.operators import network

    rng = random.Random(seed)
    edge = [(i, "Reach" if i % 3 else "Subbasin", max(0, i - rng.choice([1, 1, 1, 2, 9]))) for i in range(1, 150)]
    edge += [(200 + k, "Junction", 200 + (k + 1) % 5) for k in range(5)] + [(210, "Subbasin", 201)]
    edge += [(rng.randrange(20, 150), "Diversion", rng.randrange(0, 20)) for _ in range(diversions)]
    targets = [0, 5, 20, 60, 149, 202, 777, None]
    df = spark.createDataFrame(edge, "src long, src_type string, dst long")
    got = sorted(tuple(r) for r in network.upstream(df, spark.createDataFrame([(t,) for t in targets], "target long")).collect())
    want = []
    for t in targets:
        reach, new = {t}, [t]
        while new:
            new = list({s for s, _, d in edge if d in new} - reach)
            reach |= set(new)
        want += [(t, s, k) for s, k, d in edge if d in reach and t is not None]
    assert got == sorted(want)


def test_sizes_follow_the_data(spark):
    """Without a bucket or band size the results are the same."""
    from freshet.operators import transfer

    rng = random.Random(8)
    v = spark.createDataFrame(rows_of(shapes(3, 5)), VERTICES)
    p = spark.createDataFrame([(i, rng.uniform(-2, 15), rng.uniform(-2, 15)) for i in range(150)], "point int, px double, py double")
    assert {tuple(r) for r in geometry.within(p, v).collect()} == {tuple(r) for r in geometry.within(p, v, 2.5).collect()}
    points = p.select("point", F.col("px").alias("x"), F.col("py").alias("y"))
    for n in (1, 2, 60):
        t = [(i, rng.uniform(0, 9), rng.uniform(0, 9) if n != 2 else 4.0) for i in range(n)]
        got = {r.point: r.tid for r in transfer.nearest(points, spark.createDataFrame(t, "tid long, tx double, ty double")).collect()}
        want = {r.point: min(t, key=lambda q: (math.dist((r.px, r.py), q[1:]), q[0]))[0] for r in p.collect()}
        assert got == want
