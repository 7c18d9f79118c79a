"""The quadtree's nearest targets equal brute force, for even and for very uneven points and targets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import spatial, transfer


def spread(kind, rng, n):
    if kind == "even":
        return [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)]
    if kind == "spot":  # nearly all within a millionth of the width, a few far away
        return [(50 + rng.uniform(0, 1e-4), 50 + rng.uniform(0, 1e-4)) if rng.random() < 0.97 else (rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)]
    if kind == "line":
        return [(rng.uniform(0, 100), 7.0) for _ in range(n)]
    if kind == "lattice":  # ties and repeated places
        return [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(n)]
    return [(3.0, 4.0)] * n


@pytest.mark.parametrize("points,targets", [("even", "spot"), ("spot", "spot"), ("line", "lattice"), ("even", "one")])
def test_tree_equals_brute_force(spark, points, targets):
    rng = random.Random(7)
    p, t = spread(points, rng, 200), spread(targets, rng, 1500)
    pdf = spark.createDataFrame([(i, *xy) for i, xy in enumerate(p)], "k long, x double, y double")
    tdf = spark.createDataFrame([(1000 - i, *xy) for i, xy in enumerate(t)], "tid long, tx double, ty double")
    got = {r.k: (r.tid, r.distance) for r in spatial.nearest(pdf, tdf, cap=8).collect()}
    at, ids = np.array(t), np.array([1000 - i for i in range(len(t))])
    for i, xy in enumerate(p):
        d = np.sqrt((xy[0] - at[:, 0]) ** 2 + (xy[1] - at[:, 1]) ** 2)
        assert got[i][1] == pytest.approx(d.min(), abs=1e-12) and got[i][0] == ids[d == d.min()].min(), (i, got[i], d.min())


def test_leaves_stay_small_where_all_targets_are_in_one_spot(spark):
    rng = random.Random(1)
    t = spark.createDataFrame([(i, *xy) for i, xy in enumerate(spread("spot", rng, 4000))], "tid long, tx double, ty double")
    tree = spatial.Quadtree(t, 16)
    assert tree.levels[tree.deepest].agg(F.max("n")).first()[0] <= 16 and tree.deepest >= 20
    for level, d in tree.levels.items():
        if level < tree.deepest:
            full = d.where("n > 16").select("ix", "iy").collect()
            below = {(r.ix, r.iy) for r in tree.children(level + 2).select("ix", "iy").collect()}
            assert {(r.ix, r.iy) for r in full} <= below


def test_grid_gives_way_to_the_tree(spark):
    rng = random.Random(3)
    t = spark.createDataFrame([(i, *xy) for i, xy in enumerate(spread("spot", rng, 1200))], "tid long, tx double, ty double")
    p = spark.createDataFrame([(f"p{i}", *xy) for i, xy in enumerate(spread("even", rng, 60))] + [("null", None, 1.0), ("nan", 2.0, float("nan")), ("p0", 1.0, 1.0)], "name string, x double, y double")
    rows = lambda d: sorted((r.name, r.x or 0, r.tid or -1, round(r.distance or 0, 9)) for r in d.select(F.col("name"), "x", "tid", "distance").collect())
    by_tree, by_grid = rows(transfer.nearest(p, t)), rows(transfer.nearest(p, t, dense=10**9))
    assert by_tree == by_grid and len(by_tree) == 63


def test_rounds_write_cells_and_not_points(spark, monkeypatch):
    rng = random.Random(5)
    p = [(i, 20 + rng.uniform(0, 1e-7), 30 + rng.uniform(0, 1e-7)) for i in range(3000)]
    t = spread("spot", rng, 500)
    written = []
    keep = spatial.checkpointed

    def counted(df):
        out = keep(df)
        if {"px", "best"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(spatial, "checkpointed", counted)
    got = spatial.nearest(spark.createDataFrame(p, "k long, x double, y double"), spark.createDataFrame([(i, *xy) for i, xy in enumerate(t)], "tid long, tx double, ty double"))
    assert got.count() == 3000 and written and max(written) < 1000, written
