"""Nearest neighbours by the quadtree against all pairs."""

import math
import random

import pytest

from flowtide.operators.nearest import candidates, nearest

PLACE = "lat double, lon double"


def metres(a, b):
    x, y = math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2)), math.radians(b[0] - a[0])
    return 6_371_000 * math.sqrt(x * x + y * y)


def frames(spark, points, targets):
    return spark.createDataFrame([(f"p{i}", *p) for i, p in enumerate(points)], f"k string, {PLACE}").repartition(3), spark.createDataFrame([(f"t{i:05d}", *t) for i, t in enumerate(targets)], f"c string, {PLACE}").repartition(3)


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_against_all_pairs(spark, leaf):
    """A city, a street of equal places, places over the globe and beyond it, on both sides of the equator."""
    rng = random.Random(leaf)
    city = lambda: (rng.gauss(-41.29, 0.01), rng.gauss(174.78, 0.01))
    globe = lambda: (rng.uniform(-89, 89), rng.uniform(-180, 180))
    targets = [city() for _ in range(120)] + [globe() for _ in range(40)] + [(-41.3, 174.8)] * 30 + [(0.0, 0.0), (0.001, 0.0), (91.0, 181.0), (None, 1.0)]
    points = [city() for _ in range(60)] + [globe() for _ in range(60)] + [(-41.3, 174.8), (0.0005, 0.0), (-90.0, 180.0), (95.0, 200.0), (None, None)]
    p, t = frames(spark, points, targets)
    got = {r.k: (r.c, r.metres) for r in nearest(p, t, "k", "c", leaf).collect()}
    assert set(got) == {f"p{i}" for i, x in enumerate(points) if x[0] is not None}
    for i, x in enumerate(points):
        if x[0] is not None:
            d, name = min((metres(x, y), f"t{j:05d}") for j, y in enumerate(targets) if y[0] is not None)
            assert abs(got[f"p{i}"][1] - d) <= 1e-6 * d + 1e-6 and (got[f"p{i}"][0] == name or abs(metres(x, targets[int(got[f"p{i}"][0][1:])]) - d) < 1e-6)


def test_ties_go_to_the_least_name(spark):
    p, t = frames(spark, [(0.0, 0.0)], [(0.0, 1.0), (0.0, 1.0), (0.0, 1.0)])
    assert nearest(p, t, "k", "c", 1).first().c == "t00000"


def test_a_city_in_one_cell_is_no_full_product(spark):
    """20,000 points and 20,000 targets within some streets: a hundred pairs for each point at most, where all pairs are 400 million."""
    n = 20_000
    place = lambda a, b: (f"-41.29 + (hash(id, {a}) % 10000) / 1000000D as lat", f"174.78 + (hash(id, {b}) % 10000) / 1000000D as lon")
    p = spark.range(n).selectExpr("id as k", *place(1, 2))
    t = spark.range(n).selectExpr("id as c", *place(3, 4))
    assert candidates(p, t, "k", "c").count() < 100 * n


def test_nothing_to_find(spark):
    p, t = frames(spark, [(0.0, 0.0)], [(1.0, 1.0)])
    assert nearest(p, t.where("false"), "k", "c").count() == 0 and nearest(p.where("false"), t, "k", "c").count() == 0
