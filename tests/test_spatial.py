import math
import random

import pytest
from pyspark.sql import functions as F

from geoskein.functions import geo
from geoskein.operators import spatial

SQUARE = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
NEXT = [(100.0, 0.0), (200.0, 0.0), (200.0, 100.0), (100.0, 100.0), (100.0, 0.0)]
HOLE = [(20.0, 20.0), (40.0, 20.0), (40.0, 40.0), (20.0, 40.0), (20.0, 20.0)]
L_SHAPE = [(300.0, 0.0), (400.0, 0.0), (400.0, 30.0), (330.0, 30.0), (330.0, 90.0), (300.0, 90.0), (300.0, 0.0)]
AREA = "area_id string, rings array<array<struct<x:double,y:double>>>"


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([("sq", [SQUARE, HOLE]), ("next", [NEXT]), ("ell", [L_SHAPE]), ("none", []), ("null", None)], AREA).cache()


def _points(spark, n, seed, span=450.0):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-50, span), rng.uniform(-50, 150)) for i in range(n)]
    rows += [(n, None, 1.0), (n + 1, float("nan"), 1.0), (n + 2, rows[0][1], rows[0][2]), (n + 3, 30.0, 30.0), (n + 4, 100.0, 50.0), (n + 5, 0.0, 0.0)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "id long, x double, y double, area_id string")


def _inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [7.0, 33.0, 500.0])
def test_containing_area_against_brute_force(spark, areas, size):
    rows, df = _points(spark, 400, 1)
    got = {(r.id, r.area_id) for r in spatial.containing_area(df, areas, size, rows_per_salt=50).collect()}
    named = {"sq": [SQUARE, HOLE], "next": [NEXT], "ell": [L_SHAPE]}
    want = {(i, a) for i, x, y in rows if x is not None and x == x for a, rings in named.items() if _inside(x, y, rings)}
    assert got == want


def test_boundary_points_count_where_asked(spark, areas):
    df = spark.createDataFrame([(1, 100.0, 50.0), (2, 0.0, 0.0), (3, 30.0, 20.0), (4, 365.0, 30.0), (5, 365.0, 31.0)], "id long, x double, y double")
    got = sorted((r.id, r.area_id) for r in spatial.containing_area(df, areas, 50.0, boundary=True).collect())
    assert got == [(1, "next"), (1, "sq"), (2, "sq"), (3, "sq"), (4, "ell")]
    out = {r.id: (r.matches, r.area_id) for r in spatial.area_assignment(df, areas).collect()}
    assert out == {1: (2, None), 2: (1, "sq"), 3: (1, "sq"), 4: (1, "ell"), 5: (0, None)}


@pytest.mark.parametrize("salt", [3, 10_000])
def test_within_distance_against_brute_force(spark, salt):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.gauss(0, 9), rng.gauss(0, 9)) for i in range(150)] + [(900, "a", None, 0.0), (901, None, 0.0, 0.0), (902, "a", 0.0, 0.0), (902, "a", 0.0, 0.0)]
    right = [(i, rng.choice("ab"), rng.gauss(0, 9), rng.gauss(0, 9)) for i in range(80)] + [(900, "a", 3.0, 4.0)]
    a = spark.createDataFrame([(*r, 1) for r in left], "id long, k string, x double, y double, n int")
    b = spark.createDataFrame([(*r, 2) for r in right], "other_id long, k string, other_x double, other_y double, n int")
    out = spatial.within_distance(a, b, 5.0, ["k"], salt)
    assert "right_n" in out.columns
    got = sorted((r.id, r.other_id) for r in out.collect())
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[1] and p[2] is not None and math.hypot(p[2] - q[2], p[3] - q[3]) <= 5.0)
    assert got == want and (902, 900) in got
    assert spatial.within_distance(a.limit(0), b, 5.0, ["k"]).count() == 0


@pytest.mark.parametrize(("k", "same"), [(1, False), (3, True), (200, True)])
def test_k_nearest_against_brute_force(spark, k, same):
    rng = random.Random(k)
    pts = [(i, rng.gauss(0, 40), rng.gauss(0, 40)) for i in range(90)] + [(90, 5000.0, 0.0), (91, 0.0, 0.0), (92, 0.0, 0.0), (93, -1e6, 1e6)]
    a = spark.createDataFrame([*pts, (99, None, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame(pts, "other_id long, other_x double, other_y double")
    got = {}
    for r in spatial.k_nearest(a, b, k, 10.0, exclude_same_id=same).collect():
        got.setdefault(r.id, []).append((r.rank, r.other_id))
    want = {}
    for i, x, y in pts:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in pts if not (same and i == j))[:k]
        want[i] = [(n + 1, j) for n, (_, j) in enumerate(near)]
    assert {i: sorted(v) for i, v in got.items()} == want
    assert spatial.k_nearest(a, b.limit(0), k, 10.0).count() == 0


def test_boundary_distance_area_union_and_checks(spark, areas):
    df = spark.createDataFrame([(1, 50.0, 90.0), (2, 50.0, 130.0), (3, 30.0, 30.0)], "id long, x double, y double")
    near = {(r.id, r.area_id): r.distance for r in spatial.boundary_within(df, areas, 30.0, ["id"]).collect()}
    assert near == {(1, "sq"): 10.0, (2, "sq"): 30.0, (3, "sq"): 10.0}
    size = {r.area_id: r.area for r in spatial.polygon_area(areas).collect()}
    assert size == {"sq": 9600.0, "next": 10_000.0, "ell": 100 * 30 + 30 * 60}
    outline = {r.area_id: r["count"] for r in spatial.exterior_edges(areas).groupBy("area_id").count().collect()}
    assert outline == {"sq": 7, "next": 3, "ell": 6}
    assert spatial.ring_problems(areas).count() == 0
    bad = spark.createDataFrame([("a", [[(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (float("nan"), 0.0), (1.0, 1.0), (0.0, 0.0)]])], AREA)
    assert sorted((r.ring_no, r.problem) for r in spatial.ring_problems(bad).collect()) == [(0, "short"), (1, "open"), (2, "not_finite")]


def test_clipped_cells_add_up_and_surface_points_are_inside(spark, areas):
    cells = {r.area_id: r.a for r in spatial.clipped_cells(areas, 17.0).groupBy("area_id").agg(F.sum("area").alias("a")).collect()}
    assert {k: round(v, 6) for k, v in cells.items()} == {"sq": 9600.0, "next": 10_000.0, "ell": 4800.0}
    points = spatial.point_on_surface(areas).withColumnRenamed("area_id", "own").cache()
    assert points.count() == 3
    assert spatial.containing_area(points, areas).where("own = area_id").count() == 3


def test_hull(spark):
    rng = random.Random(9)
    pts = [(rng.random(), rng.random()) for _ in range(300)] + [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0), (0.5, -1.0)]
    assert sorted(spatial.convex_hull(spark.createDataFrame(pts, "x double, y double"))) == [(-1.0, -1.0), (-1.0, 2.0), (2.0, -1.0), (2.0, 2.0)]


def test_count_within_keeps_zero_and_null(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, 999.0, 0.0), (3, None, None)], "id long, x double, y double")
    d = spark.createDataFrame([(1, 3.0, 4.0, "a"), (2, 0.0, 9.0, "a"), (3, 0.0, 1.0, "b")], "other_id long, other_x double, other_y double, category string")
    out = {r.id: (r.within_5_a, r.within_10_a, r.within_10_b) for r in spatial.count_within(o, d, [5, 10], ["a", "b"]).collect()}
    assert out == {1: (1, 2, 1), 2: (0, 0, 0), 3: (None, None, None)}


def test_projection_against_known_points(spark):
    df = spark.createDataFrame([(9.0, 0.0), (12.568337, 55.676098), (9.0, 55.0)], "lon double, lat double")
    out = [(r.x, r.y) for r in geo.with_utm32(df).collect()]
    assert out[0] == (500000.0, 0.0) and abs(out[2][0] - 500000.0) < 1e-6
    assert abs(out[1][0] - 724400) < 500 and abs(out[1][1] - 6175800) < 500
    metres = df.select(geo.great_circle_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(metres - 111195) < 1


def test_k_nearest_with_outliers_and_split_cells(spark):
    """A far point, groups smaller than k, and cells cut by a small salt, against all distances."""
    rng = random.Random(21)
    pts = [(i, "ab"[i % 2], rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(160)] + [(900, "a", 90_000.0, -70_000.0), (901, "c", 1.0, 1.0), (902, "c", 2.0, 2.0), (903, "a", None, 1.0)]
    left = spark.createDataFrame(pts, "id long, g string, x double, y double")
    right = left.selectExpr("id as other_id", "g", "x as other_x", "y as other_y")
    got = {}
    for r in spatial.k_nearest(left, right, 4, 10.0, exclude_same_id=True, keys=["g"], rows_per_salt=3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other_id))
    usable = [p for p in pts if p[2] is not None]
    for i, g, x, y in usable:
        near = sorted((math.hypot(x - a, y - b), j) for j, h, a, b in usable if h == g and j != i)[:4]
        assert sorted(got.get(i, [])) == [(n + 1, j) for n, (_, j) in enumerate(near)], i
