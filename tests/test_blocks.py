"""Counts and nearest destinations by blocks against all distances."""

import math
import random

import numpy as np
import pytest

from geoskein.operators import blocks, spatial


@pytest.mark.parametrize("step", [0.0, 50.0])
def test_arrays_against_all_distances(step):
    rng = np.random.default_rng(5)
    p, q = rng.uniform(0, 1600, (2, 400)), rng.uniform(-1600, 3200, (2, 700))
    if step:  # equal distances and distances equal to a radius
        p, q = np.round(p / step) * step, np.round(q / step) * step
    d = np.sqrt((p[0][:, None] - q[0]) ** 2 + (p[1][:, None] - q[1]) ** 2)
    assert (blocks.counts(*p, *q, [800.0, 1600.0]) == np.stack([(d <= r).sum(1) for r in (800, 1600)], 1)).all()
    at, least = blocks.nearest(*p, *q, 100.0)
    near = d.min(1) <= 100
    assert (at == np.where(near, d.argmin(1), -1)).all() and (least[near] == d.min(1)[near]).all()


def test_largest_square_is_where_the_root_passes_the_radius():
    for r in (3.0, 800.0, 1200.1):
        t = blocks.largest_square(r)
        assert math.sqrt(t) <= r < math.sqrt(math.nextafter(t, math.inf))


def _all(points, others, radii):
    out = {}
    for i, g, x, y in points:
        if x is None or math.isnan(x):
            out[i] = (*[None] * len(radii), None, None)
            continue
        near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, h, a, b, _ in others if h == g and g is not None and a is not None)
        counts = [sum(1 for d, j in near if d <= r and others[j][4] == "a") for r in radii]
        out[i] = (*counts, near[0][1] if near else None, near[0][0] if near else None)
    return out


def test_access_with_split_blocks_far_points_and_ties(spark):
    """Blocks cut by a small limit, far points, equal distances, missing points and keys, a group without destinations."""
    rng = random.Random(8)
    points = [(i, "gh"[i % 2], float(rng.randrange(0, 90)), float(rng.randrange(0, 90))) for i in range(150)]
    points += [(200 + i, "g", 5e6 + 40.0 * i, 2e6 - 7.0 * i) for i in range(20)] + [(300 + i, "h", -505646.7, 0.0) for i in range(9)]
    points += [(400, "g", None, 1.0), (401, "g", float("nan"), 1.0), (402, "n", 1.0, 1.0), (403, None, 1.0, 1.0)]
    others = [(j, "gh"[j % 2], float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60)), "ab"[j % 3 == 0]) for j in range(80)] + [(80, "g", None, None, "a"), (81, None, 1.0, 1.0, "a")]
    left = spark.createDataFrame(points, "id long, g string, x double, y double")
    right = spark.createDataFrame(others, "other_id long, g string, other_x double, other_y double, category string")
    out = spatial.access(left, right, [5, 20], ["a"], ["g"], nearest=10.0, rows_per_block=7).collect()
    assert len(out) == len(points)
    assert {r.id: (r.within_5_a, r.within_20_a, r.other_id, r.distance) for r in out} == _all(points, others, (5, 20))


def test_access_without_keys_or_destinations(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 70.0, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([("p", 3.0, 4.0), ("o", 3.0, -4.0)], "other_id string, other_x double, other_y double")
    assert {r.id: (r.other_id, r.distance) for r in spatial.access(left, right, [], [], nearest=10.0).collect()} == {1: ("o", 5.0), 2: ("o", math.hypot(67, 4))}
    assert {r.id: r.other_id for r in spatial.access(left, right.limit(0), [], [], nearest=10.0).collect()} == {1: None, 2: None}


def test_euclid_access_lists_no_pairs(spark, small):
    """At seventy times sf0.1 the pairs within 1,600 m are some 20 billion: the plan may not join points with destinations."""
    from geoskein.plans.access import euclid_access

    plan = euclid_access(spark, small)._jdf.queryExecution().analyzed().toString()
    assert "other_x" in plan and "squared" not in plan
    assert not any("Join Inner" in line for line in plan.splitlines())
