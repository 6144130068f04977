import math
import random

from geoskein.llm.components import connected_components
from geoskein.llm.place_groups import near_links, osm_objects, place_links


def _groups(pairs, keys):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


def test_near_links_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"r{i:03d}", rng.choice("ab"), 10.0, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(250)]
    rows += [("r900", "a", 10.0, 200.0, 0.0), ("r901", "a", 10.0, 210.0, 0.0), ("r902", "a", 10.0, 220.01, 0.0), ("r903", "a", 10.0, 200.0, 0.0), ("r904", "a", 10.0, None, 0.0)]
    df = spark.createDataFrame(rows, "vertex string, k string, radius double, x double, y double")
    found = {r.vertex: r.component for r in connected_components(near_links(df, ["k"])).where("vertex < 'z'").collect()}
    labels = {r[0]: found.get(r[0], r[0]) for r in rows if r[3] is not None}
    usable = [r for r in rows if r[3] is not None]
    pairs = [(a[0], b[0]) for a in usable for b in usable if a[0] < b[0] and a[1] == b[1] and math.hypot(a[3] - b[3], a[4] - b[4]) <= 10.0]
    assert labels == _groups(pairs, [r[0] for r in usable])


POI = "destination_key string, snapshot_date date, category string, osm_type string, osm_id long, merged_osm_refs string, name string, wikidata_id string, geom_25832 struct<x:double,y:double>"


def test_rules_of_one_place(spark):
    import datetime as dt

    d1, d2 = dt.date(2011, 4, 4), dt.date(2011, 4, 18)
    rows = [
        ("a", d1, "food_social", "node", 1, '["way/9"]', "Kæde St. Pub", None, (0.0, 0.0)),
        ("b", d1, "food_social", "way", 9, "null", None, "?", None),  # shares an object
        ("c", d1, "food_social", "node", 3, '[{"osm_type":"node","osm_id"', "KÆDE  Station Pub!", "n/a", (35.0, 0.0)),  # same name, near
        ("d", d1, "food_social", "node", 4, '[{"osm_id":"77","osm_type":"node"}]', "Kæde St. Pub", "Q5", (80.0, 0.0)),  # name too far from c
        ("e", d1, "food_social", "node", 5, None, "Other", " wikidata:q5 ", (180.0, 0.0)),  # same number within 100 m
        ("f", d1, "cultural_tourist", "node", 6, '[{"osm_type":"node","osm_id":88}]', "Kæde St. Pub", "Q5", (0.0, 0.0)),  # another category
        ("g", d2, "food_social", "node", 1, "[]", "Kæde St. Pub", None, (0.0, 0.0)),  # another snapshot
        ("h", d1, "food_social", "node", 77, "", "", "", (900.0, 0.0)),
    ]
    pois = spark.createDataFrame(rows, POI)
    got = {}
    for r in connected_components(place_links(pois)).where("vertex < 'z'").collect():
        got.setdefault(r.component, set()).add(r.vertex[1:])
    assert sorted(map(sorted, (v for v in got.values() if len(v) > 1))) == [["a", "b", "c"], ["d", "e", "h"]]
    assert place_links(pois.limit(0)).count() == 0
    own = pois.selectExpr("destination_key as vertex", "*")
    assert {r.osm_id for r in osm_objects(own.where("vertex = 'c'")).collect()} == {3}


def _labels(spark, rows, radius):
    df = spark.createDataFrame([(f"r{i:06d}", "k", radius, x, y) for i, (x, y) in enumerate(rows)], "vertex string, k string, radius double, x double, y double")
    edges = near_links(df, ["k"])
    found = {r.vertex: r.component for r in connected_components(edges).collect()}
    return edges.count(), [int(found.get(f"r{i:06d}", f"r{i:06d}")[1:]) for i in range(len(rows))]


def _chained(rows, radius):
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (rows[i][0] - rows[j][0]) ** 2 + (rows[i][1] - rows[j][1]) ** 2 <= radius * radius]
    groups = _groups(pairs, list(range(n)))
    return [groups[i] for i in range(n)]


def test_crowds_on_either_side_of_the_radius(spark):
    """Two dense crowds whose nearest points are just within or just beyond the radius are parted or joined exactly."""
    rng = random.Random(12)
    for gap in (10.0, 10.0000001, 9.9999999, 10.01):
        left = [(1000 - rng.uniform(0, 3) ** 2, 500 + rng.uniform(-3, 3)) for _ in range(120)] + [(1000.0, 500.0)]
        right = [(1000 + gap + rng.uniform(0, 3) ** 2, 500 + rng.uniform(-3, 3)) for _ in range(120)] + [(1000.0 + gap, 500.0)]
        rows = left + right
        assert _labels(spark, rows, 10.0)[1] == _chained(rows, 10.0), gap


def test_edges_of_a_dense_brand_stay_linear(spark):
    """100,000 distinct points in a few cells: about one edge a point, and no pair of cells with more than its boxes."""
    rng = random.Random(13)
    rows = [(rng.uniform(0, 14.0), rng.uniform(0, 7.0)) for _ in range(100_000)]
    edges, labels = _labels(spark, rows, 10.0)
    assert set(labels) == {0}
    assert edges < 1.01 * len(rows)


def test_negative_coordinates_ties_and_repeats(spark):
    rng = random.Random(14)
    rows = [(rng.choice([-30.0, -20.0, -10.0, 0.0, 10.0, 13.0]), rng.choice([-20.0, -10.0, 0.0, 7.0, 10.0])) for _ in range(60)]
    assert _labels(spark, rows, 10.0)[1] == _chained(rows, 10.0)
