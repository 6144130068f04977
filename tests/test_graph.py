import random

import pytest
from pyspark.sql import functions as F

from geoskein.operators import graph

# A ring 10 -> 11 -> 12 -> 10, a loop 12 -> 13 -> 14 -> 12 hanging on it, and 15 with a way in only.
ARCS = [(10, 11, 120.0), (11, 12, 250.0), (12, 10, 90.0), (12, 13, 400.0), (13, 14, 75.0), (14, 12, 60.0), (15, 11, 30.0)]


def _arcs(spark, rows=ARCS):
    return spark.createDataFrame(rows, "src long, dst long, length_m double")


@pytest.mark.parametrize("in_task", [0, 1000])
def test_nearest_source_along_a_ring(spark, in_task):
    seeds = spark.createDataFrame([(13, 10.0, "m"), (11, 40.0, "k"), (11, 70.0, "a")], "node long, cost double, source string")
    best = {r.node: (r.distance, r.source) for r in graph.nearest_source(_arcs(spark), seeds, arcs_in_task=in_task).collect()}
    assert best == {10: (160.0, "k"), 11: (40.0, "k"), 12: (250.0, "k"), 13: (10.0, "m"), 14: (310.0, "k"), 15: (70.0, "k")}
    level = seeds.union(spark.createDataFrame([(11, 40.0, "j")], "node long, cost double, source string"))
    assert {r.source for r in graph.nearest_source(_arcs(spark), level, cutoff=200.0, arcs_in_task=in_task).collect()} == {"j", "m"}
    assert graph.nearest_source(_arcs(spark), seeds.limit(0), arcs_in_task=in_task).count() == 0


@pytest.mark.parametrize("in_task", [0, 1000])
def test_counts_within_budgets(spark, in_task):
    origins = spark.createDataFrame([(1, 15, 5.0), (2, 12, 100.0), (3, 12, 9000.0)], "id long, node long, snap_m double")
    places = spark.createDataFrame([("a", "food", 12, 20.0), ("b", "food", 13, 0.0), ("c", "culture", 10, 15.0)], "key string, category string, node long, snap_m double")
    got = {(r.id, r.category): (r.within_300, r.within_400, r.within_700) for r in graph.reach_counts(_arcs(spark), origins, places, (300, 400, 700), arcs_in_task=in_task).collect()}
    assert got == {(1, "food"): (0, 1, 2), (1, "culture"): (0, 1, 1), (2, "food"): (1, 1, 2), (2, "culture"): (1, 1, 1)}


def test_rounds_equal_the_heap_search(spark):
    rng = random.Random(8)
    rows = list({(rng.randrange(40), rng.randrange(40)): None for _ in range(110)})
    arcs = _arcs(spark, [(a, b, float(rng.randint(1, 9))) for a, b in rows])
    seeds = spark.createDataFrame([(rng.randrange(40), float(rng.randint(0, 3)), i) for i in range(4)], "node long, cost double, source long")
    a, b = (sorted(map(tuple, graph.nearest_source(arcs, seeds, cutoff=15.0, arcs_in_task=n).collect())) for n in (0, 10_000))
    assert a == b and len(a) > 20


def test_segments_arcs_and_components(spark):
    node = lambda i, x, y: (i, x, y)
    ways = spark.createDataFrame(
        [(1, [node(1, 0.0, 0.0), node(2, 3.0, 4.0), node(2, 3.0, 4.0), node(3, 3.0, 10.0)], True, False), (2, [node(1, 0.0, 0.0), node(2, 3.0, 4.0)], True, True), (3, [node(9, 0.0, 0.0)], True, True), (4, None, True, True)],
        "way_id long, nodes array<struct<id:long,x:double,y:double>>, forward boolean, backward boolean",
    )
    seg = graph.way_segments(ways)
    assert sorted((r.way_id, r.u, r.v, r.length_m) for r in seg.collect()) == [(1, 1, 2, 5.0), (1, 2, 3, 6.0), (2, 1, 2, 5.0)]
    assert sorted(map(tuple, graph.arcs(seg).collect())) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 6.0)]
    rng = random.Random(1)
    chain = list(range(50))
    rng.shuffle(chain)
    edges = [(a, b, 1.0) for a, b in zip(chain, chain[1:])] + [(100, 101, 1.0), (200, 200, 1.0)]
    comp = {r.node: r.component for r in graph.weak_components(_arcs(spark, edges)).collect()}
    assert comp == {**{i: 0 for i in range(50)}, 100: 100, 101: 100, 200: 200}
    ranked = graph.ranked_components(graph.weak_components(_arcs(spark, edges))).orderBy("component_id").collect()
    assert [(r.component, r.size) for r in ranked] == [(0, 50), (100, 2), (200, 1)]


@pytest.mark.parametrize(
    ("tags", "want"),
    [
        # no class, a class out of the lists, forbidden classes, areas
        ({}, (False, False)), ({"foot": "yes"}, (False, False)), ({"highway": ""}, (False, False)), ({"highway": "elevator", "foot": "yes"}, (False, False)),
        ({"highway": "escape", "foot": "official"}, (False, False)), ({"highway": "platform", "area": "yes"}, (False, False)), ({"highway": "platform", "area": "no"}, (True, True)),
        # denied to walkers, denied to everybody, and what outweighs that
        ({"highway": "track", "foot": "restricted"}, (False, False)), ({"highway": "track", "access": "restricted"}, (True, True)), ({"highway": "track", "access": "no"}, (False, False)),
        ({"highway": "track", "access": "no", "foot": "official"}, (True, True)), ({"highway": "track", "access": "no", "foot": "customers"}, (False, False)),
        # classes that need a permission
        ({"highway": "busway"}, (False, False)), ({"highway": "busway", "foot": "permissive"}, (True, True)), ({"highway": "bridleway", "foot": "customers"}, (False, False)),
        # single directions
        ({"highway": "path", "foot:forward": "private"}, (False, True)), ({"highway": "path", "foot:backward": "no"}, (True, False)), ({"highway": "path", "foot:backward": "yes"}, (True, True)),
        ({"highway": "path", "oneway:foot": "reverse"}, (False, True)), ({"highway": "path", "oneway:foot": "-1"}, (False, True)), ({"highway": "path", "oneway:foot": "true"}, (True, False)),
        ({"highway": "steps", "conveying": "forward"}, (True, False)), ({"highway": "steps", "conveying": "backward"}, (False, True)), ({"highway": "steps", "conveying": "reversible"}, (True, True)),
        ({"highway": "steps", "oneway:foot": "yes", "conveying": "backward"}, (True, False)), ({"highway": "steps", "oneway:foot": "reverse", "conveying": "forward"}, (True, False)),
        ({"highway": "tertiary", "oneway": "-1"}, (True, True)),
    ],
)
def test_walk_permission(spark, tags, want):
    forward, backward = graph.walking_directions({k: F.lit(v) for k, v in tags.items()})
    assert tuple(spark.range(1).select(forward, backward).first()) == want


def test_decay_status_and_partial_edges(spark):
    df = spark.createDataFrame([(10.0, None, 100.0), (None, None, 900.0)], "a double, b double, d double")
    out = df.select(F.round(graph.decay_index(["a", "b"]), 6), graph.route_status(F.col("a").isNotNull(), F.lit(True)), graph.partial_edge_reach(F.col("d"), F.lit(1000.0), 600.0)).collect()
    assert [tuple(r) for r in out] == [(0.367879, "reachable", 0.5), (0.0, "unreachable", 0.0)]
