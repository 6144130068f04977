import random

import pytest

from geoskein.llm.components import connected_components


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in parent}


def _run(spark, edges, kind="long", **kw):
    df = spark.createDataFrame([(*e, 1, "c") for e in edges], f"a {kind}, b {kind}, x int, component string")
    return {r.vertex: r.component for r in connected_components(df, **kw).collect()}


@pytest.mark.parametrize("cell", [5, 40, 10_000])
def test_random_graphs_chains_and_stars(spark, cell):
    rng = random.Random(cell)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(1000 + i, 1001 + i) for i in rng.sample(range(60), 60)]  # a chain, in random order
    edges += [(5000, 5001 + i) for i in range(80)]  # a hub
    edges += edges[:20] + [(7, 7), (900, 900)]
    assert _run(spark, edges, edges_per_cell=cell) == _brute(edges)


def test_strings_nulls_and_empty(spark):
    assert _run(spark, [("b", "a"), ("c", "b"), (None, "a"), ("æ", "z")], "string") == {"a": "a", "b": "a", "c": "a", "z": "z", "æ": "z"}
    assert _run(spark, []) == {}
    assert _run(spark, [(3, 3)]) == {3: 3}


@pytest.mark.parametrize("least", [1, 50])
def test_grids_of_many_cells_and_of_one_agree(spark, least):
    rng = random.Random(6)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(2000, 2001 + i) for i in range(300)]
    assert _run(spark, edges, least_in_cell=least) == _brute(edges) == _run(spark, edges, least_in_cell=10**9)
