"""Connected components by union-find inside cells of edges and an exchange of representatives between them.

Edges are spread over cells, each cell runs a local union-find and tells for each of its vertices the smallest vertex
it reaches there.  The exchange takes the smallest of a vertex' representatives as its parent and links the others to
it; those links are the edges of the next round.  A vertex that represents no other retires with its parent.  How
edges are spread is up to the caller; ``by_larger_end`` is the plain way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.plans.session import cut, ship

#: Edges a cell holds at most, about; edges for which a cell of its own pays.
EDGES_PER_CELL = 400_000
LEAST_IN_CELL = 1_000

#: Adds the columns of a cell to edges (a, b); also gets their number.
Spread = Callable[[DataFrame, int], tuple[DataFrame, list[str], int]]


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over edges of vertices 0..n-1: roots are linked to the smallest root met, paths are halved until flat."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return parent
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def local_forest(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex reached) for each vertex that isn't its own smallest."""
    codes, names = pd.factorize(pd.concat([a, b], ignore_index=True), sort=True)
    names = np.asarray(names)
    root = smallest_reached(codes[: len(a)], codes[len(a) :], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before any shuffle: each batch's edges become the forest they span."""
    for batch in batches:
        if len(batch):
            x, root = local_forest(batch["a"], batch["b"])
            yield pd.DataFrame({"a": root, "b": x})


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    x, root = local_forest(pdf["a"], pdf["b"])
    own = np.unique(root)  # a representative tells the exchange that it is one
    return pd.DataFrame({"x": np.concatenate([x, own]), "root": np.concatenate([root, own])})


def by_larger_end(edges: DataFrame, count: int) -> tuple[DataFrame, list[str], int]:
    """Cells by a hash of the larger end: as many as cores while they are worth it, more for more edges."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    cells = max(1, min(cores, count // LEAST_IN_CELL), -(-count // EDGES_PER_CELL))
    return edges.withColumn("cell", F.pmod(F.xxhash64("b"), F.lit(cells))), ["cell"], cells


def components(edges: DataFrame, spread: Spread = by_larger_end) -> DataFrame:
    """(vertex, component) for the edges (a, b) of any orderable key type: the smallest vertex of each component.

    Loops keep a vertex with itself; repeated edges change nothing; edges with a NULL end are left out.
    """
    ship(edges.sparkSession)
    kind = edges.schema["a"].dataType
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    forest = T.StructType([T.StructField("x", kind), T.StructField("root", kind)])
    given = edges.select("a", "b").where("a is not null and b is not null")
    loops = cut(given.where("a = b").select(F.col("a").alias("vertex")).distinct())
    open_ = cut(given.where("a <> b").mapInPandas(reduced, pair))
    count = open_.count()
    rounds: list[DataFrame] = []
    while count > 0:
        ordered = open_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        cells, keys, n = spread(ordered, count)
        # an explicit number of partitions: few bytes, much work
        reached = cells.repartition(n, *keys).groupBy(*keys).applyInPandas(_cell, forest)
        other = F.col("root") != F.col("x")
        exchanged = cut(
            reached.groupBy("x").agg(F.min("root").alias("parent"), F.collect_set(F.when(other, F.col("root"))).alias("roots"), F.max(~other).alias("stays")).where("size(roots) > 0")
        )
        rounds.append(exchanged.where("not stays").select("x", "parent"))
        links = F.array_union(F.array_remove("roots", F.col("parent")), F.when(F.col("stays"), F.array("x")).otherwise(F.array().cast(T.ArrayType(kind))))
        linked = exchanged.select(F.col("parent").alias("a"), F.explode(links).alias("b"))
        open_ = linked.mapInPandas(reduced, pair)
        count = exchanged.agg(F.sum(F.size("roots") - 1 + F.col("stays").cast("int"))).first()[0] or 0  # at least the edges left
    labels = None
    for parents in reversed(rounds):
        own = parents.select(F.col("x").alias("vertex"), F.col("parent").alias("component"))
        if labels is not None:
            last = labels.select(F.col("vertex").alias("component"), F.col("component").alias("final"))
            own = own.join(last, "component", "left").select("vertex", F.coalesce("final", "component").alias("component")).unionByName(labels)
            own = cut(own)
        labels = own
    if labels is None:
        return loops.select("vertex", F.col("vertex").alias("component"))
    # what represents a component never retired, so it has no label of its own yet
    roots = labels.select(F.col("component").alias("vertex")).union(loops.join(labels, "vertex", "left_anti")).distinct()
    return labels.unionByName(roots.select("vertex", F.col("vertex").alias("component")))
