"""Pairwise matches consolidated into groups: connected components on a two-dimensional grid of edge blocks.

Vertices are hashed into B blocks; the edge (a, b) belongs to the cell (block of a, block of b).  Every cell runs a
local union-find and hands back, for each of its vertices, the smallest vertex it reaches there.  The exchange takes,
for every vertex, the smallest of the representatives from its row and its column of cells as parent, and links the
others to it: those links are the edges of the next round.  A vertex that represents no other retires with its parent
(the largest vertex always does, in practice most do); one that represents others stays, linked to its parent.  So
the edges shrink until none is left; then the parents are followed from the last round to the first.

Scale: there are as many cells as cores, as long as each gets ``LEAST_IN_CELL`` edges, and more where a cell would
hold above ``edges_per_cell``; a cell that still is larger (a hub's row) is cut into parts by a hash of its edges, as
union-find may run on any subset.  What a vertex receives in the exchange is bounded by the cells of its row and
column.  A round is two shuffles and one checkpoint in the shared folder.  Nothing but row counts comes to the driver.

Defined results: every vertex of an edge gets the smallest vertex of its component (byte order for strings); loops
keep a vertex with itself; repeated edges change nothing; edges with a NULL end are left out; no edges, no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.operators.components import EDGES_PER_CELL, LEAST_IN_CELL, components


def on_grid(edges_per_cell: int, least_in_cell: int):
    """Spreads edges (a, b), the smaller end first, over the cells of the grid."""

    def spread(edges: DataFrame, count: int) -> tuple[DataFrame, list[str], int]:
        lanes = min(np.sqrt(edges.sparkSession.sparkContext.defaultParallelism), np.sqrt(count / least_in_cell))
        blocks = max(1, int(np.ceil(max(lanes, np.sqrt(count / edges_per_cell)))))
        block = lambda end: F.pmod(F.xxhash64(end), F.lit(blocks))
        cells = edges.withColumn("row", block("a")).withColumn("col", block("b"))
        if count <= edges_per_cell:  # so no cell is larger
            return cells.withColumn("part", F.lit(0).cast("long")), ["row", "col", "part"], blocks * blocks
        # at most blocks**2 sizes, a few hundred thousand for 10**11 edges
        sizes = cells.groupBy("row", "col").agg(F.ceil(F.count("*") / edges_per_cell).alias("parts"))
        cells = cells.join(sizes, ["row", "col"]).withColumn("part", F.pmod(F.xxhash64("b", "a"), "parts")).drop("parts")
        return cells, ["row", "col", "part"], blocks * blocks

    return spread


def connected_components(edges: DataFrame, edges_per_cell: int = EDGES_PER_CELL, least_in_cell: int = LEAST_IN_CELL) -> DataFrame:
    """(vertex, component) for the edges (a, b) of any orderable key type."""
    return components(edges, on_grid(edges_per_cell, least_in_cell))
