"""Spatial joins on grids: within a distance, containing area, nearest neighbours, boundaries.

A distance condition alone would plan as a nested loop.  Here points are hashed to grid cells sized by the radius, the
smaller side is repeated into the neighbouring cells, and an equality join on the cell leaves the exact test as a
residual.  A cell may hold a third of all rows: keys with more than ``ROWS_PER_SALT`` rows on the larger side are
split by a hash, and their partners repeated once per part (``salted``).

Rows with a NULL or NaN coordinate are never near anything and lie in no area.  Distances are inclusive.  Repeated
points give repeated pairs.  Ties of nearest neighbours go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoskein.functions import geo
from geoskein.operators import blocks
from geoskein.plans.session import cut, ship

ROWS_PER_SALT = 200_000
#: Origins in one group of ``access``, and rows of a table that is made local.
ROWS_PER_BLOCK, FEW_ROWS = 20_000, 10_000


def salted(left: DataFrame, right: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a column ``_salt`` that splits the keys which are frequent on the left; join on keys and salt.

    The table of frequent keys has at most rows(left) / rows_per_salt rows, a bound that makes it safe to broadcast
    while that is small; it is left to the planner, which knows its size.
    """
    hot = left.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_salt).cast("int").alias("_parts")).where("_parts > 1")
    hot = cut(hot)
    if hot.isEmpty():
        zero = F.lit(0)
        return left.withColumn("_salt", zero), right.withColumn("_salt", zero), [*keys, "_salt"]
    parts = F.coalesce("_parts", F.lit(1))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns if left.schema[c].dataType.typeName() not in ("map", "variant")])
    left_salted = left.join(hot, keys, "left").withColumn("_salt", F.pmod(row_hash, parts).cast("int")).drop("_parts")
    right_salted = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left_salted, right_salted, [*keys, "_salt"]


def _usable(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def _offsets(reach: int) -> Column:
    span = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i in span for j in span])


def within_distance(
    left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """All pairs at most ``radius`` apart with equal ``keys``; NULL keys are equal to nothing.

    ``left`` has (id, x, y, keys...), ``right`` (other_id, other_x, other_y, keys...); other columns of either side
    come along, those of the right whose name the left has as well as ``right_<name>``.  Result: all columns of both
    and ``distance``.
    """
    keys = keys or []
    right = right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c in left.columns and c not in keys})
    a = left.where(_usable("x", "y")).withColumn("_cx", geo.cell(F.col("x"), radius)).withColumn("_cy", geo.cell(F.col("y"), radius))
    b = right.where(_usable("other_x", "other_y")).withColumn("_o", F.explode(_offsets(1)))
    b = b.withColumn("_cx", geo.cell(F.col("other_x"), radius) + F.col("_o.dx")).withColumn("_cy", geo.cell(F.col("other_y"), radius) + F.col("_o.dy")).drop("_o")
    a, b, on = salted(a, b, [*keys, "_cx", "_cy"], rows_per_salt)
    squared = geo.squared_distance(F.col("x"), F.col("y"), F.col("other_x"), F.col("other_y"))
    pairs = a.join(b, on).where(squared <= radius * radius)
    return pairs.withColumn("distance", F.sqrt(squared)).drop("_cx", "_cy", "_salt")


def areas_on_grid(areas: DataFrame, size: float) -> DataFrame:
    """(area_id, _cx, _cy, _edges): each area once per grid cell of its bounding box.

    ``_edges`` holds only the edges that a ray to the right from the cell can meet or that pass through it, so the test
    of a point costs the edges in its row of cells, not all of them.  ``areas`` has (area_id, rings).
    """
    edged = areas.select("area_id", geo.ring_edges(F.col("rings")).alias("edges")).where("size(edges) > 0")
    low = lambda c: F.array_min(F.transform("edges", lambda e: F.least(e[c + "1"], e[c + "2"])))
    high = lambda c: F.array_max(F.transform("edges", lambda e: F.greatest(e[c + "1"], e[c + "2"])))
    rows = edged.select("area_id", "edges", geo.cell(low("x"), size).alias("x0"), geo.cell(high("x"), size).alias("x1"), F.explode(F.sequence(geo.cell(low("y"), size), geo.cell(high("y"), size))).alias("_cy"))
    top, bottom = (F.col("_cy") + 1) * size, F.col("_cy") * size
    rows = rows.withColumn("edges", F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= bottom) & (F.least(e["y1"], e["y2"]) <= top)))
    cells = rows.withColumn("_cx", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")
    left = F.col("_cx") * size
    return cells.withColumn("_edges", F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left)).drop("edges").where("size(_edges) > 0")


def containing_area(points: DataFrame, areas: DataFrame, size: float = 500.0, boundary: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Points (x, y, ...) with each area (area_id, rings) they lie in an odd number of rings of.

    A column ``area_id`` of the points gives way to the area's.  ``boundary``: points on an edge count as covered.  Otherwise an edge belongs to the area above or right of it.
    """
    a = points.drop("area_id").where(_usable("x", "y")).withColumn("_cx", geo.cell(F.col("x"), size)).withColumn("_cy", geo.cell(F.col("y"), size))
    a, b, on = salted(a, areas_on_grid(areas, size), ["_cx", "_cy"], rows_per_salt)
    x, y, edges = F.col("x"), F.col("y"), F.col("_edges")
    inside = geo.odd_crossings(x, y, edges)
    if boundary:
        inside = inside | F.exists(edges, lambda e: geo.on_edge(x, y, e))
    return a.join(b, on).where(inside).drop("_cx", "_cy", "_salt", "_edges")


def area_edges(areas: DataFrame) -> DataFrame:
    """(area_id, x1, y1, x2, y2): the boundary of each area as segments."""
    return areas.select("area_id", F.explode(geo.ring_edges(F.col("rings"))).alias("e")).select("area_id", "e.x1", "e.y1", "e.x2", "e.y2")


def boundary_within(points: DataFrame, areas: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys..., area_id, distance) of the points whose distance from an area's boundary is at most ``radius``.

    Edges are hashed to every cell that their bounding box, widened by the radius, touches.
    """
    size = max(radius, 1.0) * 2
    edges = area_edges(areas)
    span = lambda a, b: F.sequence(geo.cell(F.least(a, b) - radius, size), geo.cell(F.greatest(a, b) + radius, size))
    b = edges.withColumn("_cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("_cy", F.explode(span(F.col("y1"), F.col("y2"))))
    a = points.where(_usable("x", "y")).withColumn("_cx", geo.cell(F.col("x"), size)).withColumn("_cy", geo.cell(F.col("y"), size))
    a, b, on = salted(a, b, ["_cx", "_cy"])
    distance = geo.segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    near = a.join(b, on).withColumn("distance", distance).where(F.col("distance") <= radius)
    return near.groupBy(*keys, "area_id").agg(F.min("distance").alias("distance"))


def k_nearest(left: DataFrame, right: DataFrame, k: int, size: float, exclude_same_id: bool = False, keys: list[str] | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(id, keys..., other_id, distance, rank): the k nearest of ``right`` (other_id, other_x, other_y) for each of ``left`` (id, x, y).

    With cells of width w all neighbours within w lie in the 3 x 3 cells around a point, so a row is settled once its
    kth distance is at most w, or w reaches over all points of its group.  Rows left open try the next width: four
    times ``size``, then twice the last one, or the least distance of an open row from the extent of its group.  First the right side is repeated into neighbouring cells, later the rows
    left, which are few by then; frequent cells are split by a hash.  Candidates are cut to k in each task before the
    shuffle: by the aggregate for k = 1, else by the planner's limit per window group.
    """
    keys = keys or []
    by = ["id", *keys]
    other = cut(right.where(_usable("other_x", "other_y")).select("other_id", "other_x", "other_y", *keys))
    open_ = left.where(_usable("x", "y")).select("id", "x", "y", *keys)
    ends = [F.min("other_x").alias("_x0"), F.max("other_x").alias("_x1"), F.min("other_y").alias("_y0"), F.max("other_y").alias("_y1")]
    extent = other.groupBy(*keys).agg(*ends)
    if keys:
        open_ = open_.join(extent, keys)
    else:
        row = extent.first()
        if row["_x0"] is None:
            return left.select("id", F.lit(None).cast(other.schema["other_id"].dataType).alias("other_id"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank")).limit(0)
        open_ = open_.withColumns({c: F.lit(float(row[c])) for c in ("_x0", "_x1", "_y0", "_y1")})
    across = F.greatest(F.abs(F.col("x") - F.col("_x0")), F.abs(F.col("x") - F.col("_x1")))
    along = F.greatest(F.abs(F.col("y") - F.col("_y0")), F.abs(F.col("y") - F.col("_y1")))
    outside = F.greatest(F.col("_x0") - F.col("x"), F.col("x") - F.col("_x1"), F.col("_y0") - F.col("y"), F.col("y") - F.col("_y1"), F.lit(0.0))
    open_ = open_.select("id", "x", "y", *keys, F.greatest(across, along).alias("_bound"), outside.alias("_least"))

    def near(rows: DataFrame, width: float, repeat_right: bool) -> DataFrame:
        """(by, _bound, near): up to k neighbours of each row found in the 3 x 3 cells of ``width`` around it."""
        cells = lambda df, x, y: df.withColumn("_cx", geo.cell(F.col(x), width)).withColumn("_cy", geo.cell(F.col(y), width))
        spread = lambda df: df.withColumn("_o", F.explode(_offsets(1))).withColumn("_cx", F.col("_cx") + F.col("_o.dx")).withColumn("_cy", F.col("_cy") + F.col("_o.dy")).drop("_o")
        a, b = cells(rows, "x", "y"), cells(other, "other_x", "other_y")
        if repeat_right:
            a, b, on = salted(a, spread(b), [*keys, "_cx", "_cy"], rows_per_salt)
        else:
            b, a, on = salted(b, spread(a), [*keys, "_cx", "_cy"], rows_per_salt)
        pairs = a.join(b, on)
        if exclude_same_id:
            pairs = pairs.where("id <> other_id")
        pairs = pairs.select(*by, "other_id", "_bound", F.sqrt(geo.squared_distance(F.col("x"), F.col("y"), F.col("other_x"), F.col("other_y"))).alias("distance"))
        if k == 1:
            least = pairs.groupBy(*by, "_bound").agg(F.min(F.struct("distance", "other_id")).alias("m"))
            return least.select(*by, "_bound", F.array(F.struct(F.lit(1).alias("rank"), F.col("m.other_id").alias("other_id"), F.col("m.distance").alias("distance"))).alias("near"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("distance", "other_id"))).where(F.col("rank") <= k)
        return ranked.groupBy(*by, "_bound").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "distance"))).alias("near"))

    found = []
    width, tries = float(size), 0
    while True:
        tried = near(open_, width, tries < 2)
        settled = cut(tried.where(((F.size("near") >= k) & (F.element_at("near", -1)["distance"] <= width)) | (F.col("_bound") <= width)).select(*by, "near"))
        found.append(settled)
        # what lies in reach of all points of its group is settled, also where it has no neighbour
        open_ = cut(open_.where(F.col("_bound") > width).join(settled.select(*by), by, "left_anti"))
        # nothing lies nearer than the extent of a row's group: the widths below that are passed over
        least = open_.agg(F.min("_least")).first()[0]
        if least is None:
            break
        width, tries = max(width * (4.0 if not tries else 2.0), least), tries + 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(*by, F.explode("near").alias("n")).select(*by, "n.other_id", "n.distance", F.col("n.rank").cast("long").alias("rank"))


def polygon_area(areas: DataFrame) -> DataFrame:
    """(area_id, area): shoelace sum over parts less holes, taken from the direction-free even-odd nesting of two levels.

    Rings that lie inside another ring of the area count as holes.
    """
    ring = areas.select("area_id", F.posexplode("rings").alias("ring_no", "ring"))
    ring = ring.withColumn("e", geo.ring_edges(F.array("ring")))
    signed = F.aggregate("e", F.lit(0.0), lambda acc, s: acc + s["x1"] * s["y2"] - s["x2"] * s["y1"])
    sized = ring.select("area_id", "ring_no", "ring", "e", (F.abs(signed) / 2).alias("size"))
    outer = sized.select("area_id", F.col("ring_no").alias("outer_no"), F.col("e").alias("outer_e"), F.col("size").alias("outer_size"))
    probe = F.element_at("ring", 1)
    held = sized.join(outer, "area_id").where("ring_no <> outer_no and outer_size > size").where(geo.odd_crossings(probe["x"], probe["y"], F.col("outer_e")))
    depth = held.groupBy("area_id", "ring_no").agg(F.count("*").alias("depth"))
    joined = sized.join(depth, ["area_id", "ring_no"], "left")
    sign = F.when(F.coalesce("depth", F.lit(0)) % 2 == 1, -1.0).otherwise(1.0)
    return joined.groupBy("area_id").agg(F.sum(sign * F.col("size")).alias("area"))


def area_assignment(points: DataFrame, areas: DataFrame, key: str = "id") -> DataFrame:
    """(key, matches, area_id): how many areas cover each point, and the one if it is unique; uncovered points stay with 0."""
    held = containing_area(points.select(key, "x", "y"), areas, boundary=True)
    per = held.groupBy(key).agg(F.count("*").alias("matches"), F.min("area_id").alias("_one"))
    out = points.select(key).join(per, key, "left")
    return out.select(key, F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("_one")).alias("area_id"))


def exterior_edges(areas: DataFrame) -> DataFrame:
    """Edges of the union's boundary: those that no other area shares in either direction (exact for edge-matched areas)."""
    e = area_edges(areas)
    a_first = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = [F.when(a_first, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("x1", "x2", "ax"), ("y1", "y2", "ay"), ("x2", "x1", "bx"), ("y2", "y1", "by"))]
    undirected = e.select("area_id", *ends)
    return undirected.groupBy("ax", "ay", "bx", "by").agg(F.count("*").alias("_n"), F.min("area_id").alias("area_id")).where("_n = 1").drop("_n")


def ring_problems(areas: DataFrame) -> DataFrame:
    """(area_id, ring_no, problem) of rings that are short, open or hold a coordinate that is no finite number."""
    r = areas.select("area_id", F.posexplode("rings").alias("ring_no", "ring"))
    finite = F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e12) & (F.abs(p["y"]) < 1e12))
    problem = (
        F.when(F.size("ring") < 4, "short")
        .when(~finite, "not_finite")
        .when(F.element_at("ring", 1) != F.element_at("ring", -1), "open")
    )
    return r.select("area_id", F.col("ring_no").cast("long").alias("ring_no"), problem.alias("problem")).where("problem is not null")


def count_within(origins: DataFrame, destinations: DataFrame, radii: list[int], categories: list[str], keys: list[str] | None = None) -> DataFrame:
    """Origins (id, x, y, keys...) with within_<radius>_<category> counts of destinations (other_id, other_x, other_y, category, keys...).

    Origins without a usable point keep NULL, those without a destination 0.
    """
    return access(origins, destinations, radii, categories, keys)


def _few(df: DataFrame) -> DataFrame:
    """The same rows, as a local table while they are few, whose size the planner knows."""
    rows = df.limit(FEW_ROWS + 1).collect()
    return df if len(rows) > FEW_ROWS else df.sparkSession.createDataFrame(rows, df.schema)


def access(
    origins: DataFrame, destinations: DataFrame, radii: list[int], categories: list[str], keys: list[str] | None = None, nearest: float = 0.0, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Origins (x, y, keys...) with counts of destinations within radii by category and, if ``nearest``, (other_id, distance) of the nearest.

    Pairs are not listed.  Origins lie in blocks as wide as the widest radius (``nearest``, where that is wider), which meet
    the destinations of 3 x 3 blocks in one group and are counted on arrays (``blocks``); crowded blocks are split by a
    hash.  ``nearest`` bounds no distance: origins without a destination in 3 x 3 cells of a quarter of a block are few,
    and their nearest is found beforehand by way of occupied cells (``_far``) and joins their group.
    """
    ship(origins.sparkSession)
    keys, radii_m = keys or [], [float(r) for r in radii]
    reach = max([*radii_m, float(nearest)])
    fine = reach / 4
    dest = destinations.where(_usable("other_x", "other_y")).select(
        destinations["other_id"] if nearest else F.lit(0).alias("other_id"), "other_x", "other_y", F.col("category") if categories else F.lit(None).cast("string").alias("category"), *keys, F.lit(None).cast("double").alias("_far")
    )
    for c in keys:
        dest = dest.where(F.col(c).isNotNull())
    if not nearest:
        dest = dest.where(F.col("category").isin(categories))
    usable = _usable("x", "y")
    a = origins.withColumn("_wx", F.when(usable, geo.cell(F.col("x"), fine))).withColumn("_wy", F.when(usable, geo.cell(F.col("y"), fine)))
    occupied = cut(a.groupBy(*keys, "_wx", "_wy").agg(F.count("*").alias("_n")))  # rows: cells, not origins
    block = [F.coalesce(F.floor(F.col(c) / 4).cast("long"), F.lit(0)).alias(n) for c, n in (("_wx", "_cx"), ("_wy", "_cy"))]
    hot = occupied.select(*keys, *block, "_n").groupBy(*keys, "_cx", "_cy").agg(F.ceil(F.sum("_n") / rows_per_block).cast("int").alias("_parts")).where("_parts > 1")
    hot = _few(hot)

    def blocked(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.withColumn("_cx", geo.cell(F.col(x), reach)).withColumn("_cy", geo.cell(F.col(y), reach))

    b = blocked(dest, "other_x", "other_y").withColumn("_o", F.explode(_offsets(1))).withColumns({"_cx": F.col("_cx") + F.col("_o.dx"), "_cy": F.col("_cy") + F.col("_o.dy")}).drop("_o")
    if nearest:
        far = _far(a, occupied, dest, keys, fine)
        if far is not None:
            b = b.unionByName(blocked(far, "other_x", "other_y").withColumn("category", F.lit(None).cast("string")))
    on = [*keys, "_cx", "_cy"]
    parts = F.coalesce("_parts", F.lit(1))
    spread = F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), parts).cast("int")
    a = a.select("*", *block).drop("_wx", "_wy").join(hot, on, "left").withColumn("_salt", spread).drop("_parts")
    b = b.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")

    names = [f"within_{r}_{c}" for r in radii for c in categories]
    added = [T.StructField(n, T.LongType()) for n in names]
    if nearest:
        added += [T.StructField("other_id", destinations.schema["other_id"].dataType), T.StructField("distance", T.DoubleType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in origins.schema), *added])
    types = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return pa.table({f.name: pa.array([], f.type) for f in types}, schema=types)
        px, py = (left[c].cast(pa.float64()).to_numpy(zero_copy_only=False) if left[c].null_count < n else np.full(n, np.nan) for c in ("x", "y"))
        good = np.flatnonzero(~(np.isnan(px) | np.isnan(py)))
        px, py = px[good], py[good]
        if nearest and right.num_rows:
            right = right.take(pc.sort_indices(right["other_id"]))
        qx, qy, far = (right[c].to_numpy(zero_copy_only=False).astype(float) if right.num_rows else np.empty(0) for c in ("other_x", "other_y", "_far"))
        here = np.isnan(far)
        out = {}
        for c in categories:
            of = here & pc.fill_null(pc.equal(right["category"], c), False).to_numpy(zero_copy_only=False) if right.num_rows else here
            counted = blocks.counts(px, py, qx[of], qy[of], radii_m)
            for j, r in enumerate(radii):
                whole = np.zeros(n, np.int64)
                whole[good] = counted[:, j]
                out[f"within_{r}_{c}"] = pa.array(whole, pa.int64(), mask=_not_in(good, n))
        if nearest:
            rows = np.flatnonzero(here)
            at, distance = blocks.nearest(px, py, qx[rows], qy[rows], reach)
            at = np.where(at >= 0, rows[at] if len(rows) else -1, -1)
            known = {(qx[i], qy[i]): i for i in np.flatnonzero(~here)}
            for i in np.flatnonzero(at < 0) if known else ():
                at[i] = known.get((px[i], py[i]), -1)
                distance[i] = far[at[i]] if at[i] >= 0 else np.nan
            has = at >= 0
            index, metres = np.zeros(n, np.int64), np.zeros(n)
            index[good[has]], metres[good[has]] = at[has], distance[has]
            none = _not_in(good[has], n)
            out["other_id"] = right["other_id"].take(pa.array(index, mask=none)) if right.num_rows else pa.nulls(n, types.field("other_id").type)
            out["distance"] = pa.array(metres, mask=none)
        return pa.table({c: out[c] if c in out else left[c] for c in types.names}).cast(types)

    group = [*on, "_salt"]
    return a.groupBy(*group).cogroup(b.groupBy(*group)).applyInArrow(run, schema)


def _not_in(rows: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    out[rows] = False
    return out


def _far(points: DataFrame, occupied: DataFrame, dest: DataFrame, keys: list[str], size: float) -> DataFrame | None:
    """(other_id, other_x, other_y, keys..., _far): of the distinct points (x, y, _wx, _wy) without a destination in the 3 x 3
    cells around them the nearest destination and its distance, beside the point itself; None if there are no such points.

    A cell is passed over if its box begins farther away than the box of another cell ends.
    """
    d = dest.withColumn("_wx", geo.cell(F.col("other_x"), size)).withColumn("_wy", geo.cell(F.col("other_y"), size))
    on = [*keys, "_wx", "_wy"]
    ends = [f(c).alias(n) for c, low, high in (("other_x", "_x0", "_x1"), ("other_y", "_y0", "_y1")) for f, n in ((F.min, low), (F.max, high))]
    cells = cut(d.groupBy(*on).agg(*ends))
    around = cells.select(*keys, "_wx", "_wy").withColumn("_o", F.explode(_offsets(1))).select(*keys, (F.col("_wx") + F.col("_o.dx")).alias("_wx"), (F.col("_wy") + F.col("_o.dy")).alias("_wy")).distinct()
    lone = _few(occupied.where("_wx is not null").select(*on).join(around, on, "left_anti"))
    rows = cut(points.select("x", "y", *on).join(lone, on, "left_semi").select("x", "y", *keys).distinct())
    if rows.isEmpty():
        return None
    with_boxes = lambda df: df.join(cells, keys) if keys else df.crossJoin(cells)
    gap = lambda c, low, high: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))
    wide = lambda c, low, high: F.greatest(F.abs(F.col(c) - F.col(low)), F.abs(F.col(c) - F.col(high)))
    bound = cut(with_boxes(rows).groupBy("x", "y", *keys).agg(F.min(F.hypot(wide("x", "_x0", "_x1"), wide("y", "_y0", "_y1"))).alias("_bound")))
    near = F.hypot(gap("x", "_x0", "_x1"), gap("y", "_y0", "_y1")) * (1 - 1e-9) <= F.col("_bound") * (1 + 1e-9)
    tried = with_boxes(bound).where(near).select("x", "y", *on)
    pairs = tried.join(d.select("other_id", "other_x", "other_y", *on), on)
    distance = F.sqrt(geo.squared_distance(F.col("x"), F.col("y"), F.col("other_x"), F.col("other_y")))
    least = pairs.groupBy("x", "y", *keys).agg(F.min(F.struct(distance.alias("distance"), "other_id")).alias("m"))
    return cut(least.select("m.other_id", F.col("x").alias("other_x"), F.col("y").alias("other_y"), *keys, F.col("m.distance").alias("_far")))


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Corners of the convex hull of (x, y), counter-clockwise: each partition sends the corners of its own hull only."""

    def corners(pts: np.ndarray) -> np.ndarray:
        pts = np.unique(pts, axis=0)
        if len(pts) < 3:
            return pts

        def half(seq: np.ndarray) -> list:
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        low, high = half(pts), half(pts[::-1])
        return np.array(low[:-1] + high[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 2))
        for batch in batches:
            held = corners(np.concatenate([held, batch[["x", "y"]].to_numpy(float)]))
        if len(held):
            yield pd.DataFrame(held, columns=["x", "y"])

    ship(points.sparkSession)
    local = points.where(_usable("x", "y")).select("x", "y").mapInPandas(run, "x double, y double")
    merged = local.coalesce(1).mapInPandas(run, "x double, y double").collect()  # corners of corners
    return [(r.x, r.y) for r in merged]


def clipped_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to an axis-aligned rectangle, edge after edge."""
    for axis, bound, keep_above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        if not len(ring):
            break
        inside = ring[:, axis] >= bound if keep_above else ring[:, axis] <= bound
        out = []
        for i in range(len(ring)):
            a, b = ring[i - 1], ring[i]
            if inside[i] != inside[i - 1]:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(a + t * (b - a))
            if inside[i]:
                out.append(b)
        ring = np.array(out)
    return ring


def clipped_cells(areas: DataFrame, size: float) -> DataFrame:
    """(area_id, cx, cy, area): the area of each grid cell that lies in the area (area_id, rings); empty cells are left out.

    Rings inside another ring are taken off.  One row of cells of one ring is cut at a time.
    """
    ship(areas.sparkSession)
    ring = areas.select("area_id", F.posexplode("rings").alias("ring_no", "ring"))
    ring = ring.withColumn("e", geo.ring_edges(F.array("ring")))
    other = ring.select("area_id", F.col("ring_no").alias("other_no"), F.col("e").alias("other_e"))
    probe = F.element_at("ring", 1)
    inside = geo.odd_crossings(probe["x"], probe["y"], F.col("other_e"))
    depth = ring.join(other, "area_id").where("ring_no <> other_no").where(inside).groupBy("area_id", "ring_no").agg(F.count("*").alias("depth"))
    ys = F.transform("ring", lambda p: p["y"])
    rows = ring.join(depth, ["area_id", "ring_no"], "left").select(
        "area_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.transform("ring", lambda p: p["x"]).alias("xs"), ys.alias("ys"),
        F.explode(F.sequence(geo.cell(F.array_min(ys), size), geo.cell(F.array_max(ys), size))).alias("cy"),
    )

    def shoelace(r: np.ndarray) -> float:
        return abs(float(np.dot(r[:, 0], np.roll(r[:, 1], 1)) - np.dot(r[:, 1], np.roll(r[:, 0], 1)))) / 2 if len(r) > 2 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                points = np.column_stack([row.xs, row.ys])
                if (points[0] == points[-1]).all():
                    points = points[:-1]
                strip = clipped_ring(points, -np.inf, row.cy * size, np.inf, (row.cy + 1) * size)
                if len(strip) < 3:
                    continue
                for cx in range(int(np.floor(strip[:, 0].min() / size)), int(np.floor(strip[:, 0].max() / size)) + 1):
                    part = shoelace(clipped_ring(strip, cx * size, -np.inf, (cx + 1) * size, np.inf))
                    if part > 0:
                        out.append((row.area_id, cx, row.cy, -part if row.depth % 2 else part))
            yield pd.DataFrame(out, columns=["area_id", "cx", "cy", "area"])

    parts = rows.mapInPandas(run, T.StructType([areas.schema["area_id"], *[T.StructField(c, T.LongType()) for c in ("cx", "cy")], T.StructField("area", T.DoubleType())]))
    return parts.groupBy("area_id", "cx", "cy").agg(F.sum("area").alias("area")).where("area > 0")


def point_on_surface(areas: DataFrame) -> DataFrame:
    """(area_id, x, y): the middle of the widest stretch inside the area on the horizontal line through the middle of its extent."""
    e = areas.select("area_id", geo.ring_edges(F.col("rings")).alias("edges"))
    low = F.array_min(F.transform("edges", lambda s: F.least(s["y1"], s["y2"])))
    high = F.array_max(F.transform("edges", lambda s: F.greatest(s["y1"], s["y2"])))
    lined = e.withColumn("y", (low + high) / 2)
    hit = F.filter("edges", lambda s: (s["y1"] > F.col("y")) != (s["y2"] > F.col("y")))
    xs = F.array_sort(F.transform(hit, lambda s: (s["x2"] - s["x1"]) * (F.col("y") - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    lined = lined.withColumn("xs", xs).where("size(xs) >= 2")
    spans = F.transform(F.sequence(F.lit(1), (F.size("xs") / 2).cast("int")), lambda i: F.struct((F.element_at("xs", 2 * i) - F.element_at("xs", 2 * i - 1)).alias("w"), ((F.element_at("xs", 2 * i) + F.element_at("xs", 2 * i - 1)) / 2).alias("x")))
    return lined.select("area_id", F.array_max(spans)["x"].alias("x"), "y")
