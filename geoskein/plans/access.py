"""Spatial queries: access to destinations, areas, borders, neighbours, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.functions import geo
from geoskein.operators import spatial
from geoskein.plans.places import POINTS_SQL, _listing_points
from geoskein.plans.session import cut, once, table

RADII = [800, 1200, 1600]
CATEGORIES = ["food_social", "cultural_tourist"]
BORDER_METRES = 100.0
CELL = 500


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "official_areas").select(F.col("official_cv_area_id").alias("area_id"), F.col("rings_25832").alias("rings"))


def _destinations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_pois").select("snapshot_date", F.col("destination_key").alias("other_id"), "category", F.col("geom_25832.x").alias("other_x"), F.col("geom_25832.y").alias("other_y"))


def euclid_access(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: per record the destinations within three radii by category, and the nearest destination."""
    out = spatial.access(once(_listing_points(spark, d), "x", "y"), _destinations(spark, d), RADII, CATEGORIES, ["snapshot_date"], nearest=400.0)
    counts = [f"within_{r}_{c}" for r in RADII for c in CATEGORIES]
    return out.select("id", "snapshot_date", *counts, F.col("other_id").alias("nearest_key"), F.round("distance", 3).alias("nearest_m"))


EUCLID_ACCESS = f"""
with {POINTS_SQL},
pairs as (select p.source_row_number as id, p.snapshot_date, o.destination_key, o.category, sqrt((p.x - o.geom_25832.x) ** 2 + (p.y - o.geom_25832.y) ** 2) as dist
          from pts p join osm_pois o on p.snapshot_date = o.snapshot_date and o.geom_25832 is not null),
agg as (select id, {", ".join(f"count(*) filter (dist <= {r} and category = '{c}') as within_{r}_{c}" for r in RADII for c in CATEGORIES)},
        arg_min(destination_key, (dist, destination_key)) as nearest_key, round(min(dist), 3) as nearest_m from pairs group by id)
select source_row_number as id, snapshot_date, {", ".join(f"coalesce(within_{r}_{c}, 0) as within_{r}_{c}" for r in RADII for c in CATEGORIES)}, nearest_key, nearest_m
from pts left join agg on source_row_number = id
"""
EUCLID_ACCESS = EUCLID_ACCESS.replace("arg_min(destination_key, (dist, destination_key))", "min_by(destination_key, (dist, destination_key))")


def knn_8(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest other destinations of each destination."""
    dest = _destinations(spark, d).drop("category")
    left = dest.select(F.col("other_id").alias("id"), F.col("other_x").alias("x"), F.col("other_y").alias("y"), "snapshot_date")
    near = spatial.k_nearest(left, dest, 8, 500.0, exclude_same_id=True, keys=["snapshot_date"])
    return near.select("id", "other_id", "rank", F.round("distance", 3).alias("distance"))


KNN_8 = """
with p as (select destination_key as id, snapshot_date, geom_25832.x as x, geom_25832.y as y from osm_pois where geom_25832 is not null),
d as (select a.id, b.id as other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist from p a join p b on a.snapshot_date = b.snapshot_date and a.id <> b.id)
select id, other_id, rank, round(dist, 3) as distance from (select *, row_number() over (partition by id order by dist, other_id) as rank from d) where rank <= 8
"""


def within_3m(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of destinations of one snapshot at most 3 m apart."""
    dest = _destinations(spark, d).drop("category")
    left = dest.select(F.col("other_id").alias("id"), F.col("other_x").alias("x"), F.col("other_y").alias("y"), "snapshot_date")
    return spatial.within_distance(left, dest, 3.0, ["snapshot_date"]).where("id < other_id").select("id", "other_id", F.round("distance", 3).alias("distance"))


WITHIN_3M = """
with p as (select destination_key as id, snapshot_date, geom_25832.x as x, geom_25832.y as y from osm_pois where geom_25832 is not null)
select a.id, b.id as other_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3) as distance
from p a join p b on a.snapshot_date = b.snapshot_date and a.id < b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9
"""

_EDGES_SQL = """
    edges as (
        select official_cv_area_id as area_id, ring[i].x as x1, ring[i].y as y1, ring[i + 1].x as x2, ring[i + 1].y as y2
        from (select official_cv_area_id, ring, unnest(range(1, len(ring))) as i
              from (select official_cv_area_id, unnest(rings_25832) as ring from official_areas)))"""
_SEGMENT_SQL = """sqrt((p.x - (x1 + greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (x2 - x1))) ** 2
      + (p.y - (y1 + greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (y2 - y1))) ** 2)"""
_COVER_SQL = """
    cover as (
        select p.source_row_number, e.area_id from pts p join edges e on (e.y1 > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
        group by all having count(*) % 2 = 1)"""


def pip_assignment(spark: SparkSession, d: str) -> DataFrame:
    """How many areas cover each record, the area where it is one, and the status."""
    out = spatial.area_assignment(cut(_listing_points(spark, d)), _areas(spark, d))
    status = F.when(F.col("matches") == 1, "unique").when(F.col("matches") == 0, "outside_or_gap").otherwise("multiple_areas")
    return out.select(F.col("id").alias("source_row_number"), "matches", "area_id", status.alias("status"))


PIP_ASSIGNMENT = f"""
with {POINTS_SQL}, {_EDGES_SQL}, {_COVER_SQL}
select p.source_row_number, count(c.area_id) as matches, case when count(c.area_id) = 1 then min(c.area_id) end as area_id,
       case count(c.area_id) when 1 then 'unique' when 0 then 'outside_or_gap' else 'multiple_areas' end as status
from pts p left join cover c using (source_row_number) group by 1
"""


def near_border(spark: SparkSession, d: str) -> DataFrame:
    """Records within 100 m of an area's boundary, with the distance."""
    near = spatial.boundary_within(cut(_listing_points(spark, d)), _areas(spark, d), BORDER_METRES, ["id"])
    return near.select(F.col("id").alias("source_row_number"), "area_id", F.round("distance", 3).alias("distance"))


NEAR_BORDER = f"""
with {POINTS_SQL}, {_EDGES_SQL}
select source_row_number, area_id, round(min(dist), 3) as distance
from (select p.source_row_number, e.area_id, {_SEGMENT_SQL} as dist from pts p join edges e on true where x1 <> x2 or y1 <> y2) group by 1, 2 having min(dist) <= {BORDER_METRES}
"""


def buffer_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Records outside an area but within 500 or 1000 m of it: the sparse exclusion list of a buffered validation."""
    points = cut(_listing_points(spark, d))
    areas = _areas(spark, d)
    near = spatial.boundary_within(points, areas, 1000.0, ["id"])
    inside = spatial.containing_area(points, areas, boundary=True).select("id", "area_id")
    outside = near.join(inside, ["id", "area_id"], "left_anti")
    radii = F.explode(F.array(*[F.lit(r) for r in (500, 1000)]))
    return outside.select(F.col("id").alias("source_row_number"), "area_id", "distance", radii.alias("buffer_m")).where("distance <= buffer_m").drop("distance")


BUFFER_EXCLUSIONS = f"""
with {POINTS_SQL}, {_EDGES_SQL}, {_COVER_SQL},
near as (select source_row_number, area_id, min(dist) as distance from (select p.source_row_number, e.area_id, {_SEGMENT_SQL} as dist from pts p join edges e on true where x1 <> x2 or y1 <> y2) group by 1, 2)
select source_row_number, area_id, b.buffer_m from near n join (values (500), (1000)) as b(buffer_m) on distance <= b.buffer_m
where not exists (select 1 from cover c where c.source_row_number = n.source_row_number and c.area_id = n.area_id)
"""


def source_edge_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the circle of 800 m around each covered record stays in its area, and the distance to the edge."""
    points = cut(_listing_points(spark, d))
    areas = _areas(spark, d)
    inside = spatial.containing_area(points, areas).select("id", "area_id")
    edge = spatial.boundary_within(points, areas, 800.0, ["id"])
    out = inside.join(edge, ["id", "area_id"], "left")
    return out.groupBy("area_id").agg(F.count("*").alias("n"), F.count_if(F.col("distance").isNull() | (F.col("distance") >= 800)).alias("covered"), F.round(F.min("distance"), 3).alias("least_edge_m"))


SOURCE_EDGE_COVERAGE = f"""
with {POINTS_SQL}, {_EDGES_SQL}, {_COVER_SQL},
near as (select c.source_row_number, c.area_id, min(dist) as distance
         from cover c join (select p.source_row_number, e.area_id, {_SEGMENT_SQL} as dist from pts p join edges e on true where x1 <> x2 or y1 <> y2) using (source_row_number, area_id) group by 1, 2)
select area_id, count(*) as n, count(*) filter (distance >= 800) as covered, round(case when min(distance) <= 800 then min(distance) end, 3) as least_edge_m from near group by 1
"""


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return spatial.polygon_area(_areas(spark, d)).select("area_id", F.round("area", 2).alias("area_m2"))


POLYGON_AREA = """
with r as (select official_cv_area_id as area_id, ring, row_number() over () as ring_no from (select official_cv_area_id, unnest(rings_25832) as ring from official_areas)),
e as (select area_id, ring_no, ring[i].x as x1, ring[i].y as y1, ring[i + 1].x as x2, ring[i + 1].y as y2 from (select *, unnest(range(1, len(ring))) as i from r)),
s as (select area_id, ring_no, abs(sum(x1 * y2 - x2 * y1)) / 2 as size from e group by 1, 2),
h as (select r.area_id, r.ring_no, e.ring_no as other, count(*) % 2 as inside from r join e on r.area_id = e.area_id and r.ring_no <> e.ring_no
          and (e.y1 > r.ring[1].y) <> (e.y2 > r.ring[1].y) and r.ring[1].x < (e.x2 - e.x1) * (r.ring[1].y - e.y1) / (e.y2 - e.y1) + e.x1 group by 1, 2, 3)
select s.area_id, round(sum(size * case when (select coalesce(sum(inside), 0) from h where h.ring_no = s.ring_no) % 2 = 1 then -1 else 1 end), 2) as area_m2 from s group by 1
"""


def utm_forward(spark: SparkSession, d: str) -> DataFrame:
    return _listing_points(spark, d).select(F.col("id").alias("source_row_number"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


UTM_FORWARD = f"with {POINTS_SQL} select source_row_number, round(x, 3) as x, round(y, 3) as y from pts"


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Records and mean price by 500 m cell, cells of fewer than 5 held back."""
    points = _listing_points(spark, d).select("id", geo.cell(F.col("x"), CELL).alias("cx"), geo.cell(F.col("y"), CELL).alias("cy"))
    return points.groupBy("cx", "cy").agg(F.count("*").alias("n")).where("n >= 5")


GRID_CELLS = f"with {POINTS_SQL} select cast(floor(x / {CELL}) as bigint) as cx, cast(floor(y / {CELL}) as bigint) as cy, count(*) as n from pts group by 1, 2 having count(*) >= 5"


def extent(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the destinations per snapshot."""
    return _destinations(spark, d).groupBy("snapshot_date").agg(*[f("other_" + c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])


EXTENT = "select snapshot_date, min(geom_25832.x) as min_x, max(geom_25832.x) as max_x, min(geom_25832.y) as min_y, max(geom_25832.y) as max_y from osm_pois group by 1"


def union_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the union of all areas and their length, by the area they belong to."""
    e = spatial.exterior_edges(_areas(spark, d))
    length = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return e.groupBy("area_id").agg(F.count("*").alias("edges"), F.round(F.sum(length), 3).alias("length_m"))


UNION_BOUNDARY = f"""
with {_EDGES_SQL},
u as (select area_id, case when (x1, y1) < (x2, y2) then (x1, y1, x2, y2) else (x2, y2, x1, y1) end as k, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) as len from edges where x1 <> x2 or y1 <> y2),
o as (select k, min(area_id) as area_id, min(len) as len from u group by k having count(*) = 1)
select area_id, count(*) as edges, round(sum(len), 3) as length_m from o group by 1
"""


def ring_problems(spark: SparkSession, d: str) -> DataFrame:
    return spatial.ring_problems(_areas(spark, d))


RING_PROBLEMS = """
select official_cv_area_id as area_id, cast(0 as bigint) as ring_no, 'short' as problem from official_areas where len(list_filter(rings_25832, lambda r: len(r) < 4)) > 0
"""


def boundary_audit(spark: SparkSession, d: str) -> DataFrame:
    """Destinations outside of all areas by category, and records with such a destination within 800 m."""
    areas = _areas(spark, d)
    dest = cut(_destinations(spark, d).where("other_x is not null"))
    covered = spatial.containing_area(dest.select("other_id", F.col("other_x").alias("x"), F.col("other_y").alias("y")), areas).select("other_id").distinct()
    outside = cut(dest.join(covered, "other_id", "left_anti"))
    near = spatial.within_distance(cut(_listing_points(spark, d)), outside, 800.0, ["snapshot_date"])
    listings = near.groupBy("category").agg(F.count_distinct("id").alias("records_near"))
    return outside.groupBy("category").agg(F.count("*").alias("outside")).join(listings, "category", "left").select("category", "outside", F.coalesce("records_near", F.lit(0)).alias("records_near"))


BOUNDARY_AUDIT = f"""
with {POINTS_SQL}, {_EDGES_SQL},
o as (select destination_key, snapshot_date, category, geom_25832.x as x, geom_25832.y as y from osm_pois where geom_25832 is not null),
c as (select distinct destination_key from (select p.destination_key, e.area_id from o p join edges e on (e.y1 > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
      group by all having count(*) % 2 = 1)),
x as (select * from o where destination_key not in (select destination_key from c)),
n as (select x.category, count(distinct p.source_row_number) as k from x join pts p on p.snapshot_date = x.snapshot_date and (p.x - x.x) ** 2 + (p.y - x.y) ** 2 <= 640000 group by 1)
select x.category, count(*) as outside, coalesce(any_value(n.k), 0) as records_near from x left join n using (category) group by 1
"""


def clipped_cells(spark: SparkSession, d: str) -> DataFrame:
    """The share of every 1 km cell that each area covers."""
    return spatial.clipped_cells(_areas(spark, d), 1000.0).select("area_id", "cx", "cy", F.round("area", 2).alias("area_m2"))


def surface_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.point_on_surface(_areas(spark, d)).select("area_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def hull(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the convex hull of all destinations."""
    dest = _destinations(spark, d).select(F.col("other_x").alias("x"), F.col("other_y").alias("y"))
    return spark.createDataFrame([(i, *p) for i, p in enumerate(spatial.convex_hull(dest))], "corner long, x double, y double")


QUERIES = {
    q.__name__: q
    for q in (
        euclid_access, knn_8, within_3m, pip_assignment, near_border, buffer_exclusions, source_edge_coverage, polygon_area, utm_forward, grid_cells, extent,
        union_boundary, ring_problems, boundary_audit, clipped_cells, surface_points, hull,
    )
}
SQL = {
    "euclid_access": EUCLID_ACCESS, "knn_8": KNN_8, "within_3m": WITHIN_3M, "pip_assignment": PIP_ASSIGNMENT, "near_border": NEAR_BORDER, "buffer_exclusions": BUFFER_EXCLUSIONS,
    "source_edge_coverage": SOURCE_EDGE_COVERAGE, "polygon_area": POLYGON_AREA, "utm_forward": UTM_FORWARD, "grid_cells": GRID_CELLS, "extent": EXTENT, "union_boundary": UNION_BOUNDARY,
    "ring_problems": RING_PROBLEMS, "boundary_audit": BOUNDARY_AUDIT,
}
