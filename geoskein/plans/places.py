"""Queries on listings and destinations: points near points and regions, records that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.functions import geo, typed
from geoskein.operators.spatial import containing_area, within_distance
from geoskein.plans.session import cut, table
from geoskein.sources import csv_records

NEAR_METRES = 25.0


def usable_points(listings: DataFrame, *columns: str) -> DataFrame:
    """(columns..., x, y) of the records whose coordinates pass the clean rule, in metres."""
    lat, lon = typed.coordinate(F.col("latitude")), typed.coordinate(F.col("longitude"))
    kept = listings.select(*columns, lat.alias("lat"), lon.alias("lon")).where("lat between -90 and 90 and lon between -180 and 180")
    return geo.with_utm32(kept).select(*columns, "x", "y")


def _listing_points(spark: SparkSession, d: str) -> DataFrame:
    return usable_points(table(spark, d, "listings"), "source_row_number", "snapshot_date").withColumnRenamed("source_row_number", "id")


def near_pois(points: DataFrame, pois: DataFrame) -> DataFrame:
    other = pois.select("snapshot_date", F.col("destination_key").alias("other_id"), F.col("geom_25832.x").alias("other_x"), F.col("geom_25832.y").alias("other_y"))
    return within_distance(points, other, NEAR_METRES, ["snapshot_date"])


def covering_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    return containing_area(points, areas.select(F.col("official_cv_area_id").alias("area_id"), F.col("rings_25832").alias("rings")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = cut(_listing_points(spark, d))  # used by both joins and their counts of frequent cells
    pois = near_pois(points, table(spark, d, "osm_pois")).select(F.col("id").alias("source_row_number"), F.lit("poi").alias("target_kind"), F.col("other_id").alias("target_key"))
    areas = covering_areas(points, table(spark, d, "official_areas")).select(F.col("id").alias("source_row_number"), F.lit("area").alias("target_kind"), F.col("area_id").alias("target_key"))
    return pois.unionByName(areas).distinct()


_EAST, _NORTH = geo.utm32_sql("lon", "lat")
POINTS_SQL = f"""
    typed as (
        select source_row_number, snapshot_date,
               case when regexp_full_match(latitude, '-?[0-9]+([.][0-9]+)?') then try_cast(latitude as double) end as lat,
               case when regexp_full_match(longitude, '-?[0-9]+([.][0-9]+)?') then try_cast(longitude as double) end as lon
        from listings),
    pts as (
        select source_row_number, snapshot_date, {_EAST} as x, {_NORTH} as y
        from typed where lat between -90 and 90 and lon between -180 and 180)"""
P2_SQL = f"""
with {POINTS_SQL},
    edges as (
        select official_cv_area_id, ring[i].x as x1, ring[i].y as y1, ring[i + 1].x as x2, ring[i + 1].y as y2
        from (select official_cv_area_id, ring, unnest(range(1, len(ring))) as i
              from (select official_cv_area_id, unnest(rings_25832) as ring from official_areas)))
select distinct p.source_row_number, 'poi' as target_kind, o.destination_key as target_key
from pts p join osm_pois o on p.snapshot_date = o.snapshot_date
where (p.x - o.geom_25832.x) ** 2 + (p.y - o.geom_25832.y) ** 2 <= {NEAR_METRES * NEAR_METRES}
union all
select p.source_row_number, 'area', e.official_cv_area_id
from pts p join edges e on (e.y1 > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
group by all having count(*) % 2 = 1
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return csv_records.failed_records(table(spark, d, "listing_lines")).select("line_id", "reason").distinct()


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The records that load, typed."""
    return csv_records.loaded_records(table(spark, d, "listing_lines").select("line_id", "source_file_id", "record_no", "raw_line"))


_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
P6_PARTS_SQL = rf"""
    shaped as (
        select line_id, source_file_id, record_no, raw_line,
               coalesce(regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*', 's'), false) as well,
               list_transform(regexp_extract_all(',' || raw_line, ',({_FIELD})', 1),
                              lambda f: case when f like '"%' then replace(f[2:-2], '""', '"') else f end) as f
        from listing_lines),
    judged as (
        select *,
               case when not well then 'quoting'
                    when len(f) <> 10 then 'column_count'
                    when not regexp_full_match(f[1], '[0-9]+') or try_cast(f[1] as bigint) is null then 'bad_id'
                    when f[8] <> '' and not regexp_full_match(f[8], '[$]([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]{{2}})?') then 'bad_price' end as reason
        from shaped)"""
P6_SQL = f"with {P6_PARTS_SQL} select distinct line_id, reason from judged where reason is not null"
P6_LOADED_SQL = f"""
with {P6_PARTS_SQL}
select line_id, source_file_id, record_no, cast(f[1] as bigint) as id,
       {", ".join(f"nullif(f[{i}], '') as {name}" for i, name in enumerate([f.name for f in csv_records.RECORD.fields], 1) if i > 1)}
from judged where reason is null
"""

QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_loaded": p6_loaded}
SQL = {"p2_found": P2_SQL, "p6_found": P6_SQL, "p6_loaded": P6_LOADED_SQL}
