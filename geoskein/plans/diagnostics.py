"""Classifiers, updates and diagnostic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoskein.functions import tags as T
from geoskein.operators import graph, relational, spatial, stats
from geoskein.plans.access import _COVER_SQL, _EDGES_SQL, _areas, _destinations
from geoskein.plans.access import CATEGORIES, EUCLID_ACCESS, RADII
from geoskein.plans.networks import MULTI_SOURCE_NEAREST, multi_source_nearest, segments
from geoskein.plans.places import POINTS_SQL, _listing_points
from geoskein.plans.session import cut, once, table

# Tag values drawn for each object from its key and the number of the tag; NULL is an absent tag.
STATION_TAGS = {
    "railway": [None, "station", None, "halt", "stop"],
    "public_transport": [None, "station", "platform", "stop_position"],
    "train": [None, "yes", "no"],
    "subway": [None, None, "yes", "no", None],
    "station": [None, "subway", "light_rail", None, "train", "funicular"],
    "network": [None, "S-tog", "other"],
    "name": ["Nord", None, "", "Syd"],
    "highway": [None, None, "bus_stop", "platform"],
    "bus": [None, "yes", "no", None],
}


def station_classes(spark: SparkSession, d: str) -> DataFrame:
    """Stations with their mode and subtype, and bus stops with their rule, for tags drawn from the order lines by their keys."""
    k = F.col("l_orderkey") * 11 + F.col("l_linenumber")
    drawn = {}
    for i, (key, values) in enumerate(STATION_TAGS.items()):
        at = F.floor(k * (2 * i + 3) / (i + 1)) % len(values)
        drawn[key] = F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at + 1).cast("int"))
    tag = lambda key: drawn.get(key, F.lit(None).cast("string"))
    station = T.is_station(tag)
    category = F.when(station, "station")
    rows = table(spark, d, "lineitem").select(
        station.alias("station"), F.when(station, T.station_mode(tag)).alias("mode"), T.subtype(tag, category).alias("subtype"),
        F.concat_ws(";", T.qualifying_tags(tag, category)).alias("qualifying"), T.stop_rule(tag).alias("stop_rule"),
    )
    return rows.groupBy("station", "mode", "subtype", "qualifying", "stop_rule").agg(F.count("*").alias("n"))


def _drawn(i: int, key: str, values: list) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[cast(floor(k * {2 * i + 3} / {i + 1}) % {len(values)} + 1 as int)] as {key}"


STATION_CLASSES = f"""
with k as (select l_orderkey * 11 + l_linenumber as k from lineitem),
t as (select {", ".join(_drawn(i, key, values) for i, (key, values) in enumerate(STATION_TAGS.items()))} from k),
s as (select *, coalesce(name, '') <> '' and (coalesce(railway in ('station', 'halt'), false)
        or (coalesce(public_transport = 'station', false) and (coalesce(train = 'yes', false) or coalesce(subway = 'yes', false) or coalesce(station in ('subway', 'light_rail', 'train'), false)))) as is_station from t)
select is_station as station,
       case when not is_station then null when station = 'subway' or subway = 'yes' then 'metro' when station = 'light_rail' or network = 'S-tog' then 'urban_rail' else 'rail' end as mode,
       case when not is_station then null when railway in ('station', 'halt') then railway else 'public_transport_station' end as subtype,
       case when is_station then concat_ws(';', case when railway in ('station', 'halt') then 'railway=' || railway end, case when public_transport = 'station' then 'public_transport=station' end,
            case when train = 'yes' then 'train=yes' end, case when subway = 'yes' then 'subway=yes' end, case when station in ('subway', 'light_rail', 'train') then 'station=' || station end) else '' end as qualifying,
       case when highway = 'bus_stop' then 'highway=bus_stop' when public_transport = 'platform' and bus = 'yes' then 'public_transport=platform;bus=yes' end as stop_rule,
       count(*) as n from s group by all
"""


def destination_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """Destinations by category, exclusive subtype and qualifying tags."""
    pois = table(spark, d, "osm_pois").select("category", F.from_json("tags", "map<string,string>").alias("t"))
    tag = lambda k: F.try_element_at("t", F.lit(k))
    listed = pois.select("category", T.subtype(tag, F.col("category")).alias("subtype"), F.concat_ws(";", T.qualifying_tags(tag, F.col("category"))).alias("qualifying"))
    return listed.groupBy("category", "subtype", "qualifying").agg(F.count("*").alias("n"))


DESTINATION_SUBTYPES = """
with t as (select category, json_extract_string(tags, '$.amenity') as amenity, json_extract_string(tags, '$.tourism') as tourism, json_extract_string(tags, '$.historic') as historic from osm_pois),
q as (select category, case when amenity in ('restaurant', 'cafe', 'bar', 'pub') then amenity end as food, case when tourism in ('museum', 'gallery', 'attraction', 'viewpoint') then tourism end as tour,
             case when amenity = 'theatre' then amenity end as stage, case when historic in ('monument', 'castle', 'palace') then historic end as old from t)
select category, case category when 'food_social' then food when 'cultural_tourist' then coalesce(tour, stage, old) end as subtype,
       case category when 'food_social' then coalesce('amenity=' || food, '') else concat_ws(';', 'tourism=' || tour, 'amenity=' || stage, 'historic=' || old) end as qualifying, count(*) as n
from q group by all
"""

SNAP_WARNINGS = (100, 250)


def snap_flags(spark: SparkSession, d: str) -> DataFrame:
    """Records by how far their nearest destination is, and whether a nearer one might lie beyond the edge of its area.

    A record within 400 m of the boundary is complete if the nearest destination is strictly nearer than that.
    """
    points = once(_listing_points(spark, d), "x", "y")
    nearest = spatial.access(points, _destinations(spark, d).withColumn("other_id", F.lit(0)), [], [], ["snapshot_date"], nearest=1600.0)
    edge = spatial.boundary_within(points.select("id", "x", "y"), _areas(spark, d), 400.0, ["id"]).groupBy("id").agg(F.min("distance").alias("edge_m"))
    rows = nearest.select("id", "snapshot_date", "distance").join(edge, "id", "left")
    over = [F.count_if(F.col("distance") > m).alias(f"over_{m}_m") for m in SNAP_WARNINGS]
    complete = F.col("distance") < F.col("edge_m")
    out = rows.groupBy("snapshot_date").agg(F.count("*").alias("n"), *over, F.count_if(complete).alias("complete"), F.count_if(~complete).alias("incomplete"), F.count_if(complete.isNull()).alias("not_judged"))
    return out


_SEGMENT = """sqrt((p.x - (x1 + greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (x2 - x1))) ** 2
      + (p.y - (y1 + greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (y2 - y1))) ** 2)"""
SNAP_FLAGS = f"""
with {POINTS_SQL}, {_EDGES_SQL},
near as (select p.source_row_number as id, min(sqrt((p.x - o.geom_25832.x) ** 2 + (p.y - o.geom_25832.y) ** 2)) as distance
         from pts p join osm_pois o on p.snapshot_date = o.snapshot_date and o.geom_25832 is not null group by 1),
border as (select p.source_row_number as id, min({_SEGMENT}) as edge_m from pts p, edges group by 1),
j as (select p.source_row_number as id, snapshot_date, distance, case when edge_m <= 400 then edge_m end as edge_m
      from pts p left join near on near.id = p.source_row_number left join border on border.id = p.source_row_number)
select snapshot_date, count(*) as n, {", ".join(f"count(*) filter (distance > {m}) as over_{m}_m" for m in SNAP_WARNINGS)}, count(*) filter (distance < edge_m) as complete,
       count(*) filter (distance >= edge_m) as incomplete, count(*) filter ((distance < edge_m) is null) as not_judged from j group by 1
"""


def covering_name(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the smallest name of an area that covers it, NULL where none does."""
    areas = table(spark, d, "official_areas").select(F.col("official_cv_area_id").alias("area_id"), "navn")
    held = spatial.containing_area(cut(_listing_points(spark, d)), _areas(spark, d)).join(areas, "area_id").groupBy("id").agg(F.min("navn").alias("area_name"))
    return _listing_points(spark, d).select("id").join(held, "id", "left").select(F.col("id").alias("source_row_number"), "area_name")


COVERING_NAME = f"""
with {POINTS_SQL}, {_EDGES_SQL}, {_COVER_SQL}
select p.source_row_number, (select min(a.navn) from cover c join official_areas a on a.official_cv_area_id = c.area_id where c.source_row_number = p.source_row_number) as area_name from pts p
"""


def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Areas of each snapshot numbered by mean price from the highest, areas without a price and the missing area last."""
    means = table(spark, d, "analysis_dataset").groupBy("snapshot_date", "official_cv_area_id").agg(F.round(F.avg(F.col("price_nightly").cast("double")), 4).alias("mean_price"))
    w = Window.partitionBy("snapshot_date").orderBy(F.col("official_cv_area_id").isNull(), F.desc_nulls_last("mean_price"), F.asc_nulls_last("official_cv_area_id"))  # a row per area
    return means.withColumn("place", F.row_number().over(w).cast("long"))


NULLS_LAST = """
with m as (select snapshot_date, official_cv_area_id, round(avg(cast(price_nightly as double)), 4) as mean_price from analysis_dataset group by 1, 2)
select *, row_number() over (partition by snapshot_date order by official_cv_area_id is null, mean_price desc nulls last, official_cv_area_id nulls last) as place from m
"""


def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose total is replaced by the sum of their returned lines, where they have any."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("o_totalprice"))
    return relational.update_from(orders, returned, ["o_orderkey"], ["o_totalprice"])


KEYED_UPDATE = """
select o_orderkey, o_orderstatus, coalesce(r.s, cast(o_totalprice as double)) as o_totalprice
from orders left join (select l_orderkey, round(sum(cast(l_extendedprice as double)), 2) as s from lineitem where l_returnflag = 'R' group by 1) r on r.l_orderkey = o_orderkey
"""


def exclusive_cells(spark: SparkSession, d: str) -> DataFrame:
    """Totals over cells that exclude one another, and over those of one status."""
    cells = cut(table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("double")).alias("quantity")))
    return relational.exclusive_sums(cells, ["l_linenumber"], ["l_returnflag", "l_linestatus"], "quantity", {"open_total": F.col("l_linestatus") == "O"})


EXCLUSIVE_CELLS = """
select l_linenumber, count(distinct (l_returnflag, l_linestatus)) as cells, sum(cast(l_quantity as double)) as total,
       sum(cast(l_quantity as double)) filter (l_linestatus = 'O') as open_total from lineitem group by 1
"""


def representation_difference(spark: SparkSession, d: str) -> DataFrame:
    """How much a narrower count differs from a wider one of the same records: share, median difference, rank correlation.

    A narrower count above the wider one is refused.
    """
    points = once(_listing_points(spark, d).select("snapshot_date", "x", "y"), "x", "y")
    wide = spatial.access(points, _destinations(spark, d), RADII, CATEGORIES, ["snapshot_date"])
    kinds = [(c, small, large) for c in ("food_social", "cultural_tourist") for small, large in ((800, 1200), (1200, 1600))]
    pairs = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"within_{s}_{c}").alias("w"), F.col(f"within_{l}_{c}").alias("e")) for i, (c, s, l) in enumerate(kinds)])
    rows = wide.select(F.explode(pairs).alias("p")).where("p.w is not null").groupBy("p.kind", "p.w", "p.e").agg(F.count("*").alias("n"))
    named = F.element_at(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(f"{s}<{l}").alias("radii")) for c, s, l in kinds]), F.col("kind") + 1)
    return representation(cut(rows)).select(named["category"].alias("category"), named["radii"].alias("radii"), "n", "different_share", "median_gap", "spearman")


def representation(rows: DataFrame) -> DataFrame:
    """(kind, n, different_share, median_gap, spearman) of distinct pairs of counts (kind, w, e) that come n times."""
    if not rows.where("w > e").isEmpty():
        raise relational.ContractError("a narrower count exceeds the wider one")
    shares = rows.groupBy("kind").agg(F.sum("n").alias("total"), F.round(F.sum(F.when(F.col("e") != F.col("w"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("different_share"))

    def upto(column: str) -> DataFrame:
        """(kind, column, n, upto) of its distinct values, which are no more than the counts differ."""
        values = rows.withColumn("gap", F.col("e") - F.col("w")).groupBy("kind", column).agg(F.sum("n").alias("n"))
        return values.withColumn("upto", F.sum("n").over(Window.partitionBy("kind").orderBy(column)))

    gaps = upto("gap").join(shares.select("kind", "total"), "kind")
    at = [F.min(F.when(F.col("upto") >= F.floor((F.col("total") + k) / 2), F.col("gap"))) for k in (1, 2)]
    medians = gaps.groupBy("kind").agg(((at[0] + at[1]) / 2).alias("median_gap"))

    def ranks(column: str, name: str) -> DataFrame:
        """Average ranks less their mean, which is the middle of all ranks."""
        centred = F.col("upto") - (F.col("n") - 1) / 2 - (F.col("total") + 1) / 2
        return cut(upto(column).join(shares.select("kind", "total"), "kind").select("kind", column, F.col("n").alias("_n"), centred.alias(name)))

    a, b = ranks("w", "ra"), ranks("e", "rb")
    squares = [r.groupBy("kind").agg(F.sum(F.col("_n") * F.col(c) * F.col(c)).alias(f"{c}2")) for r, c in ((a, "ra"), (b, "rb"))]
    by_e = rows.join(a.drop("_n"), ["kind", "w"]).groupBy("kind", "e").agg(F.sum(F.col("n") * F.col("ra")).alias("s"))
    cross = by_e.join(b, ["kind", "e"]).groupBy("kind").agg(F.sum(F.col("s") * F.col("rb")).alias("ab"))
    out = shares.join(medians, "kind").join(cross, "kind").join(squares[0], "kind").join(squares[1], "kind")
    rho = F.when(F.col("total") >= 30, F.round(F.try_divide(F.col("ab"), F.sqrt(F.col("ra2")) * F.sqrt(F.col("rb2"))), 6))
    return out.select("kind", F.col("total").alias("n"), "different_share", "median_gap", rho.alias("spearman"))


_PAIRS = " union all ".join(
    f"select '{c}' as category, '{s}<{w}' as radii, cast(within_{s}_{c} as double) as w, cast(within_{w}_{c} as double) as e from access"
    for c in ("food_social", "cultural_tourist")
    for s, w in ((800, 1200), (1200, 1600))
)
REPRESENTATION_DIFFERENCE = f"""
with access as ({EUCLID_ACCESS}), r as ({_PAIRS}),
k as (select *, rank() over (partition by category, radii order by w) + (count(*) over (partition by category, radii, w) - 1) / 2.0 as a,
                rank() over (partition by category, radii order by e) + (count(*) over (partition by category, radii, e) - 1) / 2.0 as b from r)
select category, radii, count(*) as n, round(avg(cast(e <> w as double)), 6) as different_share, quantile_cont(e - w, 0.5) as median_gap,
       case when count(*) >= 30 then round(corr(cast(a as double), cast(b as double)), 6) end as spearman from k group by 1, 2
"""


def quartile_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts cut at quartiles of distance and price, with their medians; a row may belong to several."""
    rows = table(spark, d, "analysis_dataset").select(F.col("distance_centre_euclidean_km").alias("km"), F.col("log_price").alias("lp")).where("km is not null and lp is not null")
    km = stats.exact_percentiles(rows, [], "km", (0.25, 0.75), ("km25", "km75")).first()
    lp = stats.exact_percentiles(rows, [], "lp", (0.25,), ("lp25",)).first()
    if km is None:
        return rows.select(F.lit("").alias("cohort"), F.lit(0).cast("long").alias("n"), F.col("km").alias("median_km"), F.col("lp").alias("median_log_price")).limit(0)
    near, far, cheap = F.col("km") <= km["km25"], F.col("km") >= km["km75"], F.col("lp") <= lp["lp25"]
    labels = F.filter(F.array(F.when(F.col("km") < 2, "within_2_km"), F.when(F.col("km") >= 6, "from_6_km"), F.when(far & cheap, "far_cheap"), F.when(near & cheap, "near_cheap")), lambda c: c.isNotNull())
    cohorts = rows.select(F.explode(labels).alias("cohort"), "km", "lp")
    a = stats.exact_percentiles(cohorts, ["cohort"], "km", (0.5,), ("median_km",))
    b = stats.exact_percentiles(cohorts, ["cohort"], "lp", (0.5,), ("median_log_price",)).drop("n")
    return a.join(b, "cohort").select("cohort", "n", F.round("median_km", 6).alias("median_km"), F.round("median_log_price", 6).alias("median_log_price"))


QUARTILE_COHORTS = """
with r as (select distance_centre_euclidean_km as km, log_price as lp from analysis_dataset where distance_centre_euclidean_km is not null and log_price is not null),
q as (select quantile_cont(km, 0.25) as km25, quantile_cont(km, 0.75) as km75, quantile_cont(lp, 0.25) as lp25 from r),
c as (select 'within_2_km' as cohort, km, lp from r where km < 2 union all select 'from_6_km', km, lp from r where km >= 6
      union all select 'far_cheap', km, lp from r, q where km >= km75 and lp <= lp25 union all select 'near_cheap', km, lp from r, q where km <= km25 and lp <= lp25)
select cohort, count(*) as n, round(quantile_cont(km, 0.5), 6) as median_km, round(quantile_cont(lp, 0.5), 6) as median_log_price from c group by 1
"""

REACH_METRES = 500.0


def partial_reach(spark: SparkSession, d: str) -> DataFrame:
    """Segments by how much of them is walked within a budget from their start: nodes joined at both ends."""
    at = cut(multi_source_nearest(spark, d).select("node", "distance"))
    seg = segments(spark, d).select("u", "v", "length_m")
    ends = seg.join(at.select(F.col("node").alias("u"), F.col("distance").alias("from_u")), "u").join(at.select(F.col("node").alias("v"), F.col("distance").alias("from_v")), "v")
    share = graph.partial_edge_reach(F.col("from_u"), F.col("length_m"), REACH_METRES)
    kind = F.when((F.col("from_u") <= REACH_METRES) & (F.col("from_v") <= REACH_METRES), "both_ends").when((F.col("from_u") <= REACH_METRES) | (F.col("from_v") <= REACH_METRES), "one_end").otherwise("none")
    return ends.groupBy(kind.alias("reached")).agg(F.count("*").alias("segments"), F.round(F.sum("length_m"), 3).alias("length_m"), F.round(F.sum(share * F.col("length_m")), 3).alias("walked_m"))


PARTIAL_REACH = f"""
{MULTI_SOURCE_NEAREST.rsplit("select node", 1)[0].rstrip()},
seg as (select p_partkey as u, p_partkey + 1 as v, p_size * 10.0 as length_m from part, part_last where p_partkey % 40 < 39 and p_partkey < last
        union all select p_partkey, p_partkey + 40, p_size * 10.0 + 5 from part, part_last where p_partkey + 40 <= last),
ends as (select cast(length_m as double) as l, cast(a.distance as double) as du, cast(b.distance as double) as dv from seg join best a on a.node = u join best b on b.node = v)
select case when du <= 500 and dv <= 500 then 'both_ends' when du <= 500 or dv <= 500 then 'one_end' else 'none' end as reached, count(*) as segments, round(sum(l), 3) as length_m,
       round(sum(greatest(0, least(1, (500 - du) / l)) * l), 3) as walked_m from ends group by 1
"""

QUERIES = {
    q.__name__: q
    for q in (
        station_classes, destination_subtypes, snap_flags, covering_name, nulls_last, keyed_update, exclusive_cells, representation_difference, quartile_cohorts, partial_reach,
    )
}
SQL = {
    "station_classes": STATION_CLASSES, "destination_subtypes": DESTINATION_SUBTYPES, "snap_flags": SNAP_FLAGS, "covering_name": COVERING_NAME, "nulls_last": NULLS_LAST,
    "keyed_update": KEYED_UPDATE, "exclusive_cells": EXCLUSIVE_CELLS, "representation_difference": REPRESENTATION_DIFFERENCE, "quartile_cohorts": QUARTILE_COHORTS, "partial_reach": PARTIAL_REACH,
}
