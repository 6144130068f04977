"""Queries on joins, sets, reshaping and order, over the star-schema tables and the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoskein.operators import relational
from geoskein.plans.session import table


def left_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of left joins that keeps one row per order, with validated dimension keys."""
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    out = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = relational.validated_merge(out, customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), ["c_custkey"])
    out = relational.validated_merge(out, nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"])
    out = relational.validated_merge(out, region.select("r_regionkey", "r_name"), ["r_regionkey"])
    return out.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.count_distinct("o_orderkey").alias("distinct_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


LEFT_CHAIN = """
select r_name, c_mktsegment, count(*) as orders, count(distinct o_orderkey) as distinct_orders, round(sum(o_totalprice), 2) as total
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2
"""


def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    """Records whose place is an entry of the reference list, as a flag of a semi-join."""
    entries = table(spark, d, "canonical_entries").where("field_name = 'neighbourhood_cleansed'").select(F.col("canonical_value").alias("neighbourhood_cleansed"))
    flagged = relational.exists_flag(table(spark, d, "listings").select("source_file_id", "neighbourhood_cleansed"), entries, ["neighbourhood_cleansed"], "known")
    return flagged.groupBy("source_file_id", "known").agg(F.count("*").alias("n"))


EXISTS_FLAG = """
select source_file_id, exists (select 1 from canonical_entries c where c.field_name = 'neighbourhood_cleansed' and c.canonical_value = l.neighbourhood_cleansed) as known, count(*) as n
from listings l group by 1, 2
"""


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Analysis rows whose listing is not among the raw records."""
    raw = table(spark, d, "listings").select(F.expr("try_cast(id as bigint)").alias("listing_id"), "snapshot_date").where("listing_id is not null").distinct()
    return table(spark, d, "analysis_dataset").select("listing_id", "snapshot_date").join(raw, ["listing_id", "snapshot_date"], "left_anti").groupBy("snapshot_date").agg(F.count("*").alias("n"))


ANTI_JOIN = """
select snapshot_date, count(*) as n from analysis_dataset a
where not exists (select 1 from listings l where try_cast(l.id as bigint) = a.listing_id and l.snapshot_date = a.snapshot_date) group by 1
"""


def nested_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Exclusions at the small distance that are missing at the large one: none, if the lists are nested."""
    far = table(spark, d, "analysis_dataset").select("snapshot_date", "listing_id", "distance_centre_euclidean_km")
    small, large = far.where("distance_centre_euclidean_km <= 0.5"), far.where("distance_centre_euclidean_km <= 1.0")
    missing = small.join(large.select("snapshot_date", "listing_id"), ["snapshot_date", "listing_id"], "left_anti")
    return missing.agg(F.count("*").alias("violations"))


NESTED_EXCLUSIONS = """
select count(*) as violations from analysis_dataset a where distance_centre_euclidean_km <= 0.5
and not exists (select 1 from analysis_dataset b where b.distance_centre_euclidean_km <= 1.0 and a.snapshot_date = b.snapshot_date and a.listing_id = b.listing_id)
"""


def long_to_wide(spark: SparkSession, d: str) -> DataFrame:
    """Measures by nation and period, widened by conditional maxima."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    long = orders.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("period")).agg(F.count("*").cast("double").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("largest"))
    tall = relational.wide_to_long(long, ["n_nationkey", "period"], ["orders", "largest"], "measure", "value")
    wanted = {f"{m}_{y}": (F.col("measure") == m) & (F.col("period") == y) for m in ("orders", "largest") for y in (1995, 1996)}
    return relational.validated_merge(nation, relational.long_to_wide(tall, ["n_nationkey"], "measure", "value", wanted), ["n_nationkey"])


LONG_TO_WIDE = """
with l as (select c_nationkey, year(o_orderdate) as period, cast(count(*) as double) as orders, round(max(o_totalprice), 2) as largest
           from orders join customer on o_custkey = c_custkey group by 1, 2)
select n_nationkey, n_name, max(orders) filter (period = 1995) as orders_1995, max(orders) filter (period = 1996) as orders_1996,
       max(largest) filter (period = 1995) as largest_1995, max(largest) filter (period = 1996) as largest_1996
from nation left join l on n_nationkey = c_nationkey group by 1, 2
"""


def union_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Entities of three kinds in one relation with a discriminator."""
    frames = {
        "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "part": table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")),
    }
    return relational.union_labelled(frames, "kind")


UNION_LABELLED = """
select c_custkey as key, c_name as name, c_acctbal as balance, 'customer' as kind from customer
union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier union all select p_partkey, p_name, null, 'part' from part
"""


def sym_difference(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ between two snapshots of the destinations, with multiplicity."""
    pois = table(spark, d, "osm_pois").select("snapshot_date", "category", "osm_type", "name")
    a, b = (pois.where(F.col("snapshot_date") == s).drop("snapshot_date") for s in ("2011-04-04", "2011-05-16"))
    return relational.symmetric_difference(a, b).groupBy("side", "category").agg(F.count("*").alias("n"))


SYM_DIFFERENCE = """
with a as (select category, osm_type, name from osm_pois where snapshot_date = '2011-04-04'), b as (select category, osm_type, name from osm_pois where snapshot_date = '2011-05-16')
select side, category, count(*) as n from (
    select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)) group by 1, 2
"""


def except_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Destination names of the first snapshot that the last one lacks."""
    pois = table(spark, d, "osm_pois")
    a, b = (pois.where(F.col("snapshot_date") == s).select("name") for s in ("2011-04-04", "2011-05-16"))
    return a.subtract(b)


EXCEPT_DISTINCT = "select name from osm_pois where snapshot_date = '2011-04-04' except select name from osm_pois where snapshot_date = '2011-05-16'"


def conditional_agg(spark: SparkSession, d: str) -> DataFrame:
    """Filtered counts, distinct pairs, quantities and moments in one pass."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"), F.round(F.sum(F.when(F.col("l_tax") < 0.02, F.col("l_extendedprice"))), 2).alias("low_tax_price"),
        F.bool_or(F.col("l_quantity") >= 50).alias("some_full"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd_quantity"),
    )


CONDITIONAL_AGG = """
select l_returnflag, l_linestatus, count(*) as n, count(*) filter (l_discount > 0.05) as discounted, count(distinct l_suppkey) as suppliers, count(distinct (l_partkey, l_suppkey)) as pairs,
       round(sum(l_extendedprice) filter (l_tax < 0.02), 2) as low_tax_price, bool_or(l_quantity >= 50) as some_full, round(stddev_samp(l_quantity), 6) as sd_quantity
from lineitem group by 1, 2
"""


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three first names per category and snapshot, by name and key."""
    named = table(spark, d, "osm_pois").where("name is not null").select("snapshot_date", "category", "name", "destination_key")
    return relational.top_k_per_group(named, ["snapshot_date", "category"], ["name", "destination_key"], 3)


TOPK_PER_GROUP = """
select * from (select snapshot_date, category, name, destination_key, cast(row_number() over (partition by snapshot_date, category order by name, destination_key) as int) as rank
               from osm_pois where name is not null) where rank <= 3
"""


def pivot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Listings whose price differs between two snapshots, from a pivot with explicit values."""
    df = table(spark, d, "analysis_dataset").where("price_nightly is not null").withColumn("s", F.date_format("snapshot_date", "yyyyMMdd"))
    wide = df.groupBy("listing_id", "room_type").pivot("s", ["20110404", "20110418"]).agg(F.max("price_nightly"))
    return wide.where("`20110404` is not null and `20110418` is not null").groupBy("room_type").agg(F.count("*").alias("pairs"), F.count_if(F.col("20110404") != F.col("20110418")).alias("changed"))


PIVOT_PAIRS = """
with w as (select listing_id, room_type, max(price_nightly) filter (snapshot_date = '2011-04-04') as a, max(price_nightly) filter (snapshot_date = '2011-04-18') as b
           from analysis_dataset group by 1, 2)
select room_type, count(*) as pairs, count(*) filter (a <> b) as changed from w where a is not null and b is not null group by 1
"""


def contingency(spark: SparkSession, d: str) -> DataFrame:
    """Fixed columns, absent combinations as 0."""
    rooms = ["Entire home/apt", "Hotel room", "Private room", "Shared room"]
    wide = table(spark, d, "analysis_dataset").groupBy("official_cv_area_id").pivot("room_type", rooms).count()
    return wide.select("official_cv_area_id", *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r.lower().replace(" ", "_").replace("/", "_")) for r in rooms])


CONTINGENCY = """
select official_cv_area_id, count(*) filter (room_type = 'Entire home/apt') as entire_home_apt, count(*) filter (room_type = 'Hotel room') as hotel_room,
       count(*) filter (room_type = 'Private room') as private_room, count(*) filter (room_type = 'Shared room') as shared_room
from analysis_dataset group by 1
"""


def null_safe_diff(spark: SparkSession, d: str) -> DataFrame:
    """Listings whose latest two raw records differ in some field, NULL equal to NULL."""
    raw = table(spark, d, "listings").select("id", "source_row_number", "property_type", "price", "bedrooms").where("id is not null")
    w = Window.partitionBy("id").orderBy("source_row_number")
    pairs = raw.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("property_type", "price", "bedrooms")}).withColumn("k", F.row_number().over(w)).where("k > 1")
    return pairs.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"prev_{c}"))).alias(f"{c}_changes") for c in ("property_type", "price", "bedrooms")])


NULL_SAFE_DIFF = """
with p as (select *, row_number() over w as k, lag(property_type) over w as a, lag(price) over w as b, lag(bedrooms) over w as c from listings where id is not null
           window w as (partition by id order by source_row_number))
select count(*) filter (property_type is distinct from a) as property_type_changes, count(*) filter (price is distinct from b) as price_changes,
       count(*) filter (bedrooms is distinct from c) as bedrooms_changes from p where k > 1
"""


def zero_count_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """Counts per category and subtype of a literal dimension: absent subtypes as 0, and subtotals."""
    kinds = [("food_social", "restaurant"), ("food_social", "cafe"), ("food_social", "bar"), ("food_social", "pub"), ("cultural_tourist", "museum"), ("cultural_tourist", "zoo")]
    dimension = spark.createDataFrame(kinds, "category string, subtype string")
    pois = table(spark, d, "osm_pois").select("category", F.coalesce(F.get_json_object("tags", "$.amenity"), F.get_json_object("tags", "$.tourism")).alias("subtype"))
    counted = dimension.join(pois.groupBy("category", "subtype").agg(F.count("*").alias("n")), ["category", "subtype"], "left").select("category", "subtype", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.unionByName(counted.groupBy("category").agg(F.sum("n").alias("n")).withColumn("subtype", F.lit("all")))


ZERO_COUNT_SUBTYPES = """
with k(category, subtype) as (values ('food_social', 'restaurant'), ('food_social', 'cafe'), ('food_social', 'bar'), ('food_social', 'pub'), ('cultural_tourist', 'museum'), ('cultural_tourist', 'zoo')),
p as (select category, coalesce(json_extract_string(tags, '$.amenity'), json_extract_string(tags, '$.tourism')) as subtype, count(*) as n from osm_pois group by 1, 2),
c as (select k.category, k.subtype, coalesce(n, 0) as n from k left join p on k.category = p.category and k.subtype = p.subtype)
select * from c union all select category, 'all', cast(sum(n) as bigint) from c group by 1
"""


def extremal_cases(spark: SparkSession, d: str) -> DataFrame:
    """The farthest, nearest and dearest rows, each excluding those chosen before; top-one reports by a total order."""
    df = table(spark, d, "analysis_dataset").where("price_nightly is not null and distance_centre_euclidean_km is not null")
    df = df.select("listing_id", "snapshot_date", "last_scraped", "distance_centre_euclidean_km", F.col("price_nightly").cast("double").alias("price")).distinct()
    key = ["listing_id", "snapshot_date", "last_scraped", "price"]
    taken: list[int] = []
    out = None
    for name, order in (("farthest", F.desc("distance_centre_euclidean_km")), ("nearest", F.asc("distance_centre_euclidean_km")), ("dearest", F.desc("price"))):
        one = df.where(~F.col("listing_id").isin(taken)).orderBy(order, *key).limit(1).withColumn("case_name", F.lit(name))
        row = one.first()
        taken += [row.listing_id] if row else []
        out = one if out is None else out.unionByName(one)
    return out.select("case_name", "listing_id", "snapshot_date")


EXTREMAL_CASES = """
with b as (select distinct listing_id, snapshot_date, last_scraped, distance_centre_euclidean_km as km, cast(price_nightly as double) as price
           from analysis_dataset where price_nightly is not null and distance_centre_euclidean_km is not null),
f as (select * from b order by km desc, listing_id, snapshot_date, last_scraped, price limit 1),
n as (select * from b where listing_id not in (select listing_id from f) order by km, listing_id, snapshot_date, last_scraped, price limit 1),
e as (select * from b where listing_id not in (select listing_id from f union all select listing_id from n) order by price desc, listing_id, snapshot_date, last_scraped limit 1)
select 'farthest' as case_name, listing_id, snapshot_date from f union all select 'nearest', listing_id, snapshot_date from n union all select 'dearest', listing_id, snapshot_date from e
"""


def largest_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_dataset").groupBy("host_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host_id").limit(1)


LARGEST_GROUP = "select host_id, count(*) as n from analysis_dataset group by 1 order by n desc, host_id limit 1"


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Paired changes of the log price between neighbouring snapshots of a listing."""
    first = table(spark, d, "analysis_dataset").where("log_price is not null").groupBy("listing_id", "snapshot_date").agg(F.min("log_price").alias("v"))
    w = Window.partitionBy("listing_id").orderBy("snapshot_date")
    pairs = first.withColumn("before", F.lag("v").over(w)).where("before is not null").withColumn("delta", F.col("v") - F.col("before"))
    return pairs.groupBy("snapshot_date").agg(
        F.count("*").alias("pairs"), F.count_if(F.abs("delta") > 1e-7).alias("changed"), F.round(F.avg("delta"), 6).alias("mean_delta"),
        F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.max("delta"), 6).alias("max_delta"),
    )


SNAPSHOT_CHANGES = """
with f as (select listing_id, snapshot_date, min(log_price) as v from analysis_dataset where log_price is not null group by 1, 2),
p as (select *, v - lag(v) over (partition by listing_id order by snapshot_date) as delta from f)
select snapshot_date, count(*) as pairs, count(*) filter (abs(delta) > 1e-7) as changed, round(avg(delta), 6) as mean_delta, round(min(delta), 6) as min_delta, round(max(delta), 6) as max_delta
from p where delta is not null group by 1
"""


def distance_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rows and shares by distance band."""
    km = F.col("distance_centre_euclidean_km")
    band = F.when(km < 0.8, "0-800").when(km < 1.6, "800-1600").when(km.isNotNull(), "over_1600")
    out = table(spark, d, "analysis_dataset").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("observed_positive_price")).alias("priced"))
    return out.withColumn("priced_pct", F.round(100 * F.col("priced") / F.col("n"), 4))


DISTANCE_BANDS = """
select case when distance_centre_euclidean_km < 0.8 then '0-800' when distance_centre_euclidean_km < 1.6 then '800-1600' when distance_centre_euclidean_km is not null then 'over_1600' end as band,
       count(*) as n, count(*) filter (observed_positive_price) as priced, round(100.0 * count(*) filter (observed_positive_price) / count(*), 4) as priced_pct
from analysis_dataset group by 1
"""


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of JSON objects, per event type."""
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.count_distinct("user_id").alias("users"))


JSON_PROPS = """
select event_type, count(*) as n, count(k) as with_k, cast(sum(k) as bigint) as sum_k, count(distinct user_id) as users
from (select *, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1
"""

QUERIES = {
    q.__name__: q
    for q in (
        left_chain, exists_flag, anti_join, nested_exclusions, long_to_wide, union_labelled, sym_difference, except_distinct, conditional_agg, topk_per_group,
        pivot_pairs, contingency, null_safe_diff, zero_count_subtypes, extremal_cases, largest_group, snapshot_changes, distance_bands, json_props,
    )
}
SQL = {
    "left_chain": LEFT_CHAIN, "exists_flag": EXISTS_FLAG, "anti_join": ANTI_JOIN, "nested_exclusions": NESTED_EXCLUSIONS, "long_to_wide": LONG_TO_WIDE,
    "union_labelled": UNION_LABELLED, "sym_difference": SYM_DIFFERENCE, "except_distinct": EXCEPT_DISTINCT, "conditional_agg": CONDITIONAL_AGG, "topk_per_group": TOPK_PER_GROUP,
    "pivot_pairs": PIVOT_PAIRS, "contingency": CONTINGENCY, "null_safe_diff": NULL_SAFE_DIFF, "zero_count_subtypes": ZERO_COUNT_SUBTYPES, "extremal_cases": EXTREMAL_CASES,
    "largest_group": LARGEST_GROUP, "snapshot_changes": SNAPSHOT_CHANGES, "distance_bands": DISTANCE_BANDS, "json_props": JSON_PROPS,
}
