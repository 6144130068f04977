"""Queries on typing, cleaning, profiling and filtering of the raw listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.functions import tags, typed
from geoskein.operators import quality, relational, stats
from geoskein.plans.session import cut, table

TOKENS = ("Wifi", "Kitchen", "Dishwasher", "Washer", "Dryer", "Self check-in")
RULE_ORDER = ("conventional", "private_or_shared", "hotel_like", "ambiguous", "other")


def clean_listings(spark: SparkSession, d: str) -> DataFrame:
    """The raw listings typed: every field cast only where its text matches, else NULL."""
    raw = table(spark, d, "listings")
    lat, lon = typed.coordinate(F.col("latitude")), typed.coordinate(F.col("longitude"))
    price = typed.currency(F.col("price"))
    return raw.select(
        "source_row_number", "source_file_id", "snapshot_date", "host_id",
        typed.integer(F.col("id"), "bigint").alias("listing_id"),
        typed.date(F.col("last_scraped")).alias("last_scraped"),
        typed.blank_to_null(F.col("neighbourhood_cleansed")).alias("neighbourhood"),
        typed.blank_to_null(F.col("property_type")).alias("property_type"),
        typed.blank_to_null(F.col("room_type")).alias("room_type"),
        lat.alias("latitude"), lon.alias("longitude"),
        F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)).alias("valid_coordinates"),
        price.alias("price_nightly"),
        typed.log_positive(price).alias("log_price"),
        F.coalesce(price > 0, F.lit(False)).alias("valid_price"),
        typed.integer(F.col("accommodates")).alias("accommodates"),
        typed.number(F.col("bedrooms")).alias("bedrooms"),
        F.col("bathrooms_text"), "amenities",
        typed.integer(F.col("minimum_nights")).alias("minimum_nights"),
        typed.integer(F.col("number_of_reviews")).alias("number_of_reviews"),
        typed.number(F.col("review_scores_rating")).alias("review_scores_rating"),
        typed.boolean_token(F.col("host_is_superhost")).alias("superhost"),
    )


def _guard(column: str, pattern: str, kind: str) -> str:
    return f"case when regexp_full_match({column}, '{pattern}') then try_cast({column} as {kind}) end"


CLEAN_CTE = f"""
    clean0 as (
        select source_row_number, source_file_id, snapshot_date, host_id,
            {_guard("id", "[0-9]+", "bigint")} as listing_id,
            {_guard("last_scraped", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "date")} as last_scraped,
            nullif(neighbourhood_cleansed, '') as neighbourhood, nullif(property_type, '') as property_type, nullif(room_type, '') as room_type,
            {_guard("latitude", "-?[0-9]+([.][0-9]+)?", "double")} as latitude,
            {_guard("longitude", "-?[0-9]+([.][0-9]+)?", "double")} as longitude,
            case when regexp_full_match(price, '[$]([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]{{2}})?')
                 then try_cast(translate(price, '$,', '') as decimal(14,2)) end as price_nightly,
            {_guard("accommodates", "[0-9]+", "int")} as accommodates,
            {_guard("bedrooms", "[0-9]+([.][0-9]+)?", "double")} as bedrooms,
            bathrooms_text, amenities,
            {_guard("minimum_nights", "[0-9]+", "int")} as minimum_nights,
            {_guard("number_of_reviews", "[0-9]+", "int")} as number_of_reviews,
            {_guard("review_scores_rating", "[0-9]+([.][0-9]+)?", "double")} as review_scores_rating,
            case when lower(host_is_superhost) in ('t', 'true', 'yes') then true when lower(host_is_superhost) in ('f', 'false', 'no') then false end as superhost
        from listings),
    clean as (
        select *, coalesce(latitude between -90 and 90 and longitude between -180 and 180, false) as valid_coordinates,
            case when price_nightly > 0 then ln(cast(price_nightly as double)) end as log_price,
            coalesce(price_nightly > 0, false) as valid_price
        from clean0)"""


def clean_typed_cast(spark: SparkSession, d: str) -> DataFrame:
    return clean_listings(spark, d).drop("amenities", "bathrooms_text").withColumn("log_price", F.round("log_price", 6))


CLEAN_TYPED_CAST = f"with {CLEAN_CTE} select * exclude (amenities, bathrooms_text, log_price), round(log_price, 6) as log_price from clean"


def currency_parse(spark: SparkSession, d: str) -> DataFrame:
    """How many prices of each file parse, fail or are absent, and their sum."""
    raw = table(spark, d, "listings").select("source_file_id", "price", typed.currency(F.col("price")).alias("parsed"))
    return raw.groupBy("source_file_id").agg(
        F.count("*").alias("n"), F.count("parsed").alias("parsed"), F.count_if(F.coalesce("price", F.lit("")) == "").alias("absent"),
        F.count_if((F.coalesce("price", F.lit("")) != "") & F.col("parsed").isNull()).alias("malformed"), F.sum("parsed").cast("double").alias("price_sum"),
    )


CURRENCY_PARSE = f"""
with {CLEAN_CTE}
select l.source_file_id, count(*) as n, count(c.price_nightly) as parsed, count(*) filter (coalesce(l.price, '') = '') as absent,
       count(*) filter (coalesce(l.price, '') <> '' and c.price_nightly is null) as malformed, cast(sum(c.price_nightly) as double) as price_sum
from listings l join clean c using (source_row_number) group by 1
"""


def fallback_parse(spark: SparkSession, d: str) -> DataFrame:
    """Bathrooms from text, with where each number came from."""
    raw = table(spark, d, "listings")
    value, provenance, disagree = typed.fallback_number(F.col("bedrooms"), F.col("bathrooms_text"))
    return raw.select("source_row_number", value.alias("value"), provenance.alias("provenance"), disagree.alias("disagree"))


FALLBACK_PARSE = f"""
with p as (
    select source_row_number, {_guard("bedrooms", "[0-9]+([.][0-9]+)?", "double")} as given,
           try_cast(nullif(regexp_extract(bathrooms_text, '([0-9]+(?:[.][0-9]+)?)', 1), '') as double) as found,
           case when regexp_matches(bathrooms_text, '(?i)half-bath') then 0.5 end as half
    from listings)
select source_row_number, cast(coalesce(given, found, half) as double) as value,
       case when given is not null then 'structured' when found is not null then 'text_number' when half is not null then 'text_half' else 'missing' end as provenance,
       coalesce(given <> coalesce(found, half), false) as disagree
from p
"""


def loose_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "listings")
    return raw.select(
        "source_row_number", typed.loose_number(F.col("price")).alias("loose_price"), typed.first_number(F.col("bathrooms_text")).alias("first_bath"),
        typed.code_prefix(F.col("property_type")).alias("prefix"), typed.padded_key("file_", F.col("source_file_id") % 100, 3).alias("file_key"),
        F.replace(F.col("room_type"), F.lit("/"), F.lit("-")).alias("room_key"),
        typed.aliased(F.col("room_type"), {"Hotel room": "hotel", "Shared room": "shared"}).alias("room_alias"),
        typed.log1p_nonnegative(typed.integer(F.col("minimum_nights"))).cast("decimal(10,5)").cast("double").alias("log1p_nights"),
    )


LOOSE_NUMBERS = """
select source_row_number, try_cast(regexp_replace(price, '[^0-9.\\-]', '', 'g') as double) as loose_price,
       try_cast(nullif(regexp_extract(bathrooms_text, '[-+]?\\d+(?:\\.\\d+)?', 0), '') as double) as first_bath,
       split_part(property_type, ' ', 1) as prefix,
       'file_' || lpad(cast(source_file_id % 100 as varchar), 3, '0') as file_key, replace(room_type, '/', '-') as room_key,
       case room_type when 'Hotel room' then 'hotel' when 'Shared room' then 'shared' else room_type end as room_alias,
       cast(cast(case when regexp_full_match(minimum_nights, '[0-9]+') then ln(1 + cast(minimum_nights as double)) end as decimal(10,5)) as double) as log1p_nights
from listings
"""


def token_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return stats.token_prevalence(table(spark, d, "listings"), "amenities", TOKENS)


_JSON_LIST = "case when json_valid(amenities) and json_type(amenities) = 'ARRAY' then from_json(amenities, '[\"VARCHAR\"]') end"
TOKEN_PREVALENCE = f"""
with a as (select amenities, {_JSON_LIST} as parsed from listings),
s as (select count(amenities) as n, count(*) filter (amenities is not null and parsed is null) as invalid_rows from a),
t as (select unnest([{", ".join(f"'{t}'" for t in TOKENS)}]) as token)
select t.token, count(*) filter (list_contains(parsed, t.token)) as rows_with, any_value(invalid_rows) as invalid_rows,
       round(100.0 * count(*) filter (list_contains(parsed, t.token)) / (any_value(n) - any_value(invalid_rows)), 4) as prevalence_pct,
       100.0 * count(*) filter (list_contains(parsed, t.token)) / (any_value(n) - any_value(invalid_rows)) > 5
       and 100.0 * count(*) filter (list_contains(parsed, t.token)) / (any_value(n) - any_value(invalid_rows)) < 95 as usable
from t, a, s group by t.token
"""


def amenity_flags(spark: SparkSession, d: str) -> DataFrame:
    """Exact membership of tokens, NULL where the source is NULL or malformed."""
    raw = table(spark, d, "listings")
    return raw.select("source_row_number", *[typed.json_has_token(F.col("amenities"), t).alias(f"has_{t.lower().replace(' ', '_').replace('-', '_')}") for t in TOKENS])


AMENITY_FLAGS = f"""
with a as (select source_row_number, {_JSON_LIST} as parsed from listings)
select source_row_number, {", ".join(f"list_contains(parsed, '{t}') as has_{t.lower().replace(' ', '_').replace('-', '_')}" for t in TOKENS)} from a
"""


def null_census(spark: SparkSession, d: str) -> DataFrame:
    return relational.null_census(table(spark, d, "listings").select("id", "host_id", "neighbourhood_cleansed", "price", "last_scraped", "amenities", "loaded_at"))


NULL_CENSUS = " union all ".join(
    f"select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as nulls, {f'''count(*) filter (trim({c}) = '')''' if text else 'cast(0 as bigint)'} as blanks from listings"
    for c, text in (("id", 1), ("host_id", 0), ("neighbourhood_cleansed", 1), ("price", 1), ("last_scraped", 1), ("amenities", 1), ("loaded_at", 0))
)


def sample_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Records left after each predicate of a cumulative funnel."""
    stages = [
        ("dated", F.col("last_scraped").isNotNull()),
        ("placed", F.col("neighbourhood").isNotNull()),
        ("entire_home", F.col("room_type") == "Entire home/apt"),
        ("valid_price", F.col("valid_price")),
        ("valid_coordinates", F.col("valid_coordinates")),
    ]
    return relational.funnel(clean_listings(spark, d), stages)


_STAGES = ["true", "last_scraped is not null", "neighbourhood is not null", "room_type = 'Entire home/apt'", "valid_price", "valid_coordinates"]
SAMPLE_FUNNEL = f"""
with {CLEAN_CTE},
s as (select {", ".join(f"count(*) filter ({' and '.join(_STAGES[: i + 1])}) as s{i}" for i in range(6))} from clean)
{" union all ".join(f"select {i} as stage_no, '{n}' as stage, s{i} as remaining, s{max(0, i - 1)} - s{i} as excluded from s" for i, n in enumerate(["all", "dated", "placed", "entire_home", "valid_price", "valid_coordinates"]))}
"""


def property_rules(spark: SparkSession, d: str) -> DataFrame:
    """Records by the first rule that their property type meets."""
    p = F.col("property_type")
    # The types and patterns of each rule.
    rules = [
        (p.isin("Entire rental unit", "Entire condo", "Entire home", "Entire townhouse", "Entire villa", "Entire loft"), RULE_ORDER[0]),
        (p.startswith("Private room") | p.startswith("Shared room"), RULE_ORDER[1]),
        (p.rlike("(?i)hotel|serviced|hostel"), RULE_ORDER[2]),
        (p.isin("Entire place", "Casa particular"), RULE_ORDER[3]),
    ]
    return table(spark, d, "listings").groupBy(typed.ordered_rule(rules, RULE_ORDER[4]).alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("property_type").alias("n_types"))


PROPERTY_RULES = """
select case when property_type in ('Entire rental unit', 'Entire condo', 'Entire home', 'Entire townhouse', 'Entire villa', 'Entire loft') then 'conventional'
            when property_type like 'Private room%' or property_type like 'Shared room%' then 'private_or_shared'
            when regexp_matches(property_type, '(?i)hotel|serviced|hostel') then 'hotel_like'
            when property_type in ('Entire place', 'Casa particular') then 'ambiguous' else 'other' end as rule,
       count(*) as n, count(distinct property_type) as n_types
from listings group by 1
"""


def missingness(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "analysis_dataset")
    return stats.missingness(df, ["official_cv_area_id", "room_type", "snapshot_date"], ["price_nightly", "bedrooms", "distance_centre_euclidean_km"])


MISSINGNESS = " union all ".join(
    f"""select '{dim}' as dimension, coalesce(cast({dim} as varchar), 'unassigned') as "group", '{v}' as variable, count(*) as n,
    count(*) - count({v}) as missing_n, round(100.0 * (count(*) - count({v})) / count(*), 4) as missing_pct from analysis_dataset group by 2"""
    for dim in ("official_cv_area_id", "room_type", "snapshot_date")
    for v in ("price_nightly", "bedrooms", "distance_centre_euclidean_km")
)


def descriptives(spark: SparkSession, d: str) -> DataFrame:
    """Exact descriptives by area; the skewed area is not gathered in a task."""
    return stats.descriptives(table(spark, d, "analysis_dataset"), ["official_cv_area_id"], ["log_price", "bedrooms", "accommodates"])


DESCRIPTIVES = " union all ".join(
    f"""select official_cv_area_id, '{v}' as variable, count(*) as n, count({v}) as n_observed, count(*) - count({v}) as n_missing,
    round(avg({v}), 3) as mean, round(stddev_samp({v}), 3) as sd, round(cast(min({v}) as double), 3) as min, round(cast(max({v}) as double), 3) as max,
    {", ".join(f"round(quantile_cont(cast({v} as double), {p}), 3) as {name}" for p, name in ((0.05, "p05"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95")))}
    from analysis_dataset group by 1"""
    for v in ("log_price", "bedrooms", "accommodates")
)


def composition(spark: SparkSession, d: str) -> DataFrame:
    return stats.composition(table(spark, d, "analysis_dataset"), ["snapshot_date"], F.col("official_cv_area_id"), "area")


COMPOSITION = """
select snapshot_date, coalesce(official_cv_area_id, 'unassigned') as area, count(*) as n, round(count(*) / sum(count(*)) over (partition by snapshot_date), 6) as share
from analysis_dataset group by 1, 2
"""


def batch_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows per day kept, where a day counts only if enough of its rows have a price: the rate is taken before the filter."""
    df = table(spark, d, "analysis_dataset").select("last_scraped", "price_nightly", "room_type")
    kept = relational.clip_rate_batches(df, "last_scraped", F.col("price_nightly") > 0, 0.8)
    return kept.where("price_nightly is not null").groupBy("last_scraped").agg(F.count("*").alias("n"))


BATCH_FILTER = """
select last_scraped, count(*) as n from analysis_dataset
where price_nightly is not null and last_scraped in (
    select last_scraped from analysis_dataset group by 1 having avg(case when price_nightly > 0 then 1.0 else 0.0 end) >= 0.8)
group by 1
"""


def suppressed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Small cells are held back; their rows are still accounted for."""
    cells = table(spark, d, "analysis_dataset").groupBy("official_cv_area_id", "room_type", "accommodates").agg(F.count("*").alias("n"), F.round(F.avg("log_price"), 6).alias("mean_log_price"))
    cells = cut(cells)
    shown = quality.suppress_small(cells, "n", 5).withColumn("shown", F.lit(True))
    hidden = cells.where("n < 5").groupBy().agg(F.sum("n").alias("n")).where("n is not null").withColumn("shown", F.lit(False))
    return shown.unionByName(hidden, allowMissingColumns=True)


SUPPRESSED_CELLS = """
with c as (select official_cv_area_id, room_type, accommodates, count(*) as n, round(avg(log_price), 6) as mean_log_price from analysis_dataset group by 1, 2, 3)
select *, true as shown from c where n >= 5
union all
select null, null, null, n, null, false from (select cast(sum(n) as bigint) as n from c where n < 5) where n is not null
"""


def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "analysis_dataset").select("distance_centre_euclidean_km", "log_price")
    return stats.quantile_bins(df, "distance_centre_euclidean_km", "bin").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("log_price"), 6).alias("mean_log_price"))


QUANTILE_BINS = """
with q as (select quantile_cont(distance_centre_euclidean_km, 0.25) as a, quantile_cont(distance_centre_euclidean_km, 0.5) as b, quantile_cont(distance_centre_euclidean_km, 0.75) as c from analysis_dataset)
select case when distance_centre_euclidean_km <= a then 'Q1' when distance_centre_euclidean_km <= b then 'Q2' when distance_centre_euclidean_km <= c then 'Q3'
            when distance_centre_euclidean_km is not null then 'Q4' end as bin, count(*) as n, round(avg(log_price), 6) as mean_log_price
from analysis_dataset, q group by 1
"""


def tag_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories by tags, up to three per object, one row each."""
    pois = table(spark, d, "osm_pois").select("destination_key", F.from_json("tags", "map<string,string>").alias("t"))
    tag = lambda k: F.try_element_at("t", F.lit(k))
    food = tags.has(tag, "amenity", *tags.FOOD_AMENITIES)
    culture = tags.has(tag, "tourism", *tags.CULTURE_TOURISM) | tags.has(tag, "amenity", *tags.CULTURE_AMENITIES) | tags.has(tag, "historic", *tags.CULTURE_HISTORIC)
    station = tags.is_station(tag)
    labels = F.filter(F.array(F.when(food, "food_social"), F.when(culture, "cultural_tourist"), F.when(station, "station")), lambda x: x.isNotNull())
    return pois.select("destination_key", F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("destination_key").alias("objects"))


TAG_CATEGORIES = """
with t as (select destination_key, json_extract_string(tags, '$.amenity') as amenity, json_extract_string(tags, '$.tourism') as tourism,
                  json_extract_string(tags, '$.historic') as historic, json_extract_string(tags, '$.railway') as railway, json_extract_string(tags, '$.name') as name,
                  json_extract_string(tags, '$.public_transport') as transport, json_extract_string(tags, '$.train') as train, json_extract_string(tags, '$.subway') as subway, json_extract_string(tags, '$.station') as station
           from osm_pois),
l as (
    select destination_key, 'food_social' as label from t where amenity in ('restaurant', 'cafe', 'bar', 'pub')
    union all select destination_key, 'cultural_tourist' from t where tourism in ('museum', 'gallery', 'attraction', 'viewpoint') or amenity = 'theatre' or historic in ('monument', 'castle', 'palace')
    union all select destination_key, 'station' from t where coalesce(name, '') <> '' and (railway in ('station', 'halt') or (transport = 'station' and (train = 'yes' or subway = 'yes' or station in ('subway', 'light_rail', 'train')))))
select label, count(*) as n, count(distinct destination_key) as objects from l group by 1
"""


def audit_checks(spark: SparkSession, d: str) -> DataFrame:
    """Named checks of the analysis table, observed against expected, in one pass."""
    df = table(spark, d, "analysis_dataset")
    checks = {
        "null_keys": (F.count_if(F.col("listing_id").isNull() | F.col("snapshot_date").isNull()), 0),
        "log_without_price": (F.count_if(F.col("log_price").isNotNull() & ~F.coalesce(F.col("price_nightly") > 0, F.lit(False))), 0),
        "log_identity": (F.count_if(F.abs(F.col("log_price") - F.log(F.col("price_nightly").cast("double"))) > 0.001), 0),
        "area_without_municipality": (F.count_if(F.col("official_cv_area_id").isNotNull() & F.col("official_municipality_code").isNull()), 0),
        "snapshots": (F.count_distinct("snapshot_date"), 4),
    }
    return quality.audit(df, checks)


AUDIT_CHECKS = """
with s as (
    select count(*) filter (listing_id is null or snapshot_date is null) as a,
           count(*) filter (log_price is not null and not coalesce(price_nightly > 0, false)) as b,
           count(*) filter (price_nightly > 0 and abs(log_price - ln(cast(price_nightly as double))) > 0.001) as c,
           count(*) filter (official_cv_area_id is not null and official_municipality_code is null) as d, count(distinct snapshot_date) as e from analysis_dataset)
select 'null_keys' as check_name, a as observed, cast(0 as bigint) as expected, a = 0 as passed from s
union all select 'log_without_price', b, 0, b = 0 from s union all select 'log_identity', c, 0, c = 0 from s
union all select 'area_without_municipality', d, 0, d = 0 from s union all select 'snapshots', e, 4, e = 4 from s
"""

QUERIES = {
    q.__name__: q
    for q in (
        clean_typed_cast, currency_parse, fallback_parse, loose_numbers, token_prevalence, amenity_flags, null_census, sample_funnel, property_rules,
        missingness, descriptives, composition, batch_filter, suppressed_cells, quantile_bins, tag_categories, audit_checks,
    )
}
SQL = {
    "clean_typed_cast": CLEAN_TYPED_CAST, "currency_parse": CURRENCY_PARSE, "fallback_parse": FALLBACK_PARSE, "loose_numbers": LOOSE_NUMBERS,
    "token_prevalence": TOKEN_PREVALENCE, "amenity_flags": AMENITY_FLAGS, "null_census": NULL_CENSUS, "sample_funnel": SAMPLE_FUNNEL, "property_rules": PROPERTY_RULES,
    "missingness": MISSINGNESS, "descriptives": DESCRIPTIVES, "composition": COMPOSITION, "batch_filter": BATCH_FILTER, "suppressed_cells": SUPPRESSED_CELLS,
    "quantile_bins": QUANTILE_BINS, "tag_categories": TAG_CATEGORIES, "audit_checks": AUDIT_CHECKS,
}
