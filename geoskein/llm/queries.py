"""Queries of the llm subpackage and their SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.llm import quantiles as Q
from geoskein.llm.canonical import map_to_entries
from geoskein.llm.components import connected_components
from geoskein.llm.encoding_repair import repair_records, stack_fields
from geoskein.llm.mixing import mix, quality_weight, reached_shares
from geoskein.llm.packing import bucket_report, pack_all
from geoskein.llm.place_groups import place_links
from geoskein.llm.readability import CLASSIC
from geoskein.llm.reading_level import reading_levels
from geoskein.llm.tokens import token_count, token_counts
from geoskein.plans.session import cut, ship, table

PLACE_FIELDS = ["neighbourhood_cleansed", "neighbourhood_group_cleansed"]
TYPED_FIELDS = ["neighbourhood_cleansed", "property_type"]


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_records(table(spark, d, "listings"), "source_row_number", PLACE_FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_repaired(spark, d).select("source_row_number", "field_name").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed values with the entry they mean, in SQL from the scan to the result."""
    entries = table(spark, d, "canonical_entries")
    typed = stack_fields(table(spark, d, "listings"), "source_row_number", TYPED_FIELDS).where(F.col("value").rlike(r"[^\s\p{Z}]"))
    exact = entries.select("field_name", F.col("canonical_value").alias("value")).distinct()
    distinct = typed.groupBy("field_name", "value").count().join(exact, ["field_name", "value"], "left_anti")
    found = cut(map_to_entries(cut(distinct.select("field_name", "value", F.col("value").alias("text"))), entries))
    return typed.join(found, ["field_name", "value"]).select("source_row_number", "field_name", "canonical_id").distinct()


AREA_DAY = ["official_cv_area_id", "snapshot_date", "last_scraped"]
AREA = AREA_DAY[:2]
PRICE_FIELDS = ["price_nightly", "log_price"]
PCTS = [50, 90]


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_dataset").select(*AREA_DAY, *PRICE_FIELDS).where("official_cv_area_id is not null")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with their certain bounds for single days and, merged from the same sketches, for all days."""
    days = cut(Q.sketches(_priced(spark, d), AREA_DAY, PRICE_FIELDS))
    single = Q.percentiles(days, AREA_DAY, PCTS).withColumn("scrape_day", F.date_format("last_scraped", "yyyy-MM-dd")).drop("last_scraped")
    whole = Q.percentiles(Q.merge_to(days, AREA), AREA, PCTS).withColumn("scrape_day", F.lit("all"))
    return single.unionByName(whole).select("official_cv_area_id", "snapshot_date", "scrape_day", "field_name", "pct", "n", "rank_error", "low", "estimate", "high")


def _differs(a_low: str, a_high: str, b_low: str, b_high: str) -> tuple[F.Column, F.Column]:
    """Whether the percentiles differ for certain, and whether they may, given the bounds of both."""
    ratio = F.col("field_name") == "price_nightly"

    def over(high: F.Column, low: F.Column) -> F.Column:
        return F.when(ratio, high > 1.5 * low).otherwise(high - low > 0.4)

    a0, a1, b0, b1 = (F.col(c) for c in (a_low, a_high, b_low, b_high))
    return over(a0, b1) | over(b0, a1), over(a1, b0) | over(b1, a0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Days whose percentile is off.  The sketches decide all days their bounds allow to; only the rest is counted exactly."""
    rows = _priced(spark, d)
    days = cut(Q.sketches(rows, AREA_DAY, PRICE_FIELDS))
    keys = [*AREA, "field_name", "pct"]
    single = Q.percentiles(days, AREA_DAY, PCTS).where("n >= 10").drop("rank_error", "estimate")
    whole = Q.percentiles(Q.merge_to(days, AREA), AREA, PCTS)
    whole = whole.select(*keys, *[F.col(c).alias(f"all_{c}") for c in ("n", "low", "high")])
    surely, maybe = _differs("low", "high", "all_low", "all_high")
    both = cut(single.join(whole, keys).withColumn("surely", surely).withColumn("maybe", maybe))
    open_ = both.where("maybe and not surely")
    day_exact = Q.exact_percentiles(rows, AREA_DAY, open_.select(*AREA_DAY, "field_name", "pct", "n", "low", "high"))
    asked = open_.select(*keys, F.col("all_n").alias("n"), F.col("all_low").alias("low"), F.col("all_high").alias("high")).distinct()
    all_exact = Q.exact_percentiles(rows, AREA, asked).withColumnRenamed("exact", "all_exact")
    exact, _ = _differs("exact", "exact", "all_exact", "all_exact")
    settled = open_.join(day_exact, [*AREA_DAY, "field_name", "pct"]).join(all_exact, keys).where(exact)
    columns = ["official_cv_area_id", F.date_format("last_scraped", "yyyy-MM-dd").alias("scrape_day"), "field_name", "pct"]
    return both.where("surely").select(*columns).unionByName(settled.select(*columns)).distinct()


P3_FOUND_SQL = """
with v as (
    select official_cv_area_id as area, snapshot_date, last_scraped, 'price_nightly' as field_name, cast(price_nightly as double) as value
    from analysis_dataset
    union all
    select official_cv_area_id, snapshot_date, last_scraped, 'log_price', log_price from analysis_dataset),
kept as (select * from v where area is not null and value is not null and not isnan(value)),
days as (
    select area, snapshot_date, last_scraped, field_name, count(*) as n,
           quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90 from kept group by all),
alld as (
    select area, snapshot_date, field_name, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90
    from kept group by all),
pairs as (
    select d.area, d.last_scraped, d.field_name, 50 as pct, d.p50 as a, w.p50 as b
    from days d join alld w on d.area = w.area and d.snapshot_date = w.snapshot_date and d.field_name = w.field_name where d.n >= 10
    union all
    select d.area, d.last_scraped, d.field_name, 90, d.p90, w.p90
    from days d join alld w on d.area = w.area and d.snapshot_date = w.snapshot_date and d.field_name = w.field_name where d.n >= 10)
select distinct area as official_cv_area_id, strftime(last_scraped, '%Y-%m-%d') as scrape_day, field_name, cast(pct as bigint) as pct
from pairs
where case when field_name = 'price_nightly' then greatest(a, b) > 1.5 * least(a, b) else abs(a - b) > 0.4 end
"""


def _grouped(pois: DataFrame) -> DataFrame:
    """(destination_key, group_key) of the rows that are tied to another one."""
    rest = F.expr("substring(vertex, 2)")
    return connected_components(place_links(pois)).select(rest.alias("destination_key"), F.expr("substring(component, 2)").alias("group_key"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row of osm_pois with the smallest destination_key of its group."""
    pois = table(spark, d, "osm_pois")
    return pois.select("destination_key").join(_grouped(pois), "destination_key", "left").select("destination_key", F.coalesce("group_key", "destination_key").alias("group_key"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "osm_pois"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The document parts of every container of each capacity, with the space the container leaves."""
    return pack_all(token_counts(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p7_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets of each capacity with their padding, and the containers that batches inside each bucket alone would take."""
    return bucket_report(token_counts(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed = p7_containers(spark, d)
    per = packed.groupBy("capacity_id", "capacity_tokens", "container").agg(F.first("space_left").alias("space_left"))
    return per.groupBy("capacity_id", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("space_left").alias("space_left"),
        (1 - F.sum("space_left") / (F.count("*") * F.first("capacity_tokens"))).alias("fill"),
    )


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", "source", quality_weight(text).alias("weight"), token_count(text).alias("tokens"))


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return mix(_weighted(spark, d), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the mix that each source reaches."""
    return reached_shares(*mix(_weighted(spark, d), table(spark, d, "mix_targets")))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The levels by sentence length, syllables and letters alone, without any list of words."""
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), CLASSIC)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("level >= 3.5").select("doc_id").distinct()


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source and level."""
    documents = table(spark, d, "documents").select("doc_id", "source")
    levels = p9_levels(spark, d).select("doc_id", F.least(F.floor(F.col("level") + 0.5), F.lit(5)).alias("reading_level"))
    return documents.join(levels, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"))


QUERIES = {
    q.__name__: q
    for q in (
        p1_repaired, p1_found, p3_percentiles, p3_found, p4_groups, p4_found, p5_found,
        p7_containers, p7_buckets, p7_fill, p8_uses, p8_shares, p9_levels, p9_formulas, p9_found, p9_profile,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND_SQL}
