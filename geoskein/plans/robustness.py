"""Queries on robustness: scenarios, buffers, clipped destinations, comparisons with a baseline, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.operators import folds, models, relational, spatial
from geoskein.plans.access import _EDGES_SQL, BUFFER_EXCLUSIONS, _areas, _destinations, buffer_exclusions
from geoskein.plans.modelling import KEY, SAMPLE_CTE, sample
from geoskein.plans.networks import _greedy, dedup_greedy
from geoskein.plans.places import POINTS_SQL, _listing_points
from geoskein.plans.session import cut, table


def area_means(spark: SparkSession, d: str) -> DataFrame:
    """Rounded means by area, rows without an area as 'unassigned'."""
    df = table(spark, d, "analysis_dataset")
    return df.groupBy(F.coalesce("official_cv_area_id", F.lit("unassigned")).alias("area")).agg(F.count("*").alias("n"), F.round(F.avg("distance_centre_euclidean_km"), 2).alias("mean_km"), F.round(F.avg("log_price"), 4).alias("mean_log_price"))


AREA_MEANS = "select coalesce(official_cv_area_id, 'unassigned') as area, count(*) as n, round(avg(distance_centre_euclidean_km), 2) as mean_km, round(avg(log_price), 4) as mean_log_price from analysis_dataset group by 1"


def buffer_feasibility(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of each held-out area before and after the buffer."""
    points = cut(_listing_points(spark, d))
    inside = spatial.containing_area(points, _areas(spark, d)).groupBy("area_id").agg(F.count_distinct("id").alias("test_n"))
    excluded = buffer_exclusions(spark, d).groupBy("area_id", "buffer_m").agg(F.count("*").alias("excluded_n"))
    total = points.count()
    out = inside.join(excluded, "area_id")
    return out.select("area_id", "buffer_m", (F.lit(total) - F.col("test_n")).alias("train_n"), "excluded_n", (F.lit(total) - F.col("test_n") - F.col("excluded_n")).alias("buffered_n"))


_EXCLUDED_SQL = BUFFER_EXCLUSIONS.strip().removeprefix("with ")
BUFFER_FEASIBILITY = f"""
with {_EXCLUDED_SQL.rsplit("select source_row_number, area_id, b.buffer_m", 1)[0].rstrip()},
x as (select source_row_number, area_id, b.buffer_m{_EXCLUDED_SQL.rsplit("select source_row_number, area_id, b.buffer_m", 1)[1]}),
t as (select area_id, count(*) as test_n from cover group by 1), n as (select count(*) as total from pts), e as (select area_id, buffer_m, count(*) as excluded_n from x group by 1, 2)
select area_id, buffer_m, total - test_n as train_n, excluded_n, total - test_n - excluded_n as buffered_n from t join e using (area_id), n
"""


def clip_change(spark: SparkSession, d: str) -> DataFrame:
    """Records whose destinations within 800 m change when only those inside the areas count: never more, by category."""
    points = cut(_listing_points(spark, d))
    dest = cut(_destinations(spark, d).where("other_x is not null"))
    inside = spatial.containing_area(dest.select("other_id", F.col("other_x").alias("x"), F.col("other_y").alias("y")), _areas(spark, d)).select("other_id").distinct().withColumn("inside", F.lit(True))
    pairs = spatial.within_distance(points, dest.join(inside, "other_id", "left"), 800.0, ["snapshot_date"])
    per = pairs.groupBy("id", "category").agg(F.count("*").alias("everywhere"), F.count("inside").alias("clipped"))
    change = F.col("clipped") - F.col("everywhere")
    return per.groupBy("category").agg(
        F.count("*").alias("records"), F.count_if(change != 0).alias("changed"), F.min(change).alias("largest_loss"), F.round(F.avg(change), 6).alias("mean_change"), F.count_if(change > 0).alias("violations")
    )


CLIP_CHANGE = f"""
with {POINTS_SQL}, {_EDGES_SQL},
o as (select destination_key, snapshot_date, category, geom_25832.x as x, geom_25832.y as y from osm_pois where geom_25832 is not null),
c as (select distinct destination_key from (select p.destination_key, e.area_id from o p join edges e on (e.y1 > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
      group by all having count(*) % 2 = 1)),
n as (select p.source_row_number, o.category, count(*) as everywhere, count(c.destination_key) as clipped
      from pts p join o on p.snapshot_date = o.snapshot_date and (p.x - o.x) ** 2 + (p.y - o.y) ** 2 <= 640000 left join c using (destination_key) group by 1, 2)
select category, count(*) as records, count(*) filter (clipped <> everywhere) as changed, min(clipped - everywhere) as largest_loss, round(avg(clipped - everywhere), 6) as mean_change,
       count(*) filter (clipped > everywhere) as violations from n group by 1
"""


def incremental_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Gain of the one-regressor model over the training mean, fold by fold."""
    s = cut(sample(spark, d).withColumn("fold", F.dayofmonth("snapshot_date")).where("km is not null"))
    runs = {
        "model": models.metrics(models.cross_validated_ols(s, ["km"], "log_price", "fold"), ["fold"], "log_price", "estimate"),
        "mean": models.metrics(models.training_mean(s, "log_price", "fold"), ["fold"], "log_price", "estimate"),
    }
    wide = relational.long_to_wide(relational.union_labelled(runs, "model"), ["fold"], "model", "rmse", {"a": F.col("model") == "mean", "b": F.col("model") == "model"})
    return wide.select("fold", F.round("a", 6).alias("rmse_mean"), F.round("b", 6).alias("rmse_model"), F.round(100 * (F.col("a") - F.col("b")) / F.col("a"), 4).alias("gain_pct"))


INCREMENTAL_METRICS = f"""
with {SAMPLE_CTE}, s as (select day(snapshot_date) as fold, km, log_price as y from sample where km is not null), f as (select distinct fold as test_fold from s),
b as (select test_fold, regr_slope(y, km) as slope, regr_intercept(y, km) as icpt, avg(y) as m from f join s on s.fold <> f.test_fold group by 1),
e as (select fold, sqrt(avg((y - m) ** 2)) as a, sqrt(avg((y - icpt - slope * km) ** 2)) as b from s join b on fold = test_fold group by 1)
select cast(fold as int) as fold, round(a, 6) as rmse_mean, round(b, 6) as rmse_model, round(100 * (a - b) / a, 4) as gain_pct from e
"""

SCENARIOS = {"all": "true", "entire_home": "room_type = 'Entire home/apt'", "near_2km": "km <= 2", "small": "accommodates <= 2"}


def scenario_runner(spark: SparkSession, d: str) -> DataFrame:
    """The same model on several subsets of the sample."""
    s = cut(sample(spark, d).where("km is not null"))
    out = models.scenarios(s, {n: F.expr(c) for n, c in SCENARIOS.items()}, ["km"], "log_price")
    return out.select("scenario", "n", "term", F.round("beta", 6).alias("beta"))


SCENARIO_RUNNER = f"with {SAMPLE_CTE}, s as (select * from sample where km is not null) " + " union all ".join(
    f"select '{n}' as scenario, count(*) as n, '{t}' as term, round({f}(log_price, km), 6) as beta from s where {c}" for n, c in SCENARIOS.items() for t, f in (("intercept", "regr_intercept"), ("km", "regr_slope"))
)


def sample_profile(spark: SparkSession, d: str) -> DataFrame:
    """Selection by status: rows, share and conditional counts of priced and unpriced rows."""
    df = table(spark, d, "analysis_dataset")
    out = df.groupBy(F.col("observed_positive_price").alias("priced")).agg(F.count("*").alias("n"), F.count_if(F.col("bedrooms") >= 2).alias("two_bedrooms"), F.count_distinct("host_id").alias("hosts"), F.round(F.avg("accommodates"), 6).alias("mean_accommodates"))
    return out.withColumn("hosts_per_row", F.round(F.col("hosts") / F.col("n"), 6))


SAMPLE_PROFILE = """
select observed_positive_price as priced, count(*) as n, count(*) filter (bedrooms >= 2) as two_bedrooms, count(distinct host_id) as hosts, round(avg(accommodates), 6) as mean_accommodates,
       round(count(distinct host_id) / count(*), 6) as hosts_per_row from analysis_dataset group by 1
"""


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the analysis table that come more than once, by how often."""
    twice = relational.duplicate_keys(table(spark, d, "analysis_dataset"), ["snapshot_date", "listing_id", "last_scraped"])
    return twice.groupBy("n").agg(F.count("*").alias("keys"))


DUPLICATE_KEYS = "select n, count(*) as keys from (select count(*) as n from analysis_dataset group by snapshot_date, listing_id, last_scraped having count(*) > 1) group by 1"


def canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, canonical rows and duplicates by category and reason."""
    kinds = table(spark, d, "osm_pois").select(F.col("destination_key").alias("key"), "category")
    return dedup_greedy(spark, d).join(kinds, "key").groupBy("category", "reason").agg(F.count("*").alias("n"), F.count_distinct("canonical_key").alias("canonical_rows"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the merged references: every object is linked once, canonical rows point to themselves."""
    rows = cut(_greedy(spark, d))
    from geoskein.operators import resolve

    resolved = cut(resolve.greedy_duplicates(rows))
    refs = resolve.merged_references(rows, resolved)
    self_linked = resolved.where("reason = 'canonical' and key <> canonical_key").count()
    dangling = resolved.join(resolved.where("reason = 'canonical'").select(F.col("key").alias("canonical_key")), "canonical_key", "left_anti").count()
    return refs.agg(F.sum(F.col("duplicate_count") + 1).alias("rows"), F.count("*").alias("canonical")).withColumns({"not_self": F.lit(self_linked).cast("long"), "dangling": F.lit(dangling).cast("long")})


def gbt_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold errors of boosted trees by held-out snapshot."""
    s = sample(spark, d).withColumn("fold", F.dayofmonth("snapshot_date")).select("fold", "km", "accommodates", F.coalesce("bedrooms", F.lit(1.0)).alias("bedrooms"), "log_price")
    scored = models.boosted_trees(s, ["km", "accommodates", "bedrooms"], "log_price", "fold", trees=8)
    return models.metrics(scored, ["fold"], "log_price", "estimate")


def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    """Random pairs of sample rows: how many, and that none is paired with itself."""
    pairs = folds.sampled_pairs(sample(spark, d).select(KEY), KEY, 2)
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col(KEY) == F.col(f"other_{KEY}")).alias("with_itself"))


QUERIES = {
    q.__name__: q
    for q in (
        area_means, buffer_feasibility, clip_change, incremental_metrics, scenario_runner, sample_profile, duplicate_keys, canonical_counts, provenance, gbt_metrics, pair_sample,
    )
}
SQL = {
    "area_means": AREA_MEANS, "buffer_feasibility": BUFFER_FEASIBILITY, "clip_change": CLIP_CHANGE, "incremental_metrics": INCREMENTAL_METRICS, "scenario_runner": SCENARIO_RUNNER,
    "sample_profile": SAMPLE_PROFILE, "duplicate_keys": DUPLICATE_KEYS,
}
