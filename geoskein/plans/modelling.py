"""Queries on folds, statistics and linear models over the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.functions import geo
from geoskein.operators import folds, models, spatial, stats
from geoskein.operators.relational import wide_to_long
from geoskein.plans.session import cut, table
from geoskein.sources.sinks import content_digest

KEY = "row_key"
BINS = [0.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0]
#: Each row meets most rows of its snapshot, so cells of pairs to 8 km are split early.
ROWS_PER_SALT = 1_000


def sample(spark: SparkSession, d: str) -> DataFrame:
    """Analysis rows with an area and a price, one per listing and snapshot: the last scraped."""
    df = table(spark, d, "analysis_dataset").where("official_cv_area_id is not null and log_price is not null")
    key = F.concat_ws("|", F.col("snapshot_date").cast("string"), F.col("listing_id").cast("string"))
    last = df.groupBy("snapshot_date", "listing_id").agg(
        F.max_by(F.struct("official_cv_area_id", "official_municipality_code", "room_type", "property_type", "accommodates", "bedrooms", "log_price", "distance_centre_euclidean_km"),
                 F.struct("last_scraped", "loaded_at", "log_price", "accommodates", F.coalesce("bedrooms", F.lit(-1.0)), "distance_centre_euclidean_km")).alias("r")
    )
    return last.select(key.alias(KEY), "snapshot_date", "listing_id", F.col("r.official_cv_area_id").alias("area"), F.col("r.official_municipality_code").alias("municipality"),
                       "r.room_type", "r.property_type", F.col("r.accommodates").cast("double").alias("accommodates"), "r.bedrooms", "r.log_price", F.col("r.distance_centre_euclidean_km").alias("km"))


SAMPLE_CTE = """
    sample as (
        select snapshot_date || '|' || listing_id as row_key, snapshot_date, listing_id, official_cv_area_id as area, official_municipality_code as municipality, room_type, property_type,
               cast(accommodates as double) as accommodates, bedrooms, log_price, distance_centre_euclidean_km as km
        from analysis_dataset where official_cv_area_id is not null and log_price is not null
        qualify row_number() over (partition by snapshot_date, listing_id
            order by last_scraped desc, loaded_at desc, log_price desc, accommodates desc, coalesce(bedrooms, -1) desc, distance_centre_euclidean_km desc) = 1)"""


def fold_area(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-area-out folds and their sizes."""
    s = sample(spark, d)
    return folds.area_folds(s, KEY, "area").groupBy("fold").agg(F.count("*").alias("n"))


FOLD_AREA = f"with {SAMPLE_CTE} select cast(fold as int) as fold, count(*) as n from (select dense_rank() over (order by area) as fold from sample) group by 1"


def fold_random(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the folds of a seeded permutation."""
    return folds.random_folds(sample(spark, d), KEY).groupBy("fold").agg(F.count("*").alias("n"))


FOLD_RANDOM = f"with {SAMPLE_CTE}, n as (select count(*) as n from sample) select cast(f as int) as fold, n // 5 + case when f <= n % 5 then 1 else 0 end as n from n, range(1, 6) as r(f)"


def fold_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Listings kept whole in one of five folds, strata of municipality spread: rows per fold and split listings."""
    s = cut(sample(spark, d).withColumn("block", F.col("listing_id") % 500))
    placed = cut(s.join(folds.grouped_folds(s, KEY, "block", "municipality"), KEY))
    broken = folds.split_groups(placed, "fold", "block").count()
    return placed.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("municipality").alias("municipalities")).withColumn("split_blocks", F.lit(broken).cast("long"))


def fold_hashed(spark: SparkSession, d: str) -> DataFrame:
    return folds.hashed_folds(sample(spark, d), KEY).groupBy("fold").agg(F.count("*").alias("n"))


def fold_trim(spark: SparkSession, d: str) -> DataFrame:
    """Rows left per test fold and role after trimming to the training rows' first and last percentile."""
    s = sample(spark, d).withColumn("fold", F.dayofmonth("snapshot_date"))
    return models.fold_trim(cut(s.select("fold", "log_price")), "log_price", "fold").groupBy("test_fold", "role").agg(F.count("*").alias("n"))


FOLD_TRIM = f"""
with {SAMPLE_CTE}, s as (select day(snapshot_date) as fold, log_price from sample), f as (select distinct fold as test_fold from s),
q as (select test_fold, quantile_cont(log_price, 0.01) as a, quantile_cont(log_price, 0.99) as b from f join s on s.fold <> f.test_fold group by 1)
select cast(test_fold as int) as test_fold, case when s.fold <> test_fold then 'train' else 'test' end as role, count(*) as n from q join s on s.log_price between a and b group by 1, 2
"""


def support_range(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out area: rows outside the range of the other areas' values."""
    s = cut(sample(spark, d).select("area", "km", "accommodates"))
    long = wide_to_long(s, ["area"], ["km", "accommodates"]).where("value is not null")
    ends = long.groupBy("area", "variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    others = ends.alias("a").join(ends.alias("b"), (F.col("a.variable") == F.col("b.variable")) & (F.col("a.area") != F.col("b.area")))
    train = others.groupBy(F.col("a.area").alias("area"), F.col("a.variable").alias("variable")).agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    return long.join(train, ["area", "variable"]).groupBy("area", "variable").agg(F.count("*").alias("n"), F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outside"))


SUPPORT_RANGE = f"""
with {SAMPLE_CTE}, l as (select area, 'km' as variable, km as value from sample where km is not null union all select area, 'accommodates', accommodates from sample where accommodates is not null),
e as (select area, variable, min(value) as lo, max(value) as hi from l group by 1, 2),
t as (select a.area, a.variable, min(b.lo) as lo, max(b.hi) as hi from e a join e b on a.variable = b.variable and a.area <> b.area group by 1, 2)
select l.area, l.variable, count(*) as n, count(*) filter (value < lo or value > hi) as outside from l join t using (area, variable) group by 1, 2
"""


def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of price and distance per area, average ranks of ties."""
    out = stats.spearman(sample(spark, d), "log_price", "km", ["area"])
    return out.select("area", "n", F.round("rho", 6).alias("rho"))


SPEARMAN = f"""
with {SAMPLE_CTE}, c as (select area, log_price, km from sample where km is not null),
r as (select area, rank() over (partition by area order by log_price) + (count(*) over (partition by area, log_price) - 1) / 2.0 as a,
             rank() over (partition by area order by km) + (count(*) over (partition by area, km) - 1) / 2.0 as b from c)
select area, count(*) as n, case when count(*) >= 30 then round(corr(cast(a as double), cast(b as double)), 6) end as rho from r group by 1
"""


def _valued_pois(spark: SparkSession, d: str) -> DataFrame:
    value = F.coalesce(F.length("name"), F.lit(0)).cast("double")
    pois = table(spark, d, "osm_pois").where("geom_25832 is not null")
    return pois.select("snapshot_date", F.col("destination_key").alias("id"), F.col("geom_25832.x").alias("x"), F.col("geom_25832.y").alias("y"), value.alias("value"))


def _neighbours(pts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    other = pts.select(F.col("id").alias("other_id"), F.col("x").alias("other_x"), F.col("y").alias("other_y"), *keys)
    return spatial.k_nearest(pts.select("id", "x", "y", *keys), other, 8, 500.0, exclude_same_id=True, keys=keys).select("id", "other_id", *keys)


def moran_i(spark: SparkSession, d: str) -> DataFrame:
    """Spatial autocorrelation of a value over eight nearest neighbours, for every snapshot."""
    pts = cut(_valued_pois(spark, d))
    out = stats.morans_i(pts.select("id", "value", "snapshot_date"), cut(_neighbours(pts, ["snapshot_date"])), ["snapshot_date"])
    return out.select("snapshot_date", "n", F.round("i", 6).alias("i"), F.round("expected", 8).alias("expected"))


_VALUED_SQL = "p as (select snapshot_date, destination_key as id, geom_25832.x as x, geom_25832.y as y, cast(coalesce(length(name), 0) as double) as value from osm_pois where geom_25832 is not null)"
MORAN_I = f"""
with {_VALUED_SQL}, m as (select snapshot_date, avg(value) as m from p group by 1), z as (select p.*, value - m as z from p join m using (snapshot_date)),
nn as (select * from (select a.id, b.z, row_number() over (partition by a.snapshot_date, a.id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) as k from z a join z b on a.snapshot_date = b.snapshot_date and a.id <> b.id) where k <= 8),
lag as (select id, avg(z) as lag from nn group by 1)
select snapshot_date, count(*) as n, round(sum(z * lag) / sum(z ** 2), 6) as i, round(-1.0 / (count(*) - 1), 8) as expected from z join lag using (id) group by 1
"""


def moran_p(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided permutation p of the same statistic for every snapshot."""
    pts = cut(_valued_pois(spark, d))
    return stats.moran_permutation_p(pts.select("id", "value", "snapshot_date"), cut(_neighbours(pts, ["snapshot_date"])), keys=["snapshot_date"])


def distance_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean standardised cross-products of all pairs to 8 km by distance, for every snapshot."""
    pts = cut(_valued_pois(spark, d))
    moments = pts.groupBy("snapshot_date").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scored = cut(pts.join(moments, "snapshot_date").select("snapshot_date", "id", "x", "y", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("z1")))
    right = scored.select("snapshot_date", F.col("id").alias("other_id"), F.col("x").alias("other_x"), F.col("y").alias("other_y"), F.col("z1").alias("z2"))
    pairs = spatial.within_distance(scored, right, BINS[-1], ["snapshot_date"], ROWS_PER_SALT).where("id < other_id")
    out = stats.distance_bins(pairs, BINS, ["snapshot_date"])
    return out.select("snapshot_date", "lower", "upper", "n", F.round("mean_product", 6).alias("mean_product"))


DISTANCE_BINS = f"""
with {_VALUED_SQL}, m as (select snapshot_date, avg(value) as m, stddev_pop(value) as s from p group by 1), z as (select p.*, (value - m) / s as z from p join m using (snapshot_date)),
d as (select a.snapshot_date, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist, a.z * b.z as product from z a join z b on a.snapshot_date = b.snapshot_date and a.id < b.id),
b(lower, upper) as (values {", ".join(f"(cast({a} as double), cast({b} as double))" for a, b in zip(BINS, BINS[1:]))})
select snapshot_date, lower, upper, count(*) as n, round(avg(product), 6) as mean_product from d join b on dist >= lower and dist < upper group by 1, 2, 3
"""


def vif(spark: SparkSession, d: str) -> DataFrame:
    """Variance inflation of two regressors."""
    return stats.vif(sample(spark, d), ["accommodates", "bedrooms"]).select("variable", F.round("vif", 6).alias("vif"))


VIF = f"""
with {SAMPLE_CTE}, r as (select 1 / (1 - corr(accommodates, bedrooms) ** 2) as v from sample where bedrooms is not null)
select 'accommodates' as variable, round(v, 6) as vif from r union all select 'bedrooms', round(v, 6) from r
"""


def ols_fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold errors of a one-regressor model by held-out snapshot."""
    s = cut(sample(spark, d).withColumn("fold", F.dayofmonth("snapshot_date")).where("km is not null"))
    scored = models.cross_validated_ols(s, ["km"], "log_price", "fold")
    out = models.metrics(scored, ["fold"], "log_price", "estimate")
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


OLS_FOLD_METRICS = f"""
with {SAMPLE_CTE}, s as (select day(snapshot_date) as fold, km, log_price as y from sample where km is not null), f as (select distinct fold as test_fold from s),
b as (select test_fold, regr_slope(y, km) as slope, regr_intercept(y, km) as icpt from f join s on s.fold <> f.test_fold group by 1),
e as (select s.fold, y, y - (icpt + slope * km) as e from s join b on s.fold = b.test_fold)
select cast(fold as int) as fold, count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) as r2 from e group by 1
"""


def train_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = cut(sample(spark, d).withColumn("fold", F.dayofmonth("snapshot_date")))
    out = models.metrics(models.training_mean(s, "log_price", "fold"), ["fold"], "log_price", "estimate")
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


TRAIN_MEAN_BASELINE = f"""
with {SAMPLE_CTE}, s as (select day(snapshot_date) as fold, log_price as y from sample), f as (select distinct fold as test_fold from s),
b as (select test_fold, avg(y) as m from f join s on s.fold <> f.test_fold group by 1), e as (select fold, y, y - m as e from s join b on fold = test_fold)
select cast(fold as int) as fold, count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) as r2 from e group by 1
"""


def ols_hc3(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients with heteroskedasticity-robust errors."""
    out = models.hc3(sample(spark, d).where("km is not null"), ["km"], "log_price")
    return out.select("term", *[F.round(c, 6).alias(c) for c in ("beta", "se", "low", "high", "effect_pct")])


OLS_HC3 = f"""
with {SAMPLE_CTE}, s as (select km as x, log_price as y from sample where km is not null),
b as (select regr_slope(y, x) as b1, regr_intercept(y, x) as b0, count(*) as n, avg(x) as mx, sum(x * x) as sxx0, sum(x) as sx from s),
g as (select *, n * sxx0 - sx * sx as det from b),
e as (select x, (y - b0 - b1 * x) / (1 - (sxx0 - 2 * x * sx + n * x * x) / det) as w, sxx0, sx, n, det, b0, b1 from s, g),
v as (select any_value(b0) as b0, any_value(b1) as b1, sum(w * w * ((sxx0 - sx * x) / det) ** 2) as v0, sum(w * w * ((n * x - sx) / det) ** 2) as v1 from e),
t as (select 'intercept' as term, b0 as beta, sqrt(v0) as se from v union all select 'km', b1, sqrt(v1) from v)
select term, round(beta, 6) as beta, round(se, 6) as se, round(beta - 1.959963984540054 * se, 6) as low, round(beta + 1.959963984540054 * se, 6) as high, round(100 * (exp(beta) - 1), 6) as effect_pct from t
"""


def ols_summary(spark: SparkSession, d: str) -> DataFrame:
    """Fit of the two-regressor model with imputed gaps, a missing indicator and room types as dummies."""
    s = cut(sample(spark, d))
    prep = models.FoldPreprocessing(["accommodates", "bedrooms", "km"], ["room_type"]).fit(s)
    out = models.fit_summary(prep.transform(s).select("log_price", *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(prep.columns)]), [f"v{i}" for i in range(len(prep.columns))], "log_price")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("r2", "adj_r2", "aic", "bic")])


def grid_support(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles by area and room type, small groups held back."""
    out = stats.exact_percentiles(sample(spark, d), ["area", "room_type"], "log_price", (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    return out.where("n >= 5").select("area", "room_type", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


GRID_SUPPORT = f"""
with {SAMPLE_CTE} select area, room_type, count(*) as n, round(quantile_cont(log_price, 0.25), 6) as q1, round(quantile_cont(log_price, 0.5), 6) as median, round(quantile_cont(log_price, 0.75), 6) as q3
from sample group by 1, 2 having count(*) >= 5
"""


def analysis_view(spark: SparkSession, d: str) -> DataFrame:
    """One row per listing and snapshot: area names and raw record counts joined to the sample, with derived columns."""
    areas = table(spark, d, "official_areas").select(F.col("official_cv_area_id").alias("area"), F.col("navn").alias("area_name"))
    raw = table(spark, d, "listings").select(F.expr("try_cast(id as bigint)").alias("listing_id"), "snapshot_date").where("listing_id is not null").groupBy("listing_id", "snapshot_date").agg(F.count("*").alias("records"))
    s = sample(spark, d).join(areas, "area", "left").join(raw, ["listing_id", "snapshot_date"], "left")
    return s.select(KEY, "area", F.replace("area_name", F.lit("/"), F.lit("-")).alias("area_name"), F.round("log_price", 6).alias("log_price"), F.coalesce("records", F.lit(0)).alias("records"),
                    F.round(F.log1p("km"), 6).alias("log1p_km"), geo.cell(F.col("km") * 1000, 500).alias("ring"))


ANALYSIS_VIEW = f"""
with {SAMPLE_CTE}, raw as (select try_cast(id as bigint) as listing_id, snapshot_date, count(*) as records from listings where try_cast(id as bigint) is not null group by 1, 2)
select row_key, area, replace(navn, '/', '-') as area_name, round(log_price, 6) as log_price, coalesce(records, 0) as records, round(ln(1 + km), 6) as log1p_km, cast(floor(km * 1000 / 500) as bigint) as ring
from sample left join official_areas on area = official_cv_area_id left join raw using (listing_id, snapshot_date)
"""


def freeze_digest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and an order-free digest of the fold assignment: equal for equal assignments."""
    n, digest = content_digest(folds.area_folds(sample(spark, d), KEY, "area"))
    return spark.createDataFrame([(n, str(digest))], "n long, digest string")


QUERIES = {
    q.__name__: q
    for q in (
        fold_area, fold_random, fold_grouped, fold_hashed, fold_trim, support_range, spearman, moran_i, moran_p, distance_bins, vif, ols_fold_metrics,
        train_mean_baseline, ols_hc3, ols_summary, grid_support, analysis_view, freeze_digest,
    )
}
SQL = {
    "fold_area": FOLD_AREA, "fold_random": FOLD_RANDOM, "fold_trim": FOLD_TRIM, "support_range": SUPPORT_RANGE, "spearman": SPEARMAN, "moran_i": MORAN_I, "distance_bins": DISTANCE_BINS,
    "vif": VIF, "ols_fold_metrics": OLS_FOLD_METRICS, "train_mean_baseline": TRAIN_MEAN_BASELINE, "ols_hc3": OLS_HC3, "grid_support": GRID_SUPPORT, "analysis_view": ANALYSIS_VIEW,
}
