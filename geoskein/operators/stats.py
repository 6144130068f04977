"""Descriptive, correlation and spatial statistics, exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.operators.relational import wide_to_long
from geoskein.plans.session import cut, ship


BINS = 1024


def exact_percentiles(df: DataFrame, groups: Sequence[str], column: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(groups..., n, names...): exact interpolated percentiles of non-NULL values, without gathering a group in one task.

    Rows become counts per distinct value, spread over (group, value).  A histogram of at most ``BINS`` bins per group
    tells which bins hold the ranks asked for; only the distinct values of those bins are ranked.  Bins are even on a
    scale that is linear around the middle half of the distinct values and logarithmic beyond, so that single absurd
    values don't press all others into one bin.
    """
    value = F.col(column).cast("double")
    counts = df.select(*groups, value.alias("_v")).where("_v is not null and not isnan(_v)").groupBy(*groups, "_v").agg(F.count("*").alias("_c"))
    counts = cut(counts)
    null_safe = list(groups)
    middle = F.percentile_approx("_v", [0.25, 0.5, 0.75], 1000).alias("_m")
    ends = counts.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"), middle)

    def joined(left: DataFrame, right: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in [*null_safe, *extra]})
        on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*null_safe, *extra]]
        return left.join(renamed, on if on else F.lit(True)).drop(*[f"_r_{c}" for c in [*null_safe, *extra]])

    if not groups:
        row = ends.first()
        binned = counts.withColumns({"_lo": F.lit(row["_lo"]), "_hi": F.lit(row["_hi"]), "n": F.lit(row["n"]), "_m": F.lit(row["_m"])})
    else:
        binned = joined(counts, ends)
    spread = F.greatest(F.col("_m")[2] - F.col("_m")[0], F.abs(F.col("_m")[1]) * 1e-9, F.lit(1e-300))
    scaled = lambda c: F.asinh((F.col(c) - F.col("_m")[1]) / spread)
    width = F.when(F.col("_hi") > F.col("_lo"), (scaled("_v") - scaled("_lo")) / (scaled("_hi") - scaled("_lo")) * (BINS - 1)).otherwise(0.0)
    binned = binned.withColumn("_b", F.floor(F.coalesce(F.nanvl(width, F.lit(0.0)), F.lit(0.0))).cast("int")).drop("_lo", "_hi", "_m")
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    histogram = binned.groupBy(*groups, "_b", "n").agg(F.sum("_c").alias("_bc"))  # at most BINS rows a group
    histogram = histogram.withColumn("_end", F.sum("_bc").over(w.orderBy("_b"))).withColumn("_start", F.col("_end") - F.col("_bc"))
    asked = [[F.floor((F.col("n") - 1) * p) + 1, F.ceil((F.col("n") - 1) * p) + 1] for p in shares]
    wanted = F.lit(False)
    for pair in asked:
        for rank in pair:
            wanted = wanted | ((rank > F.col("_start")) & (rank <= F.col("_end")))
    chosen = histogram.where(wanted).select(*groups, "_b", "_start")
    inside = joined(binned, chosen, ["_b"])
    per_bin = Window.partitionBy(*groups, "_b").orderBy("_v")
    ranked = inside.withColumn("_upto", F.col("_start") + F.sum("_c").over(per_bin)).withColumn("_from", F.col("_upto") - F.col("_c"))
    found = []
    for i, pair in enumerate(asked):
        for j, rank in enumerate(pair):
            found.append(F.min(F.when((rank <= F.col("_upto")) & (rank > F.col("_from")), F.col("_v"))).alias(f"_q{i}_{j}"))
    out = ranked.groupBy(*groups, "n").agg(*found)
    parts = []
    for i, (p, name) in enumerate(zip(shares, names)):
        position = (F.col("n") - 1) * p
        part = position - F.floor(position)
        parts.append((F.col(f"_q{i}_0") + (F.col(f"_q{i}_1") - F.col(f"_q{i}_0")) * part).alias(name))
    return out.select(*groups, "n", *parts)


def descriptives(df: DataFrame, groups: Sequence[str], columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Per group and variable: n, observed, missing, mean, sample deviation, extremes and exact interpolated percentiles."""
    long = wide_to_long(df, groups, columns)
    by = [*groups, "variable"]
    moments = long.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("value").alias("n_observed"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    names = ("p05", "q1", "median", "q3", "p95")
    q = exact_percentiles(long, by, "value", (0.05, 0.25, 0.5, 0.75, 0.95), names).drop("n")
    q = q.withColumnsRenamed({c: f"_r_{c}" for c in by})
    out = moments.join(q, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by], "left")
    rounded = [F.round(c, digits).alias(c) for c in ("mean", "sd", "min", "max", *names)]
    return out.select(*by, "n", "n_observed", "n_missing", *rounded)


def quantile_bins(df: DataFrame, column: str, label: str = "bin") -> DataFrame:
    """Right-closed quartile labels Q1..Q4 (the lowest value belongs to Q1); NULL values have no bin."""
    row = exact_percentiles(df, [], column, (0.25, 0.5, 0.75), ("a", "b", "c")).first()
    c = F.col(column)
    if row is None:
        return df.withColumn(label, F.lit(None).cast("string"))
    return df.withColumn(label, F.when(c <= row.a, "Q1").when(c <= row.b, "Q2").when(c <= row.c, "Q3").when(c.isNotNull(), "Q4"))


def composition(df: DataFrame, groups: Sequence[str], category: Column, label: str) -> DataFrame:
    """Share of each category per group; NULL is 'unassigned'."""
    counted = df.groupBy(*groups, F.coalesce(category, F.lit("unassigned")).alias(label)).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*groups)) if groups else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("share", F.round(F.col("n") / total, 6))


def average_ranks(df: DataFrame, column: str, groups: Sequence[str], rank: str) -> DataFrame:
    """Average ranks of ties, from the counts of distinct values: no window over the rows themselves."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups).orderBy(column) if groups else Window.partitionBy(F.lit(1)).orderBy(column)
    ranked = counts.withColumn(rank, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return df.join(ranked, [*groups, column])


def _pearson(x: str, y: str) -> Column:
    """Pearson's correlation, NULL without variance (the built-in one fails there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), least: int = 30) -> DataFrame:
    """(groups..., n, rho) over complete pairs; NULL below ``least`` pairs or without variance."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y)
    ranked = average_ranks(average_ranks(pairs, x, groups, "_rx"), y, groups, "_ry")
    out = ranked.groupBy(*groups).agg(F.count("*").alias("n"), _pearson("_rx", "_ry").alias("rho"))
    return out.select(*groups, "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson over complete rows, from one pass of sums; k x k on the driver."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = complete.agg(*[_pearson(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.eye(len(columns))
    for i, j in pairs:
        if i != j:
            out[i, j] = out[j, i] = np.nan if row[f"c{i}_{j}"] is None else row[f"c{i}_{j}"]
    return out


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix; infinite where it is singular."""
    m = correlation_matrix(df, columns)
    singular = bool(np.isnan(m).any()) or np.linalg.matrix_rank(m) < len(columns)
    values = [float("inf")] * len(columns) if singular else np.diag(np.linalg.inv(m)).tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, map(float, values))), "variable string, vif double")


def missingness(df: DataFrame, dimensions: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """(dimension, group, variable, n, missing_n, missing_pct): one Expand over single dimensions, one aggregate."""
    sets = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unassigned")).alias("group")) for d in dimensions])
    long = df.select(F.explode(sets).alias("g"), *variables).select("g.dimension", "g.group", *variables)
    sums = long.groupBy("dimension", "group").agg(F.count("*").alias("n"), *[F.count_if(F.col(v).isNull()).alias(f"_m_{v}") for v in variables])
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"_m_{v}").alias("missing_n")) for v in variables])
    out = sums.select("dimension", "group", "n", F.explode(rows).alias("r")).select("dimension", "group", "r.variable", "n", "r.missing_n")
    return out.withColumn("missing_pct", F.round(100 * F.col("missing_n") / F.col("n"), 4))


def token_prevalence(df: DataFrame, array_text: str, tokens: Sequence[str], low: float = 5.0, high: float = 95.0) -> DataFrame:
    """(token, rows_with, prevalence_pct, usable, invalid_rows): rows whose JSON array of texts holds the token; malformed arrays are counted apart."""
    parsed = F.from_json(array_text, "array<string>")
    base = df.select(F.col(array_text).alias("_t"), F.array_distinct(parsed).alias("_a"))
    n = F.count("_t")
    sums = base.agg(n.alias("rows"), F.count_if(F.col("_t").isNotNull() & F.col("_a").isNull()).alias("invalid_rows"), *[F.count_if(F.array_contains("_a", t)).alias(f"t{i}") for i, t in enumerate(tokens)])
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"t{i}").alias("rows_with")) for i, t in enumerate(tokens)])
    out = sums.select("rows", "invalid_rows", F.explode(rows).alias("r")).select("r.token", "r.rows_with", "rows", "invalid_rows")
    pct = F.try_divide(100 * F.col("rows_with"), F.col("rows") - F.col("invalid_rows"))
    return out.withColumn("prevalence_pct", F.round(pct, 4)).withColumn("usable", (pct > low) & (pct < high)).drop("rows")


def morans_i(values: DataFrame, neighbours: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., n, i, expected) of Moran's I with row-standardised weights: ``values`` (id, value, keys...), ``neighbours`` (id, other_id, keys...).

    Each group of ``keys`` has a mean of its own; NULL keys belong to no group.
    """
    keys = list(keys)
    if keys:
        centred = values.join(values.groupBy(*keys).agg(F.avg("value").alias("_m")), keys)
        z = centred.select("id", *keys, (F.col("value") - F.col("_m")).alias("z"))
    else:
        mean = values.agg(F.avg("value")).first()[0]
        z = values.select("id", (F.col("value") - F.lit(float(mean or 0.0))).alias("z"))
    lag = neighbours.join(z.withColumnsRenamed({"id": "other_id", "z": "z_other"}), ["other_id", *keys]).groupBy("id", *keys).agg(F.avg("z_other").alias("lag"))
    joined = z.join(lag, ["id", *keys], "left")
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))), F.sum(F.col("z") * F.col("z"))).alias("i"))
    return out.select(*keys, "n", "i", F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("expected"))


def moran_permutation_p(values: DataFrame, neighbours: DataFrame, permutations: int = 499, seed: int = 20260929, most: int = 2_000_000, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., observed, p): two-sided p over values permuted within each group of ``keys``, each permutation with a seed of its own.

    The neighbour lists are held by every task, so the number of points is checked against ``most`` first.  Without
    variance both are NULL; NULL keys belong to no group.
    """
    spark = values.sparkSession
    ship(spark)
    keys = list(keys)
    values, neighbours = values.dropna(subset=keys) if keys else values, neighbours.dropna(subset=keys) if keys else neighbours
    if values.count() > most:
        raise ValueError(f"more than {most} points: the permutation test holds the points in each task")
    # Arrow columns, matched group by group: ids never become Python objects of the driver
    rows = values.select(*keys, "id", F.col("value").cast("double").alias("value")).orderBy(*keys, "id").toArrow()
    links = neighbours.select(*keys, "id", "other_id").toArrow()
    groups = sorted({tuple(r[c] for c in keys) for r in rows.select(keys).group_by(keys).aggregate([]).to_pylist()}) if keys else [()]
    parts = []
    for group in groups:
        own, linked = rows, links
        for c, v in zip(keys, group):
            own, linked = own.filter(pc.equal(own[c], v)), linked.filter(pc.equal(linked[c], v))
        ids = own["id"].combine_chunks()
        parts.append((own["value"].to_numpy(), *(pc.index_in(linked[c], value_set=ids).to_numpy() for c in ("id", "other_id"))))
    del rows, links
    held = spark.sparkContext.broadcast(parts)

    def statistic(v: np.ndarray, source: np.ndarray, target: np.ndarray) -> float:
        z = v - v.mean()
        count = np.bincount(source, minlength=len(v))
        lag = np.bincount(source, weights=z[target], minlength=len(v)) / np.maximum(count, 1)
        return float((z * lag).sum() / (z * z).sum()) if (z * z).sum() > 0 else float("nan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, (v, s, t) in enumerate(held.value):
                yield pd.DataFrame({"g": g, "i": [statistic(np.random.default_rng((seed, int(k))).permutation(v), s, t) for k in batch["id"]]})

    observed = [statistic(*part) for part in parts]
    null = cut(spark.range(permutations).repartition(min(permutations, 16)).mapInPandas(run, "g int, i double"))
    centres = dict(null.groupBy("g").agg(F.avg("i")).collect())
    schema = T.StructType([T.StructField("g", T.IntegerType()), *[values.schema[c] for c in keys], T.StructField("observed", T.DoubleType()), T.StructField("centre", T.DoubleType())])
    known = spark.createDataFrame([(g, *group, o, centres[g]) for g, (group, o) in enumerate(zip(groups, observed))], schema)
    beyond = F.count_if(F.abs(F.col("i") - F.col("centre")) >= F.abs(F.col("observed") - F.col("centre")))
    out = null.join(known, "g").groupBy("g", *keys, "observed").agg(beyond.alias("k"), F.count("*").alias("n"))
    return out.select(*keys, F.nanvl("observed", F.lit(None).cast("double")).alias("observed"), F.when(~F.isnan("observed"), (F.col("k") + 1) / (F.col("n") + 1)).alias("p"))


def distance_bins(pairs: DataFrame, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., lower, upper, n, mean_product) of standardised cross-products by distance [lower, upper): ``pairs`` (distance, z1, z2, keys...)."""
    d = F.col("distance")
    low = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:]):
        low = F.when((d >= a) & (d < b), F.lit(float(a))).otherwise(low)
    high = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:]):
        high = F.when((d >= a) & (d < b), F.lit(float(b))).otherwise(high)
    binned = pairs.select(*keys, low.alias("lower"), high.alias("upper"), (F.col("z1") * F.col("z2")).alias("product")).where("lower is not null")
    return binned.groupBy(*keys, "lower", "upper").agg(F.count("*").alias("n"), F.avg("product").alias("mean_product"))
