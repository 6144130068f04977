"""Linear models by distributed sums: fold preprocessing, least squares, robust errors, metrics.

Only k x k matrices come to the driver.  Columns are standardised in the sums' numerics by double precision alone, as
the reference data are well scaled; a rank-deficient system gets the solution of least norm.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoskein.operators import trees_on_cells as cells
from geoskein.operators.stats import exact_percentiles
from geoskein.plans.session import cut

#: Sums of one aggregate; wider designs go in several passes over the cached rows.
SUMS_PER_PASS = 400
#: Share of the rows that each boosted tree draws, and the weight of each tree after the first.
SUBSAMPLE, LEARNING_RATE = 0.85, 0.1


def gram(df: DataFrame, columns: Sequence[str], target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n with an intercept in front, from one aggregate."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    w = F.lit(1.0) if weight is None else weight
    y = F.col(target).cast("double")
    k = len(terms)
    sums: list[Column] = [F.count("*").alias("n"), F.sum(w * y * y).alias("yy")]
    sums += [F.sum(w * terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(w * terms[i] * y).alias(f"y{i}") for i in range(k)]
    got: dict = {}
    for at in range(0, len(sums), SUMS_PER_PASS):
        got |= df.agg(*sums[at : at + SUMS_PER_PASS]).first().asDict()
    xx, xy = np.zeros((k, k)), np.array([got[f"y{i}"] or 0.0 for i in range(k)])
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[f"x{i}_{j}"] or 0.0
    return xx, xy, got["yy"] or 0.0, got["n"]


def ols(df: DataFrame, columns: Sequence[str], target: str) -> np.ndarray:
    """Intercept and coefficients over complete rows."""
    xx, xy, _, _ = gram(df.dropna(subset=[*columns, target]), columns, target)
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def predicted(columns: Sequence[str], beta: Sequence[float]) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(columns, beta[1:]):
        out = out + F.col(c).cast("double") * float(b)
    return out


def metrics(scored: DataFrame, groups: Sequence[str], target: str, estimate: str) -> DataFrame:
    """(groups..., n, rmse, mae, r2): R2 against the mean of the evaluated rows; NULL without variance."""
    e = F.col(target) - F.col(estimate)
    out = scored.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"), F.var_pop(target).alias("_v")
    )
    return out.select(*groups, "n", "rmse", "mae", F.when(F.col("_v") > 0, 1 - F.col("_sse") / (F.col("n") * F.col("_v"))).alias("r2"))


def cross_validated_ols(df: DataFrame, columns: Sequence[str], target: str, fold: str) -> DataFrame:
    """Each row with the prediction of the model that did not see its fold.

    The sums of every fold are taken once; a training set is the total less one fold.
    """
    complete = df.dropna(subset=[*columns, target, fold])
    folds = sorted(r[0] for r in complete.select(fold).distinct().collect())
    grams = {f: gram(complete.where(F.col(fold) == f), columns, target) for f in folds}
    xx, xy = sum(g[0] for g in grams.values()), sum(g[1] for g in grams.values())
    estimate = F.lit(None).cast("double")
    for f in folds:
        beta = np.linalg.lstsq(xx - grams[f][0], xy - grams[f][1], rcond=None)[0]
        estimate = F.when(F.col(fold) == f, predicted(columns, beta)).otherwise(estimate)
    return complete.withColumn("estimate", estimate)


def training_mean(df: DataFrame, target: str, fold: str) -> DataFrame:
    """Each row with the mean of the other folds."""
    per = df.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("c")).collect()
    total, n = sum(r["s"] or 0.0 for r in per), sum(r["c"] for r in per)
    estimate = F.lit(None).cast("double")
    for r in per:
        if n > r["c"]:
            estimate = F.when(F.col(fold) == r[fold], F.lit(float((total - (r["s"] or 0.0)) / (n - r["c"])))).otherwise(estimate)
    return df.withColumn("estimate", estimate)


def hc3(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Coefficients with HC3 standard errors, normal 95 % intervals, p-values and the effect 100 * expm1(beta)."""
    complete = df.dropna(subset=[*columns, target])
    xx, xy, yy, n = gram(complete, columns, target)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    leverage = F.lit(0.0)
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            if j >= i:
                leverage = leverage + a * b * float(inverse[i, j] * (1 if i == j else 2))
    weighed = complete.withColumn("_h", leverage).withColumn("_e", F.col(target) - predicted(columns, beta)).withColumn("_w", F.pow(F.col("_e") / (1 - F.col("_h")), 2))
    meat, _, _, _ = gram(weighed, columns, target, F.col("_w"))
    error = np.sqrt(np.clip(np.diag(inverse @ meat @ inverse), 0, None))
    rows = []
    for name, b, se in zip(["intercept", *columns], beta, error):
        z = b / se if se > 0 else math.inf
        p = math.erfc(abs(z) / math.sqrt(2))
        rows.append((name, float(b), float(se), float(b - 1.959963984540054 * se), float(b + 1.959963984540054 * se), float(p), float(100 * math.expm1(b))))
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, low double, high double, p double, effect_pct double")


def fit_summary(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(n, r2, adj_r2, aic, bic, condition) of the full-sample fit."""
    xx, xy, yy, n = gram(df.dropna(subset=[*columns, target]), columns, target)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    sse = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    sst = float(yy - xy[0] ** 2 / n)
    k = len(columns)
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    row = (int(n), 1 - sse / sst, 1 - (sse / (n - k - 1)) / (sst / (n - 1)), -2 * loglik + 2 * (k + 1), -2 * loglik + math.log(n) * (k + 1), float(math.sqrt(np.linalg.cond(xx))))
    return df.sparkSession.createDataFrame([row], "n long, r2 double, adj_r2 double, aic double, bic double, condition double")


class FoldPreprocessing:
    """Learned on training rows: exact medians, an indicator for columns that had gaps, dummies without the first category.

    Unknown categories give zeros.  A column that is empty in training is filled with 0.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], most_categories: int = 10_000) -> None:
        self.numeric, self.categorical, self.most = list(numeric), list(categorical), most_categories
        self.medians: Mapping[str, float] = {}
        self.gaps: list[str] = []
        self.categories: dict[str, list] = {}

    def fit(self, train: DataFrame) -> "FoldPreprocessing":
        medians = {}
        for c in self.numeric:
            row = exact_percentiles(train.select(c), [], c, [0.5], ["m"]).first() if not train.select(c).dropna().isEmpty() else None
            medians[c] = float(row["m"]) if row else 0.0
        self.medians = medians
        gaps = train.agg(*[F.max(F.col(c).isNull()).alias(c) for c in self.numeric]).first() if self.numeric else {}
        self.gaps = [c for c in self.numeric if gaps[c]]
        for c in self.categorical:
            found = [r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().limit(self.most + 1).collect()]
            if len(found) > self.most:
                raise ValueError(f"{c} has more than {self.most} categories")
            self.categories[c] = sorted(found)
        return self

    @property
    def columns(self) -> list[str]:
        dummies = [f"{c}={v}" for c in self.categorical for v in self.categories[c][1:]]
        return [*self.numeric, *[f"{c}__missing" for c in self.gaps], *dummies]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"{c}__missing": F.col(c).isNull().cast("double") for c in self.gaps}
        new |= {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c in self.categorical for v in self.categories[c][1:]}
        return df.withColumns(new).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric})


def fold_trim(df: DataFrame, column: str, fold: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(…, test_fold, role): for every fold, its training and test rows within the training rows' percentiles."""
    out = None
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train = F.col(fold) != f
        row = exact_percentiles(df.where(train), [], column, (low, high), ("a", "b")).first()
        if row is None:
            continue
        part = df.where(F.col(column).between(row.a, row.b)).withColumn("test_fold", F.lit(f)).withColumn("role", F.when(train, "train").otherwise("test"))
        out = part if out is None else out.unionByName(part)
    return out


def scenarios(df: DataFrame, named: Mapping[str, Column], columns: Sequence[str], target: str) -> DataFrame:
    """(scenario, n, term, beta) of the least-squares fit on each named subset; one aggregate per scenario."""
    rows = []
    for name, condition in named.items():
        xx, xy, _, n = gram(df.where(condition).dropna(subset=[*columns, target]), columns, target)
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0] if n else [None] * (len(columns) + 1)
        rows += [(name, int(n), term, None if b is None else float(b)) for term, b in zip(["intercept", *columns], beta)]
    return df.sparkSession.createDataFrame(rows, "scenario string, n long, term string, beta double")


def boosted_trees(df: DataFrame, columns: Sequence[str], target: str, fold: str, depths: Sequence[int] = (2, 3), trees: int = 20, seed: int = 20260929, most_cells: int = 300_000) -> DataFrame:
    """Each row with the out-of-fold estimate of gradient-boosted trees; the depth is chosen inside each training set.

    The inner choice holds out the next fold, so no row is scored by a model or a choice that saw it.  A different
    estimator from other boosting libraries: results are not comparable with theirs digit by digit.

    Trees split by the thresholds of at most ``trees_on_cells.BINS`` bins a column, so rows between the same thresholds
    of all training sets can't be told apart.  They are summed up per fold and tree, each tree with its own draw of rows,
    in one pass; all models are fitted on these sums (``trees_on_cells``) and applied in another.  Many wide columns can
    give more than ``most_cells`` sums: then Spark's estimator fits the rows themselves.
    """
    complete = cut(df.dropna(subset=[*columns, target, fold]))
    x = [F.col(c).cast("double") for c in columns]
    names, y = [f"_x{i}" for i in range(len(columns))], F.col("_y")
    rows = complete.select(F.col(fold).alias("_f"), F.col(target).cast("double").alias("_y"), *[c.alias(n) for c, n in zip(x, names)])
    values = {}
    for n in names:  # at most QUANTILES values a fold: all of them where they are so few
        few = rows.groupBy("_f").agg(F.count("*").alias("n"), F.approx_count_distinct(n).alias("d")).collect()
        if max((r.d for r in few), default=0) < cells.BINS * 4:
            values[n] = [(r["_f"], r[n], r["n"]) for r in rows.groupBy("_f", n).agg(F.count("*").alias("n")).collect()]
        else:
            shares = [(i + 0.5) / cells.QUANTILES for i in range(cells.QUANTILES)]
            per = rows.groupBy("_f").agg(F.count("*").alias("n"), F.percentile_approx(n, shares, 10_000).alias("q")).collect()
            values[n] = [(r["_f"], v, r["n"] / cells.QUANTILES) for r in per for v in r["q"]]
    held = sorted({f for f, _, _ in values[names[0]]})
    sets = cells.training_sets(held)
    cuts = {s: [cells.thresholds([(v, w) for f, v, w in values[n] if f not in s]) for n in names] for s in sets}
    grid = [sorted({t for c in cuts.values() for t in c[i]}) for i in range(len(names))]
    # the number of a value's interval: how many thresholds lie below it
    binned = [_below(F.col(n), g).alias(f"_b{i}") for i, (n, g) in enumerate(zip(names, grid))]
    drawn = [(F.rand(seed + t) < SUBSAMPLE).alias(f"_d{t}") for t in range(trees)]
    sums = [F.count("*").alias("n"), F.sum("_y").alias("s"), F.sum(y * y).alias("q")]
    sums += [a for t in range(trees) for a in (F.count_if(f"_d{t}").alias(f"n{t}"), F.sum(F.when(F.col(f"_d{t}"), y)).alias(f"s{t}"))]
    by = ["_f", *[f"_b{i}" for i in range(len(names))]]
    summed = rows.select("_f", "_y", *binned, *drawn).groupBy(*by).agg(*sums)
    summed = summed.limit(most_cells + 1).collect()
    if len(summed) > most_cells:
        return _boosted_by_rows(complete, columns, target, fold, depths, trees, seed)
    out = F.lit(None).cast("double")
    depth = F.lit(None).cast("int")
    table = cells.Cells(summed, [f"_b{i}" for i in range(len(names))], grid, trees)
    for i, f in enumerate(held if len(held) > 1 else ()):
        inner = held[(i + 1) % len(held)]
        chosen = depths[0]
        if len(held) > 2:
            chosen = min(depths, key=lambda k: (table.error(table.fit({f, inner}, cuts[frozenset({f, inner})], k, LEARNING_RATE), inner), k))
        model = table.fit({f}, cuts[frozenset({f})], chosen, LEARNING_RATE)
        out = F.when(F.col(fold) == f, cells.expression(model, x)).otherwise(out)
        depth = F.when(F.col(fold) == f, F.lit(chosen)).otherwise(depth)
    return complete.withColumn("estimate", out).withColumn("depth", depth)


def _boosted_by_rows(complete: DataFrame, columns: Sequence[str], target: str, fold: str, depths: Sequence[int], trees: int, seed: int) -> DataFrame:
    """The same models by Spark's own estimator, which passes over the rows for each level of each tree."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(complete).cache()
    folds = sorted(r[0] for r in ready.select(fold).distinct().collect())
    out = None
    for i, held in enumerate(folds):
        train, inner = ready.where(F.col(fold) != held), folds[(i + 1) % len(folds)]

        def model(rows: DataFrame, depth: int):
            return GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="estimate", maxDepth=depth, maxIter=trees, stepSize=LEARNING_RATE, subsamplingRate=SUBSAMPLE, seed=seed).fit(rows)

        def error(depth: int) -> float:
            fitted = model(train.where(F.col(fold) != inner), depth)
            return fitted.transform(train.where(F.col(fold) == inner)).agg(F.avg(F.pow(F.col(target) - F.col("estimate"), 2))).first()[0]

        depth = min(depths, key=lambda k: (error(k), k)) if len(folds) > 2 else depths[0]
        scored = model(train, depth).transform(ready.where(F.col(fold) == held)).drop("_x").withColumn("depth", F.lit(depth))
        out = scored if out is None else out.unionByName(scored)
    return out


def _below(value: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds lie below the value, by halving."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= thresholds[mid], part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(thresholds))


def permutation_importance(scored: DataFrame, columns: Sequence[str], beta: Sequence[float], target: str, seed: int = 20260929) -> DataFrame:
    """(variable, rmse_rise): the rise of a linear model's error when one column takes the values of other rows.

    Values are exchanged by a shift over a hash order within partitions, so no global sort is needed.
    """
    base = scored.withColumn("_e", F.col(target) - predicted(columns, beta))
    rmse = base.agg(F.sqrt(F.avg(F.col("_e") * F.col("_e")))).first()[0]
    rows = []
    for i, c in enumerate(columns):
        w = Window.partitionBy(F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(64))).orderBy(F.xxhash64(*columns, F.lit(seed + 1)))
        moved = base.withColumn("_p", F.coalesce(F.lead(c).over(w), F.first(c).over(w)))
        e = F.col("_e") + (F.col(c) - F.col("_p")) * float(beta[i + 1])
        rows.append((c, float(moved.agg(F.sqrt(F.avg(e * e))).first()[0] - rmse)))
    return scored.sparkSession.createDataFrame(rows, "variable string, rmse_rise double")
