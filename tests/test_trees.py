"""Boosted trees on sums against trees on rows, and against Spark's estimator."""

import random

from pyspark.sql import functions as F

from geoskein.operators import models, trees_on_cells


def _rows(spark, n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a, b = rng.randrange(20) / 2, float(rng.randrange(1, 6))  # few values: the same thresholds for both
        rows.append((i, i % 4, a, b, 2.0 * (a > 4) + 0.5 * b + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "i int, fold int, a double, b double, y double")


def test_sums_fit_as_well_as_rows_without_a_fit_over_rows(spark, monkeypatch):
    df = _rows(spark)
    by_rows = {r.fold: r.rmse for r in models.metrics(models._boosted_by_rows(df, ["a", "b"], "y", "fold", (2, 3), 8, 7), ["fold"], "y", "estimate").collect()}
    monkeypatch.setattr(models, "_boosted_by_rows", None)  # failed before: each level of each tree passed over the rows
    scored = models.boosted_trees(df, ["a", "b"], "y", "fold", trees=8, seed=7)
    got = {r.fold: (r.n, r.rmse) for r in models.metrics(scored, ["fold"], "y", "estimate").collect()}
    assert sorted(got) == sorted(by_rows) and all(n == 750 for n, _ in got.values())
    # both draw rows by chance: on 2,250 rows the folds differ by up to a tenth, the target itself varies by 1.2
    assert all(abs(got[f][1] - by_rows[f]) < 0.15 * by_rows[f] for f in got), (got, by_rows)
    assert scored.columns == [*df.columns, "estimate", "depth"]


def test_held_out_rows_do_not_matter(spark):
    df = _rows(spark, 400)
    other = df.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * 100).otherwise(F.col("y")))
    one, two = ({r.i: r.estimate for r in models.boosted_trees(d, ["a", "b"], "y", "fold", trees=3).where("fold = 2").collect()} for d in (df, other))
    assert one == two


def test_many_cells_fall_back_to_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "_boosted_by_rows", lambda complete, *_: complete.withColumn("estimate", F.lit(0.0)))
    assert models.boosted_trees(_rows(spark, 100), ["a"], "y", "fold", trees=1, most_cells=5).count() == 100


def test_thresholds():
    assert trees_on_cells.thresholds([(1.0, 5), (3.0, 1), (2.0, 1)]) == [1.5, 2.5]
    even = trees_on_cells.thresholds([(float(i), 1) for i in range(320)])
    assert len(even) == 31 and even[:2] == [9.5, 19.5]
