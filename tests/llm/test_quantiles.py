import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.llm import quantiles as Q


@pytest.mark.parametrize("shape", ["uniform", "skewed", "ties", "sorted"])
def test_bounds_hold_after_merging(shape):
    rng = np.random.default_rng(7)
    data = {"uniform": rng.random(40_000), "skewed": rng.lognormal(0, 2, 40_000), "ties": rng.integers(0, 5, 40_000).astype(float), "sorted": np.arange(40_000.0)}[shape]
    whole = Q.Sketch(64)
    for part in np.array_split(data, 37):
        s = Q.Sketch(64)
        for piece in np.array_split(part, 3):
            s.add(piece)
        whole.merge(s)
        whole.collapse()
    assert whole.n == len(data)
    assert sum(len(b) << lv for lv, held in whole.buffers.items() for b in held) == len(data)
    assert max(whole.over, whole.under) < len(data) * 0.15
    for pct, (low, estimate, high) in zip((0, 1, 50, 90, 100), whole.brackets([0, 1, 50, 90, 100])):
        exact = np.percentile(data, pct)
        assert low <= exact <= high and low <= estimate <= high


def test_small_groups_are_exact():
    s = Q.Sketch(512)
    s.add(np.array([3.0, 1.0, 2.0, 10.0]))
    assert s.brackets([50, 90]) == [(2.5, 2.5, 2.5), (np.percentile([3, 1, 2, 10], 90),) * 3]


def test_spark_sketches_nulls_skew_and_exact_refinement(spark):
    rows = [("hot", 1, float(i % 997)) for i in range(6000)] + [("cold", 1, 5.0), ("cold", 1, None), (None, 1, 2.0), ("gone", 1, None), ("nan", 1, float("nan"))]
    df = spark.createDataFrame(rows, "area string, day int, v double").withColumnsRenamed({}).repartition(5)
    sketched = Q.sketches(df.selectExpr("*", "1 as n", "'x' as levels"), ["area", "day"], ["v"], k=64).cache()
    got = {(r.area, r.pct): r for r in Q.percentiles(sketched, ["area", "day"], [50, 90], k=64).collect()}
    assert {k[0] for k in got} == {"hot", "cold", None}
    hot = [x[2] for x in rows if x[0] == "hot"]
    for pct in (50, 90):
        assert got["hot", pct].low <= np.percentile(hot, pct) <= got["hot", pct].high
    asked = Q.percentiles(sketched, ["area", "day"], [50, 90], k=64).select("area", "day", "field_name", "pct", "n", "low", "high")
    exact = {(r.area, r.pct): r.exact for r in Q.exact_percentiles(df, ["area", "day"], asked).collect()}
    assert exact["hot", 50] == np.percentile(hot, 50) and exact["hot", 90] == pytest.approx(np.percentile(hot, 90))
    assert exact["cold", 50] == 5.0 and exact[None, 90] == 2.0
    merged = Q.merge_to(sketched, ["day"], k=64)
    assert merged.first().n == 6002
    assert Q.percentiles(Q.sketches(df.limit(0), ["area"], ["v"]), ["area"], [50]).count() == 0


def _exact(spark, rows, partitions, k):
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    single = Q.percentiles(Q.sketches(df, ["g"], ["v"], k), ["g"], [1, 50, 90], k)
    got = Q.exact_percentiles(df, ["g"], single.select("g", "field_name", "pct", "n", "low", "high"), k)
    return {(r.g, r.pct): r.exact for r in got.collect()}


def test_narrowing_is_exact_for_any_partitioning(spark):
    """Ties at the ends of brackets, two-valued groups, a NULL group; sketches far too small to decide at once."""
    rng = np.random.default_rng(17)
    groups = {"a": rng.normal(size=3000).tolist(), "b": [1.0] * 700 + [2.0] * 701, "c": np.round(rng.exponential(5, 2000)).tolist(), None: [5.0, 7.0, 7.0], "d": [3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    want = {(g, p): float(np.percentile(vs, p)) for g, vs in groups.items() for p in (1, 50, 90)}
    for partitions in (1, 7):
        got = _exact(spark, rows, partitions, 16)
        assert set(got) == set(want)
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_bound_follows_the_tree(spark, partitions):
    n, k = 60_000, 128
    df = spark.range(n).select(F.lit("x").alias("g"), (F.xxhash64("id") % 10**6).cast("double").alias("v")).repartition(partitions)
    row = Q.percentiles(Q.sketches(df, ["g"], ["v"], k), ["g"], [50], k).first()
    assert row.n == n and row.rank_error <= n * (1 + (1 + np.log2(partitions)) / 2) / k + 2 * k
