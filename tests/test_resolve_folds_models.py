import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.functions.text import _ascii_name, _folded_name
from geoskein.operators import folds, models, quality, relational, resolve, stats


def test_names():
    assert _folded_name("Kæde  STATION, Pub!") == _folded_name("ｋæｄｅ st. pub") == "kæde st pub"
    assert _folded_name(None) == _folded_name("") == "" and _ascii_name("Café Århus") == "cafe arhus"


def test_transitive_duplicates(spark):
    rows = [("node/5", 0.0, 0.0, "A"), ("node/2", 2.0, 0.0, "A"), ("node/9", 4.0, 0.0, "A"), ("node/3", 0.0, 0.0, "B"), ("node/6", 50.0, 0.0, None), ("node/7", 50.4, 0.0, ""), ("node/8", 51.5, 0.0, None), ("node/4", None, None, "A")]
    df = spark.createDataFrame(rows, "key string, x double, y double, name string")
    got = {r.key: (r.canonical_key, r.group_size) for r in resolve.transitive_duplicates(df).collect()}
    assert got == {"node/5": ("node/2", 3), "node/2": ("node/2", 3), "node/9": ("node/2", 3), "node/3": ("node/3", 1), "node/6": ("node/6", 2), "node/7": ("node/6", 2), "node/8": ("node/8", 1), "node/4": ("node/4", 1)}


def _greedy(rows):
    order = sorted(rows, key=lambda r: (r[1], resolve.TYPE_ORDER[r[2]], r[3]))
    chosen, out = [], {}
    for r in order:
        hits = []
        for c in chosen:
            if c[1] != r[1] or r[6] is None or c[6] is None:
                continue
            d = math.hypot(r[6] - c[6], r[7] - c[7])
            if r[5] and r[5] == c[5] and d <= resolve.WIKIDATA_METRES[r[1]] or r[4] and r[4] == c[4] and d <= resolve.NAME_METRES[r[1]]:
                hits.append(((resolve.TYPE_ORDER[c[2]], c[3]), c[0]))
        if hits:
            out[r[0]] = min(hits)[1]
        else:
            out[r[0]] = r[0]
            chosen.append(r)
    return out


def test_greedy_duplicates_against_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = []
    for i in range(220):
        x = None if i % 40 == 7 else rng.uniform(0, 400)
        rows.append((f"k{i}", rng.choice(["food_social", "cultural_tourist"]), rng.choice(["node", "way", "relation"]), i * 7 % 221, rng.choice(["", "a", "b", "c"]), rng.choice(["", "", "1", "2"]), x, rng.uniform(0, 60)))
    df = spark.createDataFrame(rows, "key string, category string, osm_type string, osm_id long, norm string, qid string, x double, y double")
    got = resolve.greedy_duplicates(df).cache()
    assert {r.key: r.canonical_key for r in got.collect()} == _greedy(rows)
    refs = resolve.merged_references(df, got).agg(F.sum("duplicate_count"), F.count("*")).first()
    assert refs[0] + refs[1] == len(rows)


def test_folds(spark):
    df = spark.createDataFrame([(f"k{i:04d}", f"b{i % 40}", "ab"[i % 3 == 0], "xyz"[i % 3]) for i in range(803)], "key string, block string, municipality string, area string")
    got = {r.key: r.fold for r in folds.random_folds(df, "key").collect()}
    want = np.empty(803, dtype=int)
    want[np.random.default_rng(folds.SEED).permutation(803)] = np.arange(803) % 5 + 1
    assert [got[k] for k in sorted(got)] == want.tolist()
    assert {r.key: r.fold for r in folds.area_folds(df, "key", "area").collect()}["k0001"] == 2
    grouped = df.join(folds.grouped_folds(df, "key", "block", "municipality"), "key").cache()
    assert grouped.count() == 803 and folds.split_groups(grouped, "fold", "block").count() == 0
    sizes = [r["count"] for r in grouped.groupBy("fold", "municipality").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2.5 * min(sizes) * 3
    assert folds.hashed_folds(df, "key").groupBy("fold").count().count() == 5


def test_linear_models_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -0.5] + rng.normal(size=300) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c), int(i % 4)) for i, ((a, b), c) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 0)], "a double, b double, y double, fold int").cache()
    full = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose(models.ols(df, ["a", "b"], "y"), beta)
    inv = np.linalg.inv(full.T @ full)
    h = np.einsum("ij,jk,ik->i", full, inv, full)
    se = np.sqrt(np.diag(inv @ (full.T * ((y - full @ beta) / (1 - h)) ** 2) @ full @ inv))
    assert np.allclose([r.se for r in models.hc3(df, ["a", "b"], "y").collect()], se)
    scored = models.cross_validated_ols(df, ["a", "b"], "y", "fold")
    fold = np.arange(300) % 4
    e = np.empty(300)
    for f in range(4):
        own = np.linalg.lstsq(full[fold != f], y[fold != f], rcond=None)[0]
        e[fold == f] = y[fold == f] - full[fold == f] @ own
    assert models.metrics(scored, [], "y", "estimate").first().rmse == pytest.approx(np.sqrt((e**2).mean()))
    twice = df.dropna().withColumn("c", F.col("a"))
    assert np.allclose(models.ols(twice, ["a", "c"], "y")[1] * 2, models.ols(df.dropna(), ["a"], "y")[1])


def test_fold_preprocessing(spark):
    train = spark.createDataFrame([(1.0, None, "x"), (None, None, "y"), (3.0, None, "y")], "bedrooms double, empty double, kind string")
    prep = models.FoldPreprocessing(["bedrooms", "empty"], ["kind"]).fit(train)
    assert prep.columns == ["bedrooms", "empty", "bedrooms__missing", "empty__missing", "kind=y"]
    test = spark.createDataFrame([(None, 5.0, "new"), (7.0, None, "y")], "bedrooms double, empty double, kind string")
    out = [tuple(r) for r in prep.transform(test).select(*[f"`{c}`" for c in prep.columns]).collect()]
    assert out == [(2.0, 5.0, 1.0, 0.0, 0.0), (7.0, 0.0, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_exact_percentiles(spark, groups):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 3, 3000)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("gone", None), ("tie", 5.0), ("tie", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r[0] if groups else "": r for r in stats.exact_percentiles(df, groups, "v", (0.05, 0.5, 0.9), ("a", "b", "c")).collect()}
    by: dict = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g if groups else "", []).append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(np.percentile(vs, [5, 50, 90]).tolist()) and got[g].n == len(vs)


def test_moran_and_spearman(spark):
    from geoskein.operators.spatial import k_nearest

    pts = spark.createDataFrame([(x * 6 + y, float(x), float(y), float(x)) for x in range(6) for y in range(6)], "id long, x double, y double, value double")
    near = k_nearest(pts.select("id", "x", "y"), pts.selectExpr("id as other_id", "x as other_x", "y as other_y"), 4, 1.0, exclude_same_id=True).select("id", "other_id").cache()
    assert near.where("id = other_id").count() == 0
    i = stats.morans_i(pts.select("id", "value"), near).first().i
    p = [stats.moran_permutation_p(pts.select("id", "value"), near, 49).first() for _ in range(2)]
    assert i > 0.5 and p[0] == p[1] and p[0].observed == pytest.approx(i) and p[0].p == 0.02
    df = spark.createDataFrame([(float(v), float(v * v)) for v in range(40)] + [(None, 1.0)], "a double, b double")
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(1.0)
    assert stats.spearman(df.limit(5), "a", "b").first().rho is None
    assert [r.vif for r in stats.vif(df.withColumn("c", F.col("a")), ["a", "c"]).collect()] == [math.inf, math.inf]


def test_moran_of_every_group_against_brute_force(spark):
    from geoskein.plans.modelling import _neighbours

    rng = np.random.default_rng(8)
    rows = [(g, f"{g}{i}", float(x), float(y), float(v)) for g, n in (("a", 40), ("b", 55)) for i, (x, y, v) in enumerate(zip(*rng.uniform(0, 3000, (2, n)), rng.integers(0, 9, n)))]
    pts = spark.createDataFrame([*rows, *[("c", f"c{i}", float(i), 0.0, 3.0) for i in range(9)]], "snapshot_date string, id string, x double, y double, value double").cache()
    near = _neighbours(pts, ["snapshot_date"]).cache()
    got = {r.snapshot_date: r for r in stats.morans_i(pts, near, ["snapshot_date"]).collect()}
    p = {r.snapshot_date: r for r in stats.moran_permutation_p(pts, near, keys=["snapshot_date"]).collect()}
    assert set(got) == set(p) == {"a", "b", "c"} and got["c"].i is None and p["c"].observed is None and p["c"].p is None
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        xy, v = np.array([r[2:4] for r in own]), np.array([r[4] for r in own])
        z = v - v.mean()
        links = np.argsort(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + np.diag(np.full(len(own), np.inf)), axis=1)[:, :8]
        statistic = lambda z: (z * z[links].mean(axis=1)).sum() / (z * z).sum()
        order = np.argsort([r[1] for r in own])  # permutations run over the rows by id
        null = []
        for k in range(499):
            w = np.empty(len(own))
            w[order] = np.random.default_rng((20260929, k)).permutation(z[order])
            null.append(statistic(w))
        null = np.array(null)
        want = (1 + (np.abs(null - null.mean()) >= abs(statistic(z) - null.mean())).sum()) / 500
        assert got[g].n == len(own) and got[g].i == pytest.approx(statistic(z)) and p[g].observed == pytest.approx(statistic(z)) and p[g].p == pytest.approx(want)


def test_moran_p_takes_every_snapshot(spark, small):
    from geoskein.plans.modelling import moran_p

    rows = moran_p(spark, small).collect()
    assert len({r.snapshot_date for r in rows}) == len(rows) == 4
    assert all(round(r.p * 500, 6) == round(r.p * 500) for r in rows)


def test_distance_bins_reach_8_km_in_every_snapshot(spark, tmp_path):
    from geoskein.plans.modelling import distance_bins

    day = dt.date(2011, 4, 4)
    rows = [(f"{g}{i}", day + dt.timedelta(14 * g), "n" * n, {"x": x, "y": 0.0}) for g in range(2) for i, (x, n) in enumerate([(0.0, 1), (3000.0, 2), (8000.0, 4), (8000.0 - 250.0, 5)])]
    spark.createDataFrame(rows, "destination_key string, snapshot_date date, name string, geom_25832 struct<x: double, y: double>").write.parquet(f"{tmp_path}/osm_pois.parquet")
    got = {(r.snapshot_date, r.lower): (r.upper, r.n, r.mean_product) for r in distance_bins(spark, str(tmp_path)).collect()}
    # apart: 3000, 7750, 5000, 4750, 250; the pair at 8000 lies outside
    z = (np.array([1, 2, 4, 5]) - 3) / np.std([1, 2, 4, 5])
    one = {250.0: (500.0, 1, z[2] * z[3]), 2000.0: (4000.0, 1, z[0] * z[1]), 4000.0: (8000.0, 3, (z[0] * z[3] + z[1] * z[2] + z[1] * z[3]) / 3)}
    want = {(day + dt.timedelta(14 * g), low): v for g in range(2) for low, v in one.items()}
    assert set(got) == set(want)
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-6) for k in want)


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, w int")
    with pytest.raises(relational.ContractError):
        relational.validated_merge(a, twice, ["k"])
    assert relational.validated_merge(a, twice, ["k"], contract="one_to_many").count() == 3
    with pytest.raises(relational.ContractError):
        relational.assert_checks(a, {"small": F.col("k") < 2})
    with pytest.raises(relational.ContractError):
        relational.assert_same(a, a.union(a.limit(1)))
    relational.assert_same(a, a.orderBy("v"))
    assert quality.private_columns(a, ["V"]) == ["v"]
    assert quality.orphans(twice, a.where("k = 2"), ["k"]).count() == 2
    assert relational.funnel(a, [("n", F.lit(None).cast("boolean"))]).collect()[1].remaining == 0
    assert relational.exists_flag(a, twice, ["k"], "f").where("f").count() == 1
    assert dt.date(2026, 1, 1) == spark.range(1).select(__import__("geoskein.functions.typed", fromlist=["x"]).quarter_start(F.lit("2026Q1"))).first()[0]
