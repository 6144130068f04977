import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.llm import mixing, packing
from geoskein.llm.tokens import encode, encoder, token_counts


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        pad = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        best = min(pad([*chosen, lengths[-1]]) for chosen in itertools.combinations(lengths[:-1].tolist(), 2))
        got = packing.bucket_bounds(lengths, counts, 3)
        assert len(got) <= 3 and pad(got) == best


def test_bounds_of_thousands_of_lengths():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(np.arange(1, 8192), 3000, replace=False))
    counts = rng.integers(1, 50, len(lengths))
    bounds = packing.bucket_bounds(lengths, counts, 64)
    pad = lambda b: int((counts * (np.asarray(b)[np.searchsorted(b, lengths)] - lengths)).sum())
    best = pad(bounds)
    assert len(bounds) <= 64 and bounds[-1] == lengths[-1]
    for i in range(len(bounds) - 1):  # no boundary can move to a better neighbour
        at = int(np.searchsorted(lengths, bounds[i]))
        for other in (lengths[at - 1], lengths[at + 1]):
            assert pad(sorted({*bounds[:i], int(other), *bounds[i + 1 :]})) >= best


def test_fill_of_large_containers(spark):
    rng = np.random.default_rng(8)
    items = [(i, int(t)) for i, t in enumerate(rng.integers(1, 6000, 4000))]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    rows = packing.pack(df, 8192).groupBy("container").sum("tokens").collect()
    assert sum(r[1] for r in rows) == sum(t for _, t in items) and max(r[1] for r in rows) <= 8192
    assert sum(t for _, t in items) / (8192 * len(rows)) > 0.97  # 4000 items, so the last containers weigh


def test_bucket_report(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 9), (4, 10), (5, 25)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(7, 20), (8, None), (None, 5)], "capacity_id long, capacity_tokens int")
    rows = sorted(packing.bucket_report(df, caps, 2).collect(), key=lambda r: r.longest)
    assert [(r.capacity_id, r.longest, r.items, r.tokens, r.padding, r.containers) for r in rows] == [(7, 5, 3, 12, 3, 1), (7, 10, 2, 19, 1, 1)]


@pytest.mark.parametrize("slot_rows", [7, 500_000])
def test_containers_hold_every_token_once(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(packing, "ROWS_PER_SLOT", slot_rows)
    rng = random.Random(5)
    items = [(i, rng.choice([0, 1, 5, 17, 17, 40, 64, 100, 999])) for i in range(300)] + [(300, None), (None, 5), (301, 64), (301, 64)]
    df = spark.createDataFrame([(*x, "c") for x in items], "doc_id long, tokens long, container string")
    caps = spark.createDataFrame([(1, 64), (2, 1000)], "capacity_id long, capacity_tokens int")
    rows = packing.pack_all(df, caps, 16).collect()
    for cap, size in ((1, 64), (2, 1000)):
        own = [r for r in rows if r.capacity_id == cap]
        held = {}
        for r in own:
            held.setdefault(r.container, []).append(r)
        assert all(sum(r.tokens for r in v) + v[0].space_left == size and v[0].space_left >= 0 for v in held.values())
        parts = {}
        for r in own:
            parts.setdefault(r.doc_id, []).append((r.token_start, r.tokens))
        want = {i: t for i, t in items if i is not None and t}
        assert {i: sum(t for _, t in p) for i, p in parts.items()} == want
        for i, p in parts.items():
            assert (len(p) > 1) <= (want[i] > size)
            assert sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    assert packing.pack_all(df.limit(0), caps).count() == 0 and packing.pack_all(df, caps.limit(0)).count() == 0


def test_tokens_of_odd_texts(spark):
    e = encoder("/opt/tokenizers")
    for text in ["", "Møllestien  er\n\n ny.", " " * 50, "a\n" + " " * 3000 + "b", "a" + " " * 3000, "<|endoftext|>"]:
        assert e.decode(encode(text)) == text
    assert encode("x" + " " * 1500 + "y") == e.encode_ordinary("x" + " " * 1500 + "y")
    assert e.decode(encode("x" + "\n" * 500_000 + "y")) == "x" + "\n" * 500_000 + "y"
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello world", 1), (None, "x", 1)], "doc_id long, text string, tokens int")
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()} == {1: 0, 2: 0, 3: 2}


def _mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id long, source string, tokens long, weight double, epochs int, rest int")
    t = spark.createDataFrame([(*x, 0) for x in targets], "source string, target_share double, max_repeats int, available int")
    uses, planned = mixing.mix(d, t, **kw)
    return {r.doc_id: r.uses for r in uses.collect()}, {r.source: r for r in mixing.reached_shares(uses, planned).collect()}


def test_shares_and_epochs(spark):
    rng = random.Random(2)
    docs = [(i, "big", rng.randint(1, 50), 1.0) for i in range(3000)] + [(10_000 + i, "small", rng.randint(1, 50), 0.5) for i in range(300)]
    docs += [(20_000, "untargeted", 10, 1.0), (20_001, None, 10, 1.0), (20_002, "big", 0, None), (20_003, "big", None, None), (5, "big", docs[5][2], 1.0)]
    uses, shares = _mix(spark, docs, [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)])
    assert uses[20_000] == uses[20_001] == uses[20_002] == 0
    assert max(uses[10_000 + i] for i in range(300)) <= 3 and max(uses[i] for i in range(3000)) <= 1
    assert abs(shares["big"].actual_share - 5 / 9) < 0.01 and abs(shares["small"].actual_share - 4 / 9) < 0.01
    assert shares["absent"].mixed_tokens == 0 and shares["untargeted"].mixed_tokens == 0
    small = [uses[10_000 + i] for i in range(300)]
    assert max(small) - min(small) <= 1  # whole epochs before the partial pass


def test_partial_pass_is_the_prefix_of_the_keys(spark):
    docs = [(i, "s", 10, 0.1 + (i % 7)) for i in range(500)]
    uses, _ = _mix(spark, docs, [("s", 1.0, 1)], total_tokens=1234)
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, weight double")
    order = [r.doc_id for r in df.withColumn("k", mixing.exponential_key(F.col("doc_id"), F.col("weight"))).orderBy("k").collect()]
    assert {i for i, u in uses.items() if u} == set(order[:123])


@pytest.mark.parametrize("rows_in_bin", [3, 200_000])
def test_passes_against_a_plain_loop(spark, monkeypatch, rows_in_bin):
    """Long documents stand in the way of the budget; weights at the floor crowd the keys."""
    monkeypatch.setattr(mixing, "ROWS_IN_BIN", rows_in_bin)
    rng = random.Random(9)
    docs = [(i, "ab"[i % 2], rng.choice([1, 3, 5, 40, 400, 900]), rng.choice([0.0, 1e-9, 0.05, 1.0])) for i in range(400)]
    uses, shares = _mix(spark, docs, [("a", 0.3, 1), ("b", 0.7, 1)])
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, weight double")
    keys = {r.doc_id: r.k for r in df.withColumn("k", mixing.exponential_key(F.col("doc_id"), F.greatest("weight", F.lit(1e-6)))).collect()}
    for source in "ab":
        left = gap = shares[source].budget - shares[source].epochs * shares[source].available
        want, after = set(), None
        own = sorted((keys[i], i, t) for i, s, t, _ in docs if s == source)
        while shares[source].epochs < shares[source].max_repeats:
            gap, stop = left, None
            for k, i, t in own:
                if (after is None or (k, i) > after) and t <= gap:
                    if t > left:
                        stop = (k, i)
                        break
                    want.add(i)
                    left -= t
            if stop is None or left <= mixing.TOLERANCE * shares[source].budget:
                break
            after = stop
        assert {i for i, s, _, _ in docs if s == source and uses[i] > shares[source].epochs} == want
        assert shares[source].budget - shares[source].mixed_tokens <= max(1, 0.01 * shares[source].budget)


def test_repeated_ids_have_a_defined_row(spark):
    docs = [(1, "b", 7, 1.0), (1, "a", 9, 1.0), (2, "a", 4, float("nan"))]
    for rows in (docs, docs[::-1]):
        uses, shares = _mix(spark, rows, [("a", 1.0, 1), ("b", 0.0, 1)])
        assert uses == {1: 1, 2: 1} and shares["a"].mixed_tokens == 13


def test_quality_weight(spark):
    texts = {"plain": "The garden lies behind the house, and a path leads from there to the old mill at the lake.",
             "loop": "cheap cheap " * 40, "signs": "@@ ## 12 34 " * 20, "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "name string, text string").union(spark.createDataFrame([("null", None)], "name string, text string"))
    got = {r.name: r.w for r in df.select("name", mixing.quality_weight(F.col("text")).alias("w")).collect()}
    assert got["plain"] > 0.8 and got["loop"] < 0.3 and got["signs"] < 0.1 and got["empty"] == got["null"] == 0.05


def test_empty_mix(spark):
    assert _mix(spark, [], [])[0] == {}
    assert _mix(spark, [(1, "a", 5, 1.0)], [])[0] == {1: 0}
