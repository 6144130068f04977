"""Deterministic folds, blocks and exclusions for cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.plans.session import cut

SEED = 20260929
ROWS_ON_DRIVER = 5_000_000


def dense_numbers(df: DataFrame, order: Sequence[str], number: str) -> DataFrame:
    """Rows numbered from 0 in a total order: a range-partitioned sort, then an offset per partition; no single-task window."""
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    per = ordered.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    offsets = per.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ordered.join(F.broadcast(offsets.select("_p", "_first", "_before")), "_p")  # one row per partition
    return joined.withColumn(number, (F.col("_before") + F.col("_m") - F.col("_first")).cast("long")).drop("_p", "_m", "_first", "_before")


def random_folds(df: DataFrame, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """(key, fold): fold of the i-th element of a seeded permutation over the key-sorted rows is i % folds + 1.

    The permutation is one sequence of a generator and needs the number of rows on the driver, so it is checked; use
    ``hashed_folds`` beyond that.
    """
    numbered = dense_numbers(df.select(key), [key], "position")
    n = numbered.count()
    if n > ROWS_ON_DRIVER:
        raise ValueError(f"{n} rows: use hashed_folds")
    fold = np.empty(n, dtype=np.int32)
    fold[np.random.default_rng(seed).permutation(n)] = np.arange(n) % folds + 1
    table = df.sparkSession.createDataFrame(list(enumerate(fold.tolist())), "position long, fold int")
    return numbered.join(table, "position").select(key, "fold")


def hashed_folds(df: DataFrame, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """(key, fold) by a hash of key and seed: no shuffle at any size."""
    return df.select(key, (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds)) + 1).cast("int").alias("fold"))


def area_folds(df: DataFrame, key: str, area: str) -> DataFrame:
    """(key, fold): the rank of the row's area; rows without an area have no fold."""
    ranks = df.where(F.col(area).isNotNull()).select(area).distinct().withColumn("fold", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(area)).cast("int"))
    return df.join(ranks, area).select(key, "fold")


def grouped_folds(df: DataFrame, key: str, group: str, stratum: str, folds: int = 5, most_groups: int = 1_000_000) -> DataFrame:
    """(key, fold): whole groups in one fold, strata spread evenly.

    Only the counts per group and stratum come to the driver, and their number is checked.  Groups are placed from
    the most uneven to the most even, each where the strata's counts over folds vary least; ties by size, then group.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("n"))
    if counts.count() > most_groups:
        raise ValueError("too many groups for the greedy placement")
    rows = counts.collect()
    strata = sorted({r[stratum] for r in rows}, key=str)
    table: dict = {}
    for r in rows:
        table.setdefault(r[group], np.zeros(len(strata)))[strata.index(r[stratum])] = r["n"]
    total = sum(table.values())
    held = np.zeros((folds, len(strata)))
    placed = []
    for name in sorted(table, key=lambda g: (-table[g].std(), -table[g].sum(), str(g))):
        best = None
        for f in range(folds):
            held[f] += table[name]
            spread = (held / total).std(axis=0).mean()
            rank = (round(float(spread), 12), float(held[f].sum()), f)
            if best is None or rank < best[0]:
                best = (rank, f)
            held[f] -= table[name]
        held[best[1]] += table[name]
        placed.append((name, best[1] + 1))
    schema = T.StructType([df.schema[group], T.StructField("fold", T.IntegerType())])
    return df.join(df.sparkSession.createDataFrame(placed, schema), group).select(key, "fold")


def split_groups(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Groups that lie in more than one fold: none, if the folds keep groups whole."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds <> 1")


def outer_splits(df: DataFrame, fold: str, key: str, exclusions: DataFrame | None = None, least_test: int = 1, least_train: int = 1):
    """(fold, train, test) one after the other; ``exclusions`` (key, fold) take buffered rows out of the training side only."""
    for f in sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect()):
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        if exclusions is not None:
            train = train.join(exclusions.where(F.col(fold) == f).select(key), key, "left_anti")
        sizes = train.count(), test.count()
        if sizes[0] < least_train or sizes[1] < least_test:
            raise ValueError(f"fold {f}: {sizes[0]} training and {sizes[1]} test rows are too few")
        yield f, train, test


def sampled_pairs(df: DataFrame, key: str, pairs_per_row: int, seed: int = SEED) -> DataFrame:
    """(key, other_key): ``pairs_per_row`` random partners for every row, by joining two hash orders rank by rank.

    Each draw numbers the rows in two independent hash orders and pairs equal numbers, so the work is linear.
    """
    out = None
    for draw in range(pairs_per_row):
        a = dense_numbers(df.select(key, F.xxhash64(key, F.lit(seed + 2 * draw)).alias("_h")), ["_h", key], "_n").select(key, "_n")
        b = dense_numbers(df.select(F.col(key).alias(f"other_{key}"), F.xxhash64(key, F.lit(seed + 2 * draw + 1)).alias("_h")), ["_h", f"other_{key}"], "_n").select(f"other_{key}", "_n")
        pairs = a.join(b, "_n").drop("_n").where(F.col(key) != F.col(f"other_{key}"))
        out = pairs if out is None else out.unionByName(pairs)
    return out
