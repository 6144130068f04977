"""Audits: named checks with what was observed and expected, release scans, duplicate and orphan keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit(df: DataFrame, checks: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """(check_name, observed, expected, passed) of aggregate expressions, all in one pass."""
    row = df.agg(*[value.cast("long").alias(f"c{i}") for i, (value, _) in enumerate(checks.values())])
    rows = [
        F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("observed"), F.lit(expected).cast("long").alias("expected"))
        for i, (name, (_, expected)) in enumerate(checks.items())
    ]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("observed").eqNullSafe(F.col("expected")))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent, list(keys), "left_anti")


def private_columns(df: DataFrame, prohibited: Sequence[str]) -> list[str]:
    """Columns that must not be published, by name, whatever the case."""
    banned = {p.lower() for p in prohibited}
    return [c for c in df.columns if c.lower() in banned]


def suppress_small(df: DataFrame, count: str, least: int = 5) -> DataFrame:
    return df.where(F.col(count) >= least)
