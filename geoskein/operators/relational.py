"""Relational building blocks with contracts: validated merges, funnels, long to wide, set comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A stated contract on keys or counts does not hold."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validated_merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", contract: str = "many_to_one") -> DataFrame:
    """A join that refuses a side whose keys repeat against the contract (one_to_one, many_to_one, one_to_many)."""
    if contract in ("one_to_one", "many_to_one") and not duplicate_keys(right, on).isEmpty():
        raise ContractError(f"right side: keys {list(on)} are not unique")
    if contract in ("one_to_one", "one_to_many") and not duplicate_keys(left, on).isEmpty():
        raise ContractError(f"left side: keys {list(on)} are not unique")
    return left.join(right, list(on), how)


def exists_flag(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """``left`` with a boolean column: whether ``right`` has the key.  NULL keys exist nowhere."""
    keys = right.select(*on).distinct().withColumn(flag, F.lit(True))
    return left.join(keys, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage_no, stage, remaining, excluded): cumulative predicates in one pass; NULL predicates do not pass."""
    held = F.lit(True)
    sums = [F.count("*").alias("s0")]
    for i, (_, condition) in enumerate(stages, 1):
        held = held & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(held).alias(f"s{i}"))
    one = df.agg(*sums)
    names = ["all", *[name for name, _ in stages]]
    rows = [
        F.struct(
            F.lit(i).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(f"s{i}").alias("remaining"),
            (F.col(f"s{max(0, i - 1)}") - F.col(f"s{i}")).alias("excluded"),
        )
        for i, name in enumerate(names)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, wanted: Mapping[str, Column]) -> DataFrame:
    """One column per entry of ``wanted`` (column -> condition): the greatest value for which the condition holds."""
    return df.groupBy(*keys).agg(*[F.max(F.when(condition, F.col(value))).alias(column) for column, condition in wanted.items()])


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value", kind: str = "double") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def union_labelled(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """UNION ALL with a discriminator; columns that a frame lacks are NULL."""
    labelled = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity, and the side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def assert_same(a: DataFrame, b: DataFrame) -> None:
    if not symmetric_difference(a, b).isEmpty():
        raise ContractError("the tables differ")


def assert_checks(df: DataFrame, checks: Mapping[str, Column]) -> None:
    """One pass over the rows; raises with the names of the checks some row violates.  A NULL result is a violation."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]).first()
    broken = {name: row[name] for name in checks if row[name]}
    if broken:
        raise ContractError(f"violated: {broken}")


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group in a total order, with ``rank``; Spark keeps only k rows per group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def null_census(df: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, blanks) of every column in one pass; blanks only for texts."""
    sums = [F.count("*").alias("_rows")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        sums.append(F.count_if(c.isNull()).alias(f"n{i}"))
        text = field.dataType.typeName() == "string"
        sums.append((F.count_if(F.trim(c) == "") if text else F.lit(0).cast("long")).alias(f"b{i}"))
    rows = [
        F.struct(F.lit(f.name).alias("column_name"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def clip_rate_batches(df: DataFrame, batch: str, good: Column, least: float) -> DataFrame:
    """The rows of the batches in which at least the share ``least`` of rows is good."""
    rate = df.groupBy(batch).agg(F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("_rate")).where(F.col("_rate") >= least)
    return df.join(rate.select(batch), batch, "left_semi")


def update_from(df: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` taken from the row of ``updates`` with the same ``keys``; rows without one stay as they are.

    NULLs of a matching row are taken as well, NULL keys match nothing.  Repeated keys in ``updates`` are refused,
    as the outcome would depend on their order.
    """
    if not duplicate_keys(updates.dropna(subset=list(keys)), keys).isEmpty():
        raise ContractError("the keys of an update repeat")
    new = updates.select(*keys, F.struct(*columns).alias("_new"))
    joined = df.join(new, list(keys), "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def exclusive_sums(cells: DataFrame, groups: Sequence[str], keys: Sequence[str], value: str, conditions: Mapping[str, Column], expected: int | None = None) -> DataFrame:
    """(groups..., cells, total, one sum per condition) over cells that exclude one another.

    Refused are cells that repeat within a group, and groups of another number of cells than ``expected``.
    """
    if not duplicate_keys(cells, [*groups, *keys]).isEmpty():
        raise ContractError("the cells of a group repeat")
    sums = [F.sum(F.when(condition, F.col(value))).alias(name) for name, condition in conditions.items()]
    out = cells.groupBy(*groups).agg(F.count("*").alias("cells"), F.sum(value).alias("total"), *sums)
    if expected is not None and not out.where(F.col("cells") != expected).isEmpty():
        raise ContractError("a group has another number of cells")
    return out
