"""Percentiles per group with bounded rank error from mergeable sketches: deterministic buffer collapsing.

A sketch is a set of sorted buffers of at most ``k`` values, each value of a buffer standing for ``2**level`` values.
Two buffers of one level merge and every second position is kept, alternately the odd and the even ones, as a buffer
of the next level.  No randomness: each collapse widens a known bound on ranks, which the sketch carries as ``over``
and ``under``.  A task's first collapse of n_i values adds at most n_i / k, so all of them n / k together, and each
level of the merging tree n / (2 k): for t tasks the bound is about n * (1 + log2(t) / 2) / k.  The estimates inside
the bound depend on how the rows are spread over tasks; ``exact_percentiles`` do not.

Scale: every input partition is summed up to one sketch per group before anything is shuffled, so a group that holds a
third of all rows costs a partition as much as any other.  Sketches are merged in a tree: first within
``sqrt(partitions)`` slots per group, then the slots.  ``merge_to`` merges sketches of finer groups (days) to coarser
ones (all days) without reading the data again.

NULL and NaN values are left out; an empty table or group gives no sketch.  Repeated rows count as stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.plans.session import cut, ship

#: Values per buffer.
K = 512
#: Values a task holds before it sums them up.
PENDING = 2_000_000

SKETCH_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("lowest", T.DoubleType()),
    T.StructField("highest", T.DoubleType()),
    T.StructField("over", T.LongType()),
    T.StructField("under", T.LongType()),
    T.StructField("flips", T.LongType()),
    T.StructField("levels", T.ArrayType(T.IntegerType())),
    T.StructField("buffers", T.ArrayType(T.ArrayType(T.DoubleType()))),
]
SKETCH_COLUMNS = [f.name for f in SKETCH_FIELDS]


class Sketch:
    """Sorted buffers by level; the true rank of x lies in [rank(x) - over, rank(x) + under]."""

    __slots__ = ("k", "n", "lowest", "highest", "over", "under", "flips", "buffers")

    def __init__(self, k: int = K) -> None:
        self.k, self.n = k, 0
        self.lowest, self.highest = np.inf, -np.inf
        self.over = self.under = self.flips = 0
        self.buffers: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        """Values in any order; a large batch is collapsed at once, which costs less rank error than buffer by buffer."""
        if not len(values):
            return
        values = np.sort(values)
        self.n += len(values)
        self.lowest, self.highest = min(self.lowest, values[0]), max(self.highest, values[-1])
        level = max(0, int(np.ceil(np.log2(len(values) / self.k))))
        weight = 1 << level
        rest = len(values) % weight
        if level:
            # the rest is taken evenly over the batch and stays exact in the lowest level
            if rest:
                at = np.linspace(0, len(values) - 1, rest).astype(np.int64)
                self._keep(0, values[at])
                values = np.delete(values, at)
            offset = weight // 2 - self.flips % 2
            self.flips += 1
            self.over += weight - 1 - offset
            self.under += offset
            values = values[offset::weight]
        self._keep(level, values)
        self.collapse()

    def _keep(self, level: int, values: np.ndarray) -> None:
        if len(values):
            self.buffers.setdefault(level, []).append(values)

    def merge(self, other: "Sketch") -> None:
        self.n += other.n
        self.lowest, self.highest = min(self.lowest, other.lowest), max(self.highest, other.highest)
        self.over += other.over
        self.under += other.under
        self.flips += other.flips
        for level, held in other.buffers.items():
            self.buffers.setdefault(level, []).extend(held)

    def collapse(self) -> None:
        """Holds at most one buffer of at most k values on each level."""
        level = 0
        while self.buffers and level <= max(self.buffers):
            held = self.buffers.get(level, [])
            total = sum(map(len, held))
            if total <= self.k:
                if len(held) > 1:
                    self.buffers[level] = [np.sort(np.concatenate(held))]
            else:
                merged = np.sort(np.concatenate(held))
                keep = merged[-1:] if total % 2 else merged[:0]
                merged = merged[: total - total % 2]
                offset = self.flips % 2
                self.flips += 1
                self.over += (1 - offset) << level
                self.under += offset << level
                self.buffers[level] = [keep] if len(keep) else []
                self._keep(level + 1, merged[offset::2])
            level += 1

    def _values(self) -> tuple[np.ndarray, np.ndarray]:
        """The values held and the rank of each; equal values share the rank of the last of them."""
        parts = [(b, np.full(len(b), 1 << level, dtype=np.int64)) for level, held in self.buffers.items() for b in held]
        values = np.concatenate([p[0] for p in parts])
        order = np.argsort(values, kind="stable")
        values, rank = values[order], np.cumsum(np.concatenate([p[1] for p in parts])[order])
        return values, rank[np.searchsorted(values, values, side="right") - 1]

    def _at(self, values: np.ndarray, rank: np.ndarray, target: float) -> float:
        i = int(np.searchsorted(rank, target, side="left"))
        return float(values[i]) if i < len(values) else self.highest

    def at_rank(self, first: int, second: int | None = None) -> tuple[float, float]:
        """(lowest possible value at rank ``first``, highest possible one at ``second`` or ``first``); equal without any error."""
        values, rank = self._values()
        low = self._at(values, rank, first - self.under) if self.under < first else self.lowest
        return low, self._at(values, rank, (first if second is None else second) + self.over)

    def brackets(self, pcts: list[float]) -> list[tuple[float, float, float]]:
        """(lowest possible, estimate, highest possible) value of each percentile, interpolated as in percentile_cont."""
        values, rank = self._values()
        out = []
        for pct in pcts:
            position = (self.n - 1) * pct / 100
            first, second = int(np.floor(position)) + 1, int(np.ceil(position)) + 1
            low, high = self.at_rank(first, second)
            share = position - np.floor(position)
            estimate = self._at(values, rank, first) * (1 - share) + self._at(values, rank, second) * share
            if not self.over and not self.under:
                low = high = estimate
            out.append((low, estimate, high))
        return out

    def row(self) -> list:
        levels = [lv for lv, held in self.buffers.items() for _ in held]
        return [self.n, self.lowest, self.highest, self.over, self.under, self.flips, levels, [b for held in self.buffers.values() for b in held]]

    @classmethod
    def of(cls, row, k: int) -> "Sketch":
        s = cls(k)
        s.n, s.lowest, s.highest, s.over, s.under, s.flips = row.n, row.lowest, row.highest, row.over, row.under, row.flips
        for level, values in zip(row.levels, row.buffers):
            s._keep(int(level), np.asarray(values, dtype=np.float64))
        return s


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keys]


def _summing(keys: list[str], fields: list[str], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches: dict[tuple, Sketch] = {}
        pending: list[pd.DataFrame] = []
        held = 0

        def sum_up() -> None:
            whole = pd.concat(pending, ignore_index=True)
            pending.clear()
            code = whole.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.flatnonzero(np.diff(code[order], append=-1)) + 1
            names = whole[keys].iloc[order[ends - 1]].itertuples(index=False, name=None)
            columns = [whole[f].to_numpy(dtype=np.float64)[order] for f in fields]
            start = 0
            for name, end in zip(names, ends):
                for field, column in zip(fields, columns):
                    values = column[start:end]
                    values = values[~np.isnan(values)]
                    if len(values):
                        sketches.setdefault((*name, field), Sketch(k)).add(values)
                start = end

        for batch in batches:
            pending.append(batch)
            held += len(batch)
            if held >= PENDING:
                sum_up()
                held = 0
        if held:
            sum_up()
        if sketches:
            yield pd.DataFrame([[*key, *s.row()] for key, s in sketches.items()], columns=[*keys, "field_name", *SKETCH_COLUMNS])

    return run


def _merging(keys: list[str], k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = Sketch(k)
        # the same order of merging whatever the order of arrival
        for i, row in enumerate(pdf.sort_values(["n", "lowest", "highest", "over"]).itertuples(index=False)):
            whole.merge(Sketch.of(row, k))
            if i % 16 == 15:
                whole.collapse()
        whole.collapse()
        return pd.DataFrame([[*pdf[keys].iloc[0], *whole.row()]], columns=[*keys, *SKETCH_COLUMNS])

    return run


def _slots(df: DataFrame) -> int:
    """Slots of the first merge: the square root of the partitions the planner's size estimate stands for, none for few."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = float(str(stats.sizeInBytes()))
    partitions = size / df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return 1 if partitions < 64 else min(256, int(np.ceil(np.sqrt(partitions))))


def sketches(df: DataFrame, keys: list[str], fields: list[str], k: int = K) -> DataFrame:
    """One mergeable sketch per group of ``keys`` and field: (keys..., field_name, sketch columns)."""
    ship(df.sparkSession)
    # dates travel to Python as day numbers: a date object per row would cost more than the sketch
    dates = [c for c in keys if isinstance(df.schema[c].dataType, T.DateType)]
    narrow = df.select(*[F.unix_date(c).alias(c) if c in dates else F.col(c) for c in keys], *[F.col(f).cast("double").alias(f) for f in fields])
    key_fields = [*_key_fields(narrow, keys), T.StructField("field_name", T.StringType())]
    partial = narrow.mapInPandas(_summing(keys, fields, k), T.StructType([*key_fields, *SKETCH_FIELDS]))
    names = [*keys, "field_name"]
    slots = _slots(narrow)
    slotted = partial.withColumn("slot", F.spark_partition_id() % slots)
    if slots > 1:
        schema = T.StructType([*key_fields, T.StructField("slot", T.IntegerType()), *SKETCH_FIELDS])
        slotted = slotted.groupBy(*names, "slot").applyInPandas(_merging([*names, "slot"], k), schema)
    merged = merge_to(slotted.drop("slot"), keys, k)
    return merged.withColumns({c: F.date_from_unix_date(c) for c in dates})


def merge_to(sketched: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches merged to the coarser groups of ``keys`` and field_name."""
    names = [*keys, "field_name"]
    schema = T.StructType([*_key_fields(sketched, names), *SKETCH_FIELDS])
    # few bytes, much work: an explicit number of partitions, which the planner does not merge by bytes
    spread = sketched.select(*names, *SKETCH_COLUMNS).repartition(int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)
    return spread.groupBy(*names).applyInPandas(_merging(names, k), schema)


def percentiles(sketched: DataFrame, keys: list[str], pcts: list[int], k: int = K) -> DataFrame:
    """(keys..., field_name, n, rank_error, pct, low, estimate, high): the percentile lies in [low, high] for certain."""
    names = [*keys, "field_name"]
    schema = T.StructType(
        [
            *_key_fields(sketched, names),
            T.StructField("n", T.LongType()),
            T.StructField("rank_error", T.LongType()),
            T.StructField("pct", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ("low", "estimate", "high")],
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            heads = batch[names].itertuples(index=False, name=None)
            for head, row in zip(heads, batch[SKETCH_COLUMNS].itertuples(index=False)):
                s = Sketch.of(row, k)
                for pct, bracket in zip(pcts, s.brackets([float(p) for p in pcts])):
                    rows.append([*head, s.n, max(s.over, s.under), pct, *bracket])
            yield pd.DataFrame(rows, columns=[*names, "n", "rank_error", "pct", "low", "estimate", "high"])

    return sketched.select(*names, *SKETCH_COLUMNS).mapInPandas(run, schema)


def _ranked(k: int):
    """Bounds of the value at ``rank`` inside the sketch of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Sketch.of(row, k).at_rank(int(row.rank)) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"t": batch["t"], "low": [b[0] for b in found], "high": [b[1] for b in found]})

    return run


def exact_percentiles(df: DataFrame, keys: list[str], asked: DataFrame, k: int = K) -> DataFrame:
    """The exact percentile for each row of ``asked`` (keys..., field_name, pct, n, low, high), narrowed from its bracket.

    Each pass counts what lies below and at the ends of a bracket and sketches what lies strictly inside; the sketch
    gives the next, narrower bracket, and a sketch of up to ``k`` values is exact.  So a pass divides the values in
    question by about ``k``, and no group is ever ranked in one task.
    """
    names = [*keys, "field_name"]
    fields = [r[0] for r in asked.select("field_name").distinct().collect()]
    if not fields:
        return asked.select(*names, "pct").limit(0).withColumn("exact", F.lit(0.0))
    stacked = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("value")) for f in fields])).alias("p"))
    stacked = stacked.select(*keys, "p.field_name", "p.value").where("value is not null and not isnan(value)")
    position = (F.col("n") - 1) * F.col("pct") / 100
    ranks = F.array(F.struct(F.lit(0).alias("second"), (F.floor(position) + 1).alias("rank")), F.struct(F.lit(1).alias("second"), (F.ceil(position) + 1).alias("rank")))
    share = (position - F.floor(position)).alias("share")
    targets = asked.select(*names, "pct", share, "low", "high", F.explode(ranks).alias("r")).select("*", "r.*").drop("r")
    targets = cut(targets.withColumn("t", F.monotonically_increasing_id()))
    open_, settled = targets.select("t", *names, "rank", "low", "high"), []
    while True:
        settled.append(open_.where("low = high").select("t", F.col("low").alias("value")))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        joined = stacked.join(open_, [stacked[c].eqNullSafe(open_[c]) for c in names]).select("t", "rank", "low", "high", "value").where("value <= high")
        counted = joined.groupBy("t").agg(
            F.first("rank").alias("rank"), F.first("low").alias("low"), F.first("high").alias("high"),
            F.count_if(F.col("value") <= F.col("low")).alias("upto_low"), F.count_if(F.col("value") < F.col("high")).alias("below_high"),
        )
        inside = sketches(joined.where("value > low and value < high"), ["t"], ["value"], k)
        within = counted.where("rank > upto_low and rank <= below_high").select("t", (F.col("rank") - F.col("upto_low")).alias("rank"))
        bounds = inside.join(within, "t").select("t", "rank", *SKETCH_COLUMNS).mapInPandas(_ranked(k), "t long, low double, high double")
        bounds = bounds.withColumnsRenamed({"low": "next_low", "high": "next_high"})
        low = F.when(F.col("rank") <= F.col("upto_low"), F.col("low")).when(F.col("rank") > F.col("below_high"), F.col("high")).otherwise(F.col("next_low"))
        high = F.when(F.col("rank") <= F.col("upto_low"), F.col("low")).when(F.col("rank") > F.col("below_high"), F.col("high")).otherwise(F.col("next_high"))
        moved = counted.join(bounds, "t", "left").select("t", low.alias("low"), high.alias("high"))
        open_ = cut(open_.drop("low", "high").join(moved, "t").select("t", *names, "rank", "low", "high"))
    values = settled[0]
    for other in settled[1:]:
        values = values.unionByName(other)
    by_part = lambda second: F.max(F.when(F.col("second") == second, F.col("value")))
    return (
        targets.join(values, "t").groupBy(*names, "pct", "share").agg(by_part(0).alias("a"), by_part(1).alias("b"))
        .select(*names, "pct", (F.col("a") * (1 - F.col("share")) + F.col("b") * F.col("share")).alias("exact"))
    )
