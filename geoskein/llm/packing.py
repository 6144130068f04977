"""Items packed into containers of fixed capacity through optimal length buckets.

1. A text longer than the container is split: its full parts fill containers alone, the remainder is packed.
2. The global histogram of lengths, one row per length and capacity and so at most ``capacity`` rows, goes to a
   dynamic programme that chooses the bucket boundaries with the least padding, every item counted with the boundary
   above it.  Lengths are taken as they are; the programme is exact.
3. Batches form within the token budget: a plan fills a container with items of the longest bucket left, and what
   room they leave is topped up from shorter buckets, as often as the buckets' counts allow.  The plan speaks of
   counts only, so it stays small whatever the number of items.
4. Every item finds its container from its rank in its bucket.  Ranks come from counts per (bucket, hash slot) and a
   numbering inside each slot, so no bucket is ever sorted in one task.

All capacities go through one pass.  ``bucket_report`` gives the buckets with their padding, and the containers that
batches of one bucket alone would take.

The capacity always holds, since no item is longer than its bucket's boundary.  Items of no tokens take no room and
are left out, so are rows without an id; an id that comes again is one item of the larger length.  Equal lengths are
told apart by id.  Capacities that are NULL or below 1 are left out.  An empty table, or no capacity, gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoskein.llm.optimum import bucket_bounds
from geoskein.plans.session import cut, ship

BUCKETS = 512
ROWS_PER_SLOT = 500_000


def fill_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(pattern, times, [(bucket, items)]): containers filled from the longest bucket downwards."""
    left = list(counts)
    # the next bucket at or below that still has items; -1 where none has
    below = list(range(len(bounds)))

    def held(b: int) -> int:
        path = []
        while b >= 0 and not left[b]:
            path.append(b)
            b = below[b] - 1 if below[b] == b else below[b]
        for p in path:
            below[p] = b
        return b

    out, pattern = [], 0
    bucket = held(len(bounds) - 1)
    while bucket >= 0:
        room, items, b = capacity, [], bucket
        while b >= 0:
            take = min(left[b], room // bounds[b])
            if take:
                items.append((b, take))
                room -= take * bounds[b]
            b = held(min(b - 1, int(np.searchsorted(bounds, room, side="right")) - 1))
        times = min(left[b] // take for b, take in items)
        for b, take in items:
            left[b] -= take * times
        out.append((pattern, times, items))
        pattern += 1
        bucket = held(bucket)
    return out


class Plan:
    """Buckets and containers of one capacity: where each rank of each bucket goes."""

    def __init__(self, capacity: int, lengths: np.ndarray, counts: np.ndarray, buckets: int) -> None:
        self.capacity = capacity
        self.bounds = bucket_bounds(lengths, counts, buckets)
        self.of_length = np.searchsorted(self.bounds, lengths)
        per_bucket = np.bincount(self.of_length, weights=counts, minlength=len(self.bounds)).astype(int).tolist()
        starts: dict[int, list[int]] = {}
        segments: dict[int, list[tuple[int, int]]] = {}
        used = [0] * len(self.bounds)
        for pattern, times, chosen in fill_plan(self.bounds, per_bucket, capacity):
            for b, take in chosen:
                starts.setdefault(b, []).append(used[b])
                segments.setdefault(b, []).append((pattern, take))
                used[b] += take * times
        self.starts = {b: np.array(s) for b, s in starts.items()}
        self.segments = {b: np.array(s) for b, s in segments.items()}

    def place(self, bucket: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patterns = np.empty(len(rank), dtype=np.int64)
        numbers = np.empty(len(rank), dtype=np.int64)
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            at = np.searchsorted(self.starts[b], rank[own], side="right") - 1
            chosen = self.segments[b][at]
            patterns[own] = chosen[:, 0]
            numbers[own] = (rank[own] - self.starts[b][at]) // chosen[:, 1]
        return patterns, numbers


def _placing(plans: dict[int, Plan]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pattern = np.empty(len(batch), dtype=np.int64)
            number = np.empty(len(batch), dtype=np.int64)
            capacity, bucket, rank = (batch[c].to_numpy() for c in ("capacity_tokens", "bucket", "rank"))
            for c in np.unique(capacity):
                own = np.flatnonzero(capacity == c)
                pattern[own], number[own] = plans[int(c)].place(bucket[own], rank[own])
            yield batch.drop(columns=["bucket", "rank"]).assign(pattern=pattern, number=number)

    return run


def _sizes(capacities: DataFrame) -> list[tuple[int, int]]:
    """(capacity_id, capacity_tokens) of the usable capacities, a small list given by hand."""
    rows = capacities.where("capacity_id is not null and capacity_tokens > 0").select("capacity_id", "capacity_tokens").distinct().collect()
    return sorted((int(r.capacity_id), int(r.capacity_tokens)) for r in rows)


def _parts(given: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Full parts and remainders of every item for every capacity: (capacity_tokens, doc_id, part, token_start, tokens)."""
    each = given.where("tokens > 0").select("doc_id", "tokens", F.explode(F.array(*[F.lit(c).cast("long") for c in sizes])).alias("capacity_tokens"))
    full = each.where("tokens >= capacity_tokens").select(
        "capacity_tokens", "doc_id", F.explode(F.expr("sequence(0L, tokens div capacity_tokens - 1)")).alias("part")
    )
    full = full.select("capacity_tokens", "doc_id", "part", (F.col("part") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("tokens"))
    rest = each.selectExpr(
        "capacity_tokens", "doc_id", "tokens div capacity_tokens as part", "tokens - tokens % capacity_tokens as token_start", "tokens % capacity_tokens as tokens"
    ).where("tokens > 0")
    return full, rest


def _plans(rest: DataFrame, sizes: list[int], buckets: int) -> tuple[dict[int, Plan], pd.DataFrame]:
    histogram = rest.groupBy("capacity_tokens", "tokens").count().toPandas()  # at most the sum of the capacities rows
    plans: dict[int, Plan] = {}
    found = []
    for capacity, own in histogram.sort_values("tokens").groupby("capacity_tokens"):
        plan = plans[int(capacity)] = Plan(int(capacity), own["tokens"].to_numpy(), own["count"].to_numpy(), buckets)
        found.append(own.assign(bucket=plan.of_length, bound=np.asarray(plan.bounds)[plan.of_length]))
    columns = ["capacity_tokens", "tokens", "count", "bucket", "bound"]
    return plans, pd.concat(found)[columns].astype("int64") if found else pd.DataFrame(columns=columns, dtype="int64")


_LENGTHS = "capacity_tokens long, tokens long, count long, bucket long, bound long"


def one_per_id(items: DataFrame) -> DataFrame:
    """An id that comes again is one item."""
    return cut(items.where("doc_id is not null").groupBy("doc_id").agg(F.max("tokens").cast("long").alias("tokens")))


def pack_all(items: DataFrame, capacities: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The containers of every capacity (capacity_id, capacity_tokens), with the parts (doc_id, part, token_start, tokens) they hold and the space each leaves."""
    spark = items.sparkSession
    ship(spark)
    columns = ["capacity_id", "capacity_tokens", "container", "doc_id", "part", "token_start", "tokens", "space_left"]
    named = _sizes(capacities)
    given = one_per_id(items)
    if not named:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'container' else 'long'}" for c in columns))
    sizes = sorted({c for _, c in named})
    full, rest = _parts(given, sizes)
    plans, lengths = _plans(rest, sizes, buckets)
    full = full.withColumn("container", F.concat(F.lit("d"), "doc_id", F.lit("-"), "part")).withColumn("space_left", F.lit(0).cast("long"))
    slots = max(1, -(-int(lengths["count"].sum()) // ROWS_PER_SLOT))
    # a row per length and capacity
    bucket_of = F.broadcast(spark.createDataFrame(lengths, _LENGTHS).select("capacity_tokens", "tokens", "bucket"))
    keys = ["capacity_tokens", "bucket", "slot"]
    bucketed = rest.join(bucket_of, ["capacity_tokens", "tokens"]).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    numbered = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("tokens", "doc_id")) - 1)
    if slots > 1:
        before = F.coalesce(F.sum("count").over(Window.partitionBy("capacity_tokens", "bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = numbered.join(bucketed.groupBy(*keys).count().select(*keys, before.alias("before")), keys).withColumn("rank", F.col("rank") + F.col("before"))
    placed = numbered.select("capacity_tokens", "doc_id", "part", "token_start", "tokens", "bucket", F.col("rank").cast("long").alias("rank")).mapInPandas(
        _placing(plans), "capacity_tokens long, doc_id long, part long, token_start long, tokens long, pattern long, number long"
    )
    inside = Window.partitionBy("capacity_tokens", "pattern", "number")  # a container's items, at most its capacity
    placed = placed.withColumn("space_left", F.col("capacity_tokens") - F.sum("tokens").over(inside)).withColumn("container", F.concat(F.lit("p"), "pattern", F.lit("-"), "number"))
    out = full.select(*columns[1:]).unionByName(placed.select(*columns[1:]))
    ids = F.create_map(*[x for c in sizes for x in (F.lit(c).cast("long"), F.array(*[F.lit(i).cast("long") for i, own in named if own == c]))])
    return out.withColumn("capacity_id", F.explode(ids[F.col("capacity_tokens")])).select(*columns)


def pack(items: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(container, doc_id, part, token_start, tokens) for the items (doc_id, tokens) and one capacity."""
    one = items.sparkSession.createDataFrame([(0, capacity)], "capacity_id long, capacity_tokens long")
    return pack_all(items, one, buckets).select("container", "doc_id", "part", "token_start", "tokens")


def bucket_report(items: DataFrame, capacities: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each bucket of each capacity: its boundary, items, tokens, padding up to the boundary, and the containers its own batches would take.

    Items as long as the container or longer are split first; their full parts are in no bucket.
    """
    spark = items.sparkSession
    named = _sizes(capacities)
    sizes = sorted({c for _, c in named})
    lengths = _plans(_parts(one_per_id(items), sizes)[1], sizes, buckets)[1] if sizes else pd.DataFrame(columns=["capacity_tokens", "tokens", "count", "bucket", "bound"], dtype="int64")
    ids = spark.createDataFrame(named, "capacity_id long, capacity_tokens long")
    per = spark.createDataFrame(lengths, _LENGTHS).groupBy("capacity_tokens", "bound").agg(F.sum("count").alias("items"), F.sum(F.col("tokens") * F.col("count")).alias("tokens"))
    per = per.withColumn("padding", F.col("bound") * F.col("items") - F.col("tokens"))
    return ids.join(per, "capacity_tokens").select(
        "capacity_id", "capacity_tokens", F.col("bound").alias("longest"), "items", "tokens", "padding",
        F.expr("ceil(items / (capacity_tokens div bound))").alias("containers"),
    )
