"""Directed weighted graphs as DataFrames: segments to arcs, components, nearest source, reach within a budget.

Shortest paths have two ways with equal results.  A graph of at most ``ARCS_IN_TASK`` arcs, counted first, is broadcast
as sorted arrays and searched with a heap inside the tasks, one search per seed group.  Beyond that a frontier is
relaxed in rounds: only nodes whose distance improved send on, and each round keeps the least (distance, key) per
node; rounds are cut by checkpoints and no arc leaves the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.operators.components import components
from geoskein.operators.folds import dense_numbers
from geoskein.plans.session import cut, ship

# Classes of ways on foot and the values of access tags.
DEFAULT_WALK = (
    "footway", "pedestrian", "path", "steps", "living_street", "residential", "service", "unclassified", "tertiary",
    "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "track", "road", "platform",
)
EXPLICIT_FOOT_ONLY = ("cycleway", "bridleway", "busway")
FORBIDDEN = (
    "motorway", "motorway_link", "trunk", "trunk_link", "raceway", "construction", "proposed", "abandoned", "corridor", "escape",
)
PERMITTED = ("yes", "designated", "permissive", "official")
DENIED = ("no", "private", "restricted")
DENIED_ACCESS = ("no", "private")
ONE_WAY, ONE_WAY_BACK = ("yes", "1", "true"), ("-1", "reverse")
WALK_METRES_PER_MINUTE = 80.0
RADII = (800, 1200, 1600)


def walking_directions(tag: Mapping[str, Column]) -> tuple[Column, Column]:
    """(forward, backward): whether a way may be walked in either direction, from its tags; absent tags are NULL columns.

    Barred are ways without a class, of a forbidden class, areas, ways denied to walkers, and ways denied to everybody
    that don't permit walkers.  Of the rest the classes walked by default are open, cycleways and their like only where
    they permit walkers.  Each direction may be denied by a tag of its own.  A one-way for walkers, or else a moving
    walkway, closes the other direction; being closed backward it is not closed forward too.  A one-way for vehicles
    is no rule.
    """
    no = F.lit(None).cast("string")
    one_of = lambda key, values: F.coalesce(tag.get(key, no).isin(*values), F.lit(False))
    highway = F.coalesce(tag.get("highway", no), F.lit(""))
    permits = one_of("foot", PERMITTED)
    barred = (highway == "") | highway.isin(*FORBIDDEN) | one_of("area", ("yes",)) | one_of("foot", DENIED) | (one_of("access", DENIED_ACCESS) & ~permits)
    walkable = ~barred & (highway.isin(*DEFAULT_WALK) | (highway.isin(*EXPLICIT_FOOT_ONLY) & permits))
    shut_backward = one_of("oneway:foot", ONE_WAY) | one_of("conveying", ("forward",))
    shut_forward = ~shut_backward & (one_of("oneway:foot", ONE_WAY_BACK) | one_of("conveying", ("backward",)))
    return walkable & ~one_of("foot:forward", DENIED) & ~shut_forward, walkable & ~one_of("foot:backward", DENIED) & ~shut_backward


def way_segments(ways: DataFrame) -> DataFrame:
    """Ways (way_id, nodes array<struct<id,x,y>>, forward, backward) to segments of neighbouring, different nodes."""
    n = F.size("nodes")
    pairs = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("nodes", i).alias("a"), F.element_at("nodes", i + 1).alias("b"))),
    )
    s = ways.select("way_id", "forward", "backward", F.posexplode(pairs).alias("seq", "p")).where("p.a.id <> p.b.id")
    length = F.sqrt(F.pow(F.col("p.a.x") - F.col("p.b.x"), 2) + F.pow(F.col("p.a.y") - F.col("p.b.y"), 2))
    return s.select("way_id", F.col("seq").cast("long").alias("seq"), F.col("p.a.id").alias("u"), F.col("p.b.id").alias("v"), length.alias("length_m"), "forward", "backward")


def arcs(segments: DataFrame, least_m: float = 0.01) -> DataFrame:
    """Segments (u, v, length_m, forward, backward) to arcs (src, dst, length_m): parallel ones keep the shortest."""
    kept = segments.where(F.col("length_m") >= least_m)
    both = F.filter(
        F.array(
            F.when(F.col("forward"), F.struct(F.col("u").alias("src"), F.col("v").alias("dst"))),
            F.when(F.col("backward"), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))),
        ),
        lambda a: a.isNotNull(),
    )
    return kept.select(F.explode(both).alias("a"), "length_m").groupBy("a.src", "a.dst").agg(F.min("length_m").alias("length_m"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component of the arcs (src, dst)."""
    return components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("vertex").alias("node"), "component")


def ranked_components(labels: DataFrame) -> DataFrame:
    """(component, size, component_id): ids from 1 by falling size, equal sizes by the smaller node."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("_falling", -F.col("size"))
    return dense_numbers(sizes, ["_falling", "component"], "_n").select("component", "size", (F.col("_n") + 1).alias("component_id"))


#: Arcs that are broadcast to the tasks (24 bytes each); larger graphs are relaxed in rounds.
ARCS_IN_TASK = 2_000_000


def _heap_search(held: tuple, seeds: list[tuple], cutoff: float | None) -> dict:
    """node -> (distance, source) from seeds (cost, source, node) over arcs sorted by their end."""
    nodes, starts, befores, lengths = held
    at: dict = {}
    heap = [s for s in seeds if cutoff is None or s[0] <= cutoff]
    heapq.heapify(heap)
    while heap:
        distance, source, node = heapq.heappop(heap)
        if node in at:
            continue
        at[node] = (distance, source)
        i = int(np.searchsorted(nodes, node))
        if i == len(nodes) or nodes[i] != node:
            continue
        for j in range(starts[i], starts[i + 1]):
            further = distance + lengths[j]
            if befores[j] not in at and (cutoff is None or further <= cutoff):
                heapq.heappush(heap, (further, source, befores[j]))
    return at


def _broadcast_arcs(arcs_: DataFrame):
    """Arcs, counted by the caller, as sorted arrays in every task."""
    ship(arcs_.sparkSession)
    table = arcs_.select("src", "dst", "length_m").toPandas().sort_values(["dst", "src"])
    nodes, first = np.unique(table["dst"].to_numpy(), return_index=True)
    starts = np.append(first, len(table))
    return arcs_.sparkSession.sparkContext.broadcast((nodes, starts, table["src"].tolist(), table["length_m"].tolist()))


def _few_arcs(arcs_: DataFrame, most: int) -> bool:
    return arcs_.schema["src"].dataType.typeName() in ("long", "integer") and arcs_.limit(most + 1).count() <= most


def _broadcast_search(arcs_: DataFrame, seeds: DataFrame, keys: list[str], cutoff: float | None) -> DataFrame:
    held = _broadcast_arcs(arcs_)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = _heap_search(held.value, list(zip(pdf["cost"].tolist(), pdf["source"].tolist(), pdf["node"].tolist())), cutoff)
        out = pd.DataFrame({"node": list(at), "distance": [v[0] for v in at.values()], "source": [v[1] for v in at.values()]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "node", "distance", "source"]]

    schema = T.StructType([*[seeds.schema[k] for k in keys], seeds.schema["node"], T.StructField("distance", T.DoubleType()), seeds.schema["source"]])
    group = seeds.groupBy(*keys) if keys else seeds.groupBy(F.lit(0).alias("_all"))
    return group.applyInPandas(run, schema)


def nearest_source(arcs_: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), cutoff: float | None = None, arcs_in_task: int = ARCS_IN_TASK) -> DataFrame:
    """(keys..., node, distance, source): for each node the nearest seed along the arcs, travelled from the node to the seed.

    ``seeds`` (keys..., node, cost, source).  Equal distances go to the smaller source.  ``cutoff`` prunes the search.
    """
    by = [*keys, "node"]
    if _few_arcs(arcs_, arcs_in_task):
        # seeds of one node are one before they meet in a task
        best = seeds.groupBy(*by).agg(F.min(F.struct(F.col("cost").cast("double").alias("cost"), "source")).alias("s")).select(*by, "s.cost", "s.source")
        return _broadcast_search(arcs_, best, list(keys), cutoff)
    best_of = F.min(F.struct("distance", "source")).alias("best")
    limit = F.lit(True) if cutoff is None else F.col("distance") <= cutoff
    start = seeds.select(*by, F.col("cost").cast("double").alias("distance"), "source").where(limit)
    best = cut(start.groupBy(*by).agg(best_of).select(*by, "best.distance", "best.source"))
    frontier = best
    back = arcs_.select(F.col("dst").alias("node"), F.col("src").alias("_next"), "length_m")
    while not frontier.isEmpty():
        sent = frontier.join(back, "node").select(*keys, F.col("_next").alias("node"), (F.col("distance") + F.col("length_m")).alias("distance"), "source").where(limit)
        offered = sent.groupBy(*by).agg(best_of).select(*by, F.col("best.distance").alias("d2"), F.col("best.source").alias("s2"))
        joined = best.join(offered, by, "full")
        better = F.col("d2").isNotNull() & (
            F.col("distance").isNull() | (F.col("d2") < F.col("distance")) | ((F.col("d2") == F.col("distance")) & (F.col("s2") < F.col("source")))
        )
        merged = cut(
            joined.select(*by, F.when(better, F.col("d2")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("s2")).otherwise(F.col("source")).alias("source"), better.alias("_new"))
        )
        best, frontier = merged.drop("_new"), merged.where("_new").drop("_new")
    return best


def reach_distances(arcs_: DataFrame, origins: DataFrame, cutoff: float, arcs_in_task: int = ARCS_IN_TASK) -> DataFrame:
    """(origin_node, node, distance) for every node within ``cutoff`` of the distinct origin nodes (origin_node)."""
    reverse = arcs_.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m")
    # few bytes, much work: spread evenly, the planner would merge the partitions by bytes
    starts = origins.select("origin_node").distinct().repartition(int(arcs_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if _few_arcs(arcs_, arcs_in_task):
        held = _broadcast_arcs(reverse)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                origin_nodes, nodes, distances = [], [], []
                for origin in batch["origin_node"].tolist():
                    at = _heap_search(held.value, [(0.0, 0, origin)], cutoff)
                    origin_nodes += [origin] * len(at)
                    nodes += at
                    distances += [v[0] for v in at.values()]
                    if len(nodes) > 100_000:
                        yield pd.DataFrame({"origin_node": origin_nodes, "node": nodes, "distance": distances})
                        origin_nodes, nodes, distances = [], [], []
                yield pd.DataFrame({"origin_node": origin_nodes, "node": nodes, "distance": distances})

        node = starts.schema["origin_node"].dataType
        schema = T.StructType([T.StructField("origin_node", node), T.StructField("node", node), T.StructField("distance", T.DoubleType())])
        return starts.mapInPandas(run, schema)
    seeds = starts.select("origin_node", F.col("origin_node").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("source"))
    return nearest_source(reverse, seeds, ["origin_node"], cutoff, arcs_in_task).drop("source")


def reach_counts(arcs_: DataFrame, origins: DataFrame, destinations: DataFrame, radii: Sequence[int] = RADII, arcs_in_task: int = ARCS_IN_TASK) -> DataFrame:
    """(id, category, within_<radius>...): destinations whose arrival is at most radius less the origin's connector.

    ``origins`` (id, node, snap_m), ``destinations`` (key, category, node, snap_m).  One search per distinct node,
    cut off at the largest radius less the shortest connector there.  Destinations that share a node all count.
    """
    widest = float(max(radii))
    o = origins.select("id", F.col("node").alias("origin_node"), F.col("snap_m").alias("o_snap")).where(F.col("snap_m") <= widest)
    reached = reach_distances(arcs_, o, widest, arcs_in_task)
    arrivals = destinations.join(reached, "node").select("origin_node", "category", "key", (F.col("distance") + F.col("snap_m")).alias("arrival"))
    counted = [F.count_if(F.col("arrival") <= r - F.col("o_snap")).alias(f"within_{r}") for r in radii]
    return o.join(arrivals, "origin_node").groupBy("id", "category").agg(*counted)


def decay_index(minutes: Sequence[str], rate: float = 0.10) -> Column:
    """Sum of exp(-rate * minutes) over categories; a category that cannot be reached adds nothing."""
    out = F.lit(0.0)
    for m in minutes:
        out = out + F.coalesce(F.exp(-rate * F.col(m)), F.lit(0.0))
    return out


def route_status(reachable: Column, has_point: Column) -> Column:
    return F.when(~F.coalesce(has_point, F.lit(False)), "no_point").when(F.coalesce(reachable, F.lit(False)), "reachable").otherwise("unreachable")


def partial_edge_reach(distance_u: Column, length_m: Column, budget: float) -> Column:
    """The share of an edge that can be walked with what is left of the budget at its start."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(budget)) - distance_u) / length_m))
