"""Graph and entity-resolution queries.

The graph is a square grid over all parts: node = p_partkey, an arc both ways to the right neighbour and one way down,
with lengths from p_size.  Suppliers are destinations, customers origins, each snapped to a node by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.functions.text import ascii_name, normalized_name
from geoskein.operators import graph, resolve
from geoskein.plans.session import cut, table

WIDTH = 40
RADII = graph.RADII


def segments(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.col("p_size").cast("double").alias("s"))
    last = part.agg(F.max("u")).first()[0] or 0
    right = part.where((F.col("u") % WIDTH < WIDTH - 1) & (F.col("u") < last)).select("u", (F.col("u") + 1).alias("v"), (F.col("s") * 10).alias("length_m"), F.lit(True).alias("forward"), F.lit(True).alias("backward"))
    down = part.where(F.col("u") + WIDTH <= last).select("u", (F.col("u") + WIDTH).alias("v"), (F.col("s") * 10 + 5).alias("length_m"), F.lit(True).alias("forward"), F.lit(False).alias("backward"))
    return right.unionByName(down)


ARCS_CTE = f"""
    part_last as (select max(p_partkey) as last from part),
    arcs as (
        select p_partkey as src, p_partkey + 1 as dst, p_size * 10.0 as length_m from part, part_last where p_partkey % {WIDTH} < {WIDTH - 1} and p_partkey < last
        union all select p_partkey + 1, p_partkey, p_size * 10.0 from part, part_last where p_partkey % {WIDTH} < {WIDTH - 1} and p_partkey < last
        union all select p_partkey, p_partkey + {WIDTH}, p_size * 10.0 + 5 from part, part_last where p_partkey + {WIDTH} <= last)"""


def graph_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs of the graph, parallel ones at their shortest."""
    seg = segments(spark, d)
    doubled = seg.unionByName(seg.withColumn("length_m", F.col("length_m") + 1))
    return graph.arcs(doubled)


GRAPH_ARCS = f"with {ARCS_CTE} select src, dst, cast(min(length_m) as double) as length_m from arcs group by 1, 2"


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.arcs(segments(spark, d)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


NODE_DEGREE = f"with {ARCS_CTE}, g as (select src, count(*) as degree from (select distinct src, dst from arcs) group by 1) select degree, count(*) as nodes from g group by 1"


def weak_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the grid without its long edges, largest first."""
    short = graph.arcs(segments(spark, d)).where("length_m <= 260")
    ranked = graph.ranked_components(cut(graph.weak_components(short)))
    return ranked.select(F.col("component").alias("least_node"), "size", "component_id")


WEAK_COMPONENTS = f"""
with recursive {ARCS_CTE},
e as (select src as a, dst as b from arcs where length_m <= 260 union select dst, src from arcs where length_m <= 260),
lab(node, label) using key (node) as (
    select distinct a, a from e
    union
    select e.b, min(l.label) from lab l join e on l.node = e.a join recurring.lab r on r.node = e.b where l.label < r.label group by e.b)
select least_node, size, row_number() over (order by size desc, least_node) as component_id from (select label as least_node, count(*) as size from lab group by 1)
"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    s = table(spark, d, "supplier")
    return s.select(((F.col("s_suppkey") * 131) % n + 1).alias("node"), (F.col("s_nationkey") * 1.0).alias("cost"), F.col("s_suppkey").alias("source"))


def multi_source_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For every node the nearest supplier along the arcs, with its connector."""
    return graph.nearest_source(graph.arcs(segments(spark, d)), _seeds(spark, d))


_SEEDS_SQL = "seeds as (select (s_suppkey * 131) % last + 1 as node, s_nationkey * 1.0 as cost, s_suppkey as source from supplier, part_last)"
MULTI_SOURCE_NEAREST = f"""
with recursive {ARCS_CTE}, {_SEEDS_SQL},
best(node, distance, source) using key (node) as (
    select node, min(cost), min_by(source, (cost, source)) from seeds group by node
    union
    select a.src, min(b.distance + a.length_m), min_by(b.source, (b.distance + a.length_m, b.source))
    from best b join arcs a on a.dst = b.node left join recurring.best r on r.node = a.src
    where r.node is null or b.distance + a.length_m < r.distance or (b.distance + a.length_m = r.distance and b.source < r.source) group by a.src)
select node, cast(distance as double) as distance, source from best
"""


def _origins(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 17) % n + 1).alias("node"), (F.col("c_nationkey") * 2.0).alias("snap_m"))


def _reach_destinations(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.pmod("source", F.lit(2)) == 0, "food_social").otherwise("cultural_tourist")
    return _seeds(spark, d).select(F.col("source").alias("key"), category.alias("category"), "node", F.col("cost").alias("snap_m"))


def budget_reach(spark: SparkSession, d: str) -> DataFrame:
    """Destinations within three budgets of walking, by origin and category."""
    arcs = cut(graph.arcs(segments(spark, d)))
    return graph.reach_counts(arcs, _origins(spark, d), _reach_destinations(spark, d), RADII)


BUDGET_REACH = f"""
with recursive {ARCS_CTE}, {_SEEDS_SQL},
orig as (select c_custkey as id, (c_custkey * 17) % last + 1 as node, c_nationkey * 2.0 as snap_m from customer, part_last),
reach(origin, node, distance) using key (origin, node) as (
    select distinct node, node, cast(0 as double) from orig
    union
    select b.origin, a.dst, min(b.distance + cast(a.length_m as double)) from reach b join arcs a on a.src = b.node left join recurring.reach r on r.origin = b.origin and r.node = a.dst
    where b.distance + cast(a.length_m as double) <= {max(RADII)} and (r.node is null or b.distance + cast(a.length_m as double) < r.distance) group by b.origin, a.dst),
arrive as (select r.origin, case when s.source % 2 = 0 then 'food_social' else 'cultural_tourist' end as category, r.distance + s.cost as arrival from reach r join seeds s on s.node = r.node)
select o.id, a.category, {", ".join(f"count(*) filter (a.arrival <= {r} - o.snap_m) as within_{r}" for r in RADII)} from orig o join arrive a on a.origin = o.node group by 1, 2
"""


def route_status(spark: SparkSession, d: str) -> DataFrame:
    """Origins by status of their way to the nearest supplier, and the decay index of their minutes."""
    best = multi_source_nearest(spark, d).withColumnRenamed("source", "supplier")
    o = _origins(spark, d).join(best, "node", "left")
    minutes = (F.col("distance") + F.col("snap_m")) / graph.WALK_METRES_PER_MINUTE
    o = o.withColumn("minutes", minutes).withColumn("status", graph.route_status(F.col("distance").isNotNull(), F.lit(True)))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("minutes"), 6).alias("mean_minutes"), F.round(F.sum(graph.decay_index(["minutes"])), 4).alias("decay_sum"))


ROUTE_STATUS = f"""
{MULTI_SOURCE_NEAREST.rsplit("select node", 1)[0].rstrip()},
o as (select c_custkey as id, (c_custkey * 17) % last + 1 as node, c_nationkey * 2.0 as snap_m from customer, part_last),
j as (select o.id, (best.distance + o.snap_m) / 80.0 as minutes from o left join best on best.node = o.node)
select case when minutes is null then 'unreachable' else 'reachable' end as status, count(*) as n, round(avg(cast(minutes as double)), 6) as mean_minutes,
       round(sum(coalesce(exp(-0.1 * cast(minutes as double)), 0)), 4) as decay_sum from j group by 1
"""


# Tag values drawn for each way from its key and the number of the tag; NULL is an absent tag.
WALK_TAGS = {
    "highway": ["footway", "residential", "cycleway", "motorway", "steps", "elevator", "busway", None, "platform", "escape", "bridleway", "primary"],
    "foot": [None, "yes", None, "no", "designated", None, "restricted", "official", "customers"],
    "access": [None, None, "private", "restricted", "no", "yes"],
    "area": [None, None, None, "yes", "no"],
    "oneway:foot": [None, None, "yes", "reverse", "-1", "1", "true", "no"],
    "conveying": [None, None, None, "backward", "forward", "reversible"],
    "foot:forward": [None, None, None, "no", "yes"],
    "foot:backward": [None, None, None, None, "private", "yes"],
}


def walk_permissions(spark: SparkSession, d: str) -> DataFrame:
    """Directions in which ways may be walked, for tags drawn from the order lines by their keys."""
    line = table(spark, d, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"))
    tags = {}
    for i, (tag, values) in enumerate(WALK_TAGS.items()):
        at = F.floor(F.col("k") * (2 * i + 3) / (i + 1)) % len(values)
        tags[tag] = F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at + 1).cast("int"))
    forward, backward = graph.walking_directions(tags)
    return line.groupBy(tags["highway"].alias("highway"), tags["foot"].alias("foot"), forward.alias("forward"), backward.alias("backward")).agg(F.count("*").alias("n"))


def _drawn(i: int, tag: str, values: list) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"""([{listed}])[cast(floor(k * {2 * i + 3} / {i + 1}) % {len(values)} + 1 as int)] as {tag.replace(":", "_")}"""


# Written from the order of the rules, one common table expression per step.
WALK_PERMISSIONS = f"""
with lines as (select l_orderkey * 7 + l_linenumber as k from lineitem),
t as (select {", ".join(_drawn(i, tag, values) for i, (tag, values) in enumerate(WALK_TAGS.items()))} from lines),
judged as (
    select *, case
        when highway is null or highway in ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'raceway', 'construction', 'proposed', 'abandoned', 'corridor', 'escape') then false
        when area = 'yes' then false
        when foot in ('no', 'private', 'restricted') then false
        when access in ('no', 'private') and (foot is null or foot not in ('yes', 'designated', 'permissive', 'official')) then false
        when highway in ('footway', 'pedestrian', 'path', 'steps', 'living_street', 'residential', 'service', 'unclassified', 'tertiary', 'tertiary_link',
                         'secondary', 'secondary_link', 'primary', 'primary_link', 'track', 'road', 'platform') then true
        when highway in ('cycleway', 'bridleway', 'busway') and foot in ('yes', 'designated', 'permissive', 'official') then true
        else false end as walk,
        case when oneway_foot in ('yes', '1', 'true') or conveying = 'forward' then 'forward'
             when oneway_foot in ('-1', 'reverse') or conveying = 'backward' then 'backward' else 'both' end as way from t)
select highway, foot, walk and way <> 'backward' and (foot_forward is null or foot_forward not in ('no', 'private', 'restricted')) as forward,
       walk and way <> 'forward' and (foot_backward is null or foot_backward not in ('no', 'private', 'restricted')) as backward, count(*) as n
from judged group by 1, 2, 3, 4
"""


def dedup_transitive(spark: SparkSession, d: str) -> DataFrame:
    """Chains of equal names within 200 m per snapshot, and of unnamed rows within 0.5 m."""
    pois = table(spark, d, "osm_pois").select(F.col("destination_key").alias("key"), "snapshot_date", F.trim("name").alias("name"), F.col("geom_25832.x").alias("x"), F.col("geom_25832.y").alias("y"))
    return resolve.transitive_duplicates(pois, same_name_m=200.0, keys=["snapshot_date"]).where("group_size > 1")


DEDUP_TRANSITIVE = """
with recursive p as (select destination_key as key, snapshot_date, coalesce(trim(name), '') as name, geom_25832.x as x, geom_25832.y as y from osm_pois),
e as (select a.key as a, b.key as b from p a join p b on a.snapshot_date = b.snapshot_date and a.name = b.name and a.key <> b.key
      and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= case when a.name = '' then 0.25 else 40000 end),
lab(key, label) using key (key) as (
    select distinct a, a from e union
    select e.b, min(l.label) from lab l join e on l.key = e.a join recurring.lab r on r.key = e.b where l.label < r.label group by e.b)
select key, label as canonical_key, count(*) over (partition by label) as group_size from lab
"""


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    norm = normalized_name(F.col("name"))
    qid = F.regexp_extract(F.coalesce("wikidata_id", F.lit("")), r"(?i)(?:^|[^a-z0-9])q0*([0-9]+)(?![a-z0-9])", 1)
    by_day = lambda c: F.when(c != "", F.concat(F.col("snapshot_date").cast("string"), F.lit("|"), c)).otherwise("")
    return table(spark, d, "osm_pois").select(
        F.col("destination_key").alias("key"), "category", "osm_type", "osm_id", by_day(norm).alias("norm"), by_day(qid).alias("qid"), F.col("geom_25832.x").alias("x"), F.col("geom_25832.y").alias("y")
    )


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a snapshot merged into the canonical ones found before them."""
    return resolve.greedy_duplicates(cut(_greedy(spark, d)))


def merged_references(spark: SparkSession, d: str) -> DataFrame:
    """Canonical rows with the objects merged into them."""
    rows = cut(_greedy(spark, d))
    refs = resolve.merged_references(rows, cut(resolve.greedy_duplicates(rows)))
    return refs.select("canonical_key", F.to_json("merged_refs").alias("merged_refs"), "duplicate_count").where("duplicate_count > 0")


def ascii_names(spark: SparkSession, d: str) -> DataFrame:
    """Destinations per strictly normalised name."""
    return table(spark, d, "osm_pois").select(ascii_name(F.col("name")).alias("plain")).groupBy("plain").agg(F.count("*").alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        graph_arcs, node_degree, weak_components, multi_source_nearest, budget_reach, route_status, walk_permissions, dedup_transitive, dedup_greedy, merged_references, ascii_names,
    )
}
SQL = {
    "graph_arcs": GRAPH_ARCS, "node_degree": NODE_DEGREE, "weak_components": WEAK_COMPONENTS, "multi_source_nearest": MULTI_SOURCE_NEAREST, "budget_reach": BUDGET_REACH,
    "route_status": ROUTE_STATUS, "walk_permissions": WALK_PERMISSIONS, "dedup_transitive": DEDUP_TRANSITIVE,
}
