"""Links between rows that describe the same place, without listing the pairs within a group.

Rows that share a key are linked to the smallest of them: n rows cost n - 1 edges, not n squared.  Distance rules work
on grid cells whose diagonal is the radius: rows of one cell are always near enough, and two cells need a single pair
of points near enough to be linked.  That pair is looked for in the boxes around the points of each cell's 4 x 4
parts: two boxes whose farthest corners are within the radius hold such a pair, two boxes whose nearest points are
not hold none, and what is left undecided is cut into 4 x 4 parts again.  A box around one point decides at once.
So two cells compare at most 16 boxes a depth with 16 others, however many points they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoskein.functions.text import normalized_name
from geoskein.plans.session import cut, ship

#: Parts of a cell along each axis (a power of two), cells of a block along each axis.
PARTS, BLOCK = 4, 8

# Metres within which equal names, equal Wikidata numbers mean one place.
NAME_METRES = {"food_social": 35.0, "cultural_tourist": 60.0, "station": 250.0}
WIKIDATA_METRES = {"food_social": 100.0, "cultural_tourist": 150.0, "station": 500.0}


def metres(by_category: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for category, m in by_category.items():
        out = F.when(F.col("category") == category, F.lit(m)).otherwise(out)
    return out


def shared_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) that connect the rows (vertex, keys...) of equal keys: each with the smallest of its key.

    Most keys have one row or two and are settled by the aggregate alone.
    """
    groups = cut(rows.groupBy(*keys).agg(F.min("vertex").alias("a"), F.max("vertex").alias("b"), F.count("*").alias("n")).where("a < b"))
    several = rows.join(groups.where("n > 2").select(*keys, "a"), keys).select("a", F.col("vertex").alias("b")).where("a < b")
    return groups.where("n = 2").select("a", "b").unionByName(several)


def _boxes(points: DataFrame, node: list[str], depth: int, carried: list[str]) -> DataFrame:
    """Each node (``node`` columns) with its points, the smallest vertex, and the boxes around the points of its parts of ``depth``."""
    fine = F.col("side") / float(PARTS**depth)
    parts = points.withColumn("ux", F.floor(F.col("x") / fine).cast("long")).withColumn("uy", F.floor(F.col("y") / fine).cast("long"))
    boxed = parts.groupBy(*node, "ux", "uy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("vertex").alias("least"), F.max("vertex").alias("most"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in carried],
    )
    # at most PARTS**2 boxes: dividing by a power of two is exact, so no part reaches over the rim of its node
    return boxed.groupBy(*node).agg(
        F.collect_list(F.struct("ux", "uy", "x0", "x1", "y0", "y1")).alias("boxes"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), *[F.first(c).alias(c) for c in carried],
    )


# SQL: squares of the least and the largest distance of the boxes p and q
_GAP = "greatest(0D, q.{c}0 - p.{c}1, p.{c}0 - q.{c}1)"
_SPAN = "greatest(q.{c}1 - p.{c}0, p.{c}1 - q.{c}0)"
_NEAREST = f"{_GAP.format(c='x')} * {_GAP.format(c='x')} + {_GAP.format(c='y')} * {_GAP.format(c='y')}"
_FARTHEST = f"{_SPAN.format(c='x')} * {_SPAN.format(c='x')} + {_SPAN.format(c='y')} * {_SPAN.format(c='y')}"


def _compared(pairs: DataFrame) -> DataFrame:
    """Adds ``linked``, and in ``open`` the pairs of parts that are undecided where nothing links, to pairs of nodes with ``left`` and ``right`` boxes."""
    linked = F.expr(f"exists(left, p -> exists(right, q -> {_FARTHEST} <= radius * radius))")
    undecided = F.expr(
        f"""flatten(transform(left, p -> transform(filter(right, q -> {_NEAREST} <= radius * radius),
                                                   q -> struct(p.ux as lux, p.uy as luy, q.ux as rux, q.uy as ruy))))"""
    )
    return pairs.withColumn("linked", linked).withColumn("open", F.when(~F.col("linked"), undecided))


def near_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) that connect exactly the rows (vertex, keys..., radius, x, y) of equal keys joined by steps of at most ``radius``.

    The keys travel as one digest of 16 bytes, and keys that a single row has are left out before cells are made.
    Cells meet their neighbours in blocks of cells: a cell is sent to the blocks within two cells of it.
    """
    side = F.col("radius") / math.sqrt(2.0) * (1 - 1e-9)
    digest = F.unhex(F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], F.col("radius").cast("string"))))
    placed = rows.where("x is not null and y is not null and radius > 0 and not isnan(x) and not isnan(y)").select("vertex", digest.alias("k"), "radius", side.alias("side"), "x", "y")
    several = placed.groupBy("k").count().where("count > 1").select("k")
    cell = lambda c: F.floor(F.col(c) / F.col("side")).cast("long")
    celled = cut(placed.join(several, "k", "left_semi").withColumn("cx", cell("x")).withColumn("cy", cell("y")))
    cells = cut(_boxes(celled, ["k", "cx", "cy"], 1, ["radius"]))
    inside = cells.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    crowd = celled.join(cells.where("n > 2").select("k", "cx", "cy", "least"), ["k", "cx", "cy"]).select(F.col("least").alias("a"), F.col("vertex").alias("b"))

    block = lambda c, d: F.floor((F.col(c) + d) / BLOCK).cast("long")
    lefts = cells.select("k", block("cx", 0).alias("bx"), block("cy", 0).alias("by"), "cx", "cy", "radius", F.col("boxes").alias("left"), F.col("least").alias("a"))
    rights = (
        cells.select("k", "cx", "cy", F.col("boxes").alias("right"), F.col("least").alias("b"), F.explode(F.array_distinct(F.array(block("cx", -2), block("cx", 0)))).alias("bx"))
        .withColumn("by", F.explode(F.array_distinct(F.array(block("cy", -2), block("cy", 0), block("cy", 2)))))
        .withColumnsRenamed({"cx": "rx", "cy": "ry"})
    )
    # each pair of cells at most two apart once: the right one follows in x, then in y
    beside = lefts.join(rights, ["k", "bx", "by"]).where("rx between cx and cx + 2 and ry between cy - 2 and cy + 2 and (rx > cx or ry > cy)")
    met = cut(_compared(beside).where("linked or size(open) > 0").select("k", "radius", "a", "b", "cx", "cy", "rx", "ry", "linked", "open"))
    links = [met.where("linked").select("a", "b")]
    undecided = met.where("not linked")
    depth = 1
    while not undecided.isEmpty():
        # the parts asked for become the nodes of the next depth
        asked = cut(undecided.select("k", "radius", "a", "b", F.explode("open").alias("o")).select("k", "radius", "a", "b", "o.*"))
        node = ["k", "ux", "uy"]
        wanted = asked.select("k", F.explode(F.array(F.struct(F.col("lux").alias("ux"), F.col("luy").alias("uy")), F.struct(F.col("rux").alias("ux"), F.col("ruy").alias("uy")))).alias("u")).select("k", "u.*").distinct()
        fine = F.col("side") / float(PARTS**depth)
        inner = celled.withColumn("ux", F.floor(F.col("x") / fine).cast("long")).withColumn("uy", F.floor(F.col("y") / fine).cast("long")).join(wanted, node, "left_semi")
        named = inner.withColumnsRenamed({"ux": "nx", "uy": "ny"})
        nodes = _boxes(named, ["k", "nx", "ny"], depth + 1, []).select("k", "nx", "ny", "boxes")
        nodes = cut(nodes)
        pairs = asked.join(nodes.withColumnsRenamed({"nx": "lux", "ny": "luy", "boxes": "left"}), ["k", "lux", "luy"]).join(
            nodes.withColumnsRenamed({"nx": "rux", "ny": "ruy", "boxes": "right"}), ["k", "rux", "ruy"]
        )
        judged = _compared(pairs.select("k", "radius", "a", "b", "left", "right")).where("linked or size(open) > 0")
        # one link settles two cells, whatever their other parts say; open parts of the same cells stay rows of their own
        judged = cut(judged.select("k", "radius", "a", "b", "linked", "open"))
        found = judged.where("linked").select("a", "b").distinct()
        links.append(found)
        undecided = judged.where("not linked").join(found, ["a", "b"], "left_anti")
        depth += 1
    out = inside.unionByName(crowd.where("a < b"))
    for link in links:
        out = out.unionByName(link)
    return out


def osm_objects(rows: DataFrame) -> DataFrame:
    """(vertex, snapshot_date, osm_type, osm_id) of the objects each row stands for: its own and those in ``merged_osm_refs``.

    References come as objects with type and id (number or text) or as "type/id"; unreadable ones give none.
    """
    own = F.array(F.struct(F.col("osm_type").alias("t"), F.col("osm_id").cast("string").alias("i")))
    as_objects = F.from_json("merged_osm_refs", "array<struct<osm_type:string,osm_id:string>>")
    as_texts = F.from_json("merged_osm_refs", "array<string>")
    listed = F.when(
        F.try_parse_json("merged_osm_refs").isNull(), F.array().cast("array<struct<t:string,i:string>>")
    ).otherwise(
        F.concat(
            F.coalesce(F.transform(as_objects, lambda o: F.struct(o["osm_type"].alias("t"), o["osm_id"].alias("i"))), F.array().cast("array<struct<t:string,i:string>>")),
            F.coalesce(
                F.transform(
                    F.filter(as_texts, lambda s: s.rlike(r"^\s*[A-Za-z]+/[0-9]+\s*$")),
                    lambda s: F.struct(F.trim(F.substring_index(s, "/", 1)).alias("t"), F.trim(F.substring_index(s, "/", -1)).alias("i")),
                ),
                F.array().cast("array<struct<t:string,i:string>>"),
            ),
        )
    )
    each = rows.select("vertex", "snapshot_date", F.explode(F.concat(own, listed)).alias("o"))
    return each.where("o.t is not null and o.i is not null").select(
        "vertex", "snapshot_date", F.lower("o.t").alias("osm_type"), F.expr("try_cast(o.i as bigint)").alias("osm_id")
    ).where("osm_id is not null").distinct()


def place_links(pois: DataFrame) -> DataFrame:
    """Edges between rows of ``osm_pois`` that describe one place, by shared objects, names or Wikidata numbers."""
    ship(pois.sparkSession)
    rows = cut(
        pois.select(
            F.concat(F.lit("r"), "destination_key").alias("vertex"), "snapshot_date", "category", "osm_type", "osm_id", "merged_osm_refs",
            normalized_name(F.col("name")).alias("norm"),
            F.ltrim(F.regexp_extract(F.coalesce("wikidata_id", F.lit("")), r"(?i)(?:^|[^a-z0-9])q0*([0-9]+)(?![a-z0-9])", 1)).alias("qid"),
            F.col("geom_25832.x").alias("x"), F.col("geom_25832.y").alias("y"),
        )
    )
    shared = shared_links(cut(osm_objects(rows)), ["snapshot_date", "osm_type", "osm_id"])
    named = rows.where("norm <> ''").withColumn("radius", metres(NAME_METRES)).withColumn("tie", F.concat(F.lit("name:"), "norm"))
    numbered = rows.where("qid <> ''").withColumn("radius", metres(WIKIDATA_METRES)).withColumn("tie", F.concat(F.lit("q:"), "qid"))
    tied = named.unionByName(numbered).select("vertex", "snapshot_date", "category", "tie", "radius", "x", "y")
    return shared.unionByName(near_links(tied, ["snapshot_date", "category", "tie"]))
