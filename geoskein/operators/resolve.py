"""Entity resolution: greedy ordered and transitive deduplication of points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.operators.graph import weak_components
from geoskein.operators.spatial import within_distance
from geoskein.plans.session import cut, ship

# Metres by category for equal names and equal Wikidata numbers.
NAME_METRES = {"food_social": 35.0, "cultural_tourist": 60.0, "station": 250.0}
WIKIDATA_METRES = {"food_social": 100.0, "cultural_tourist": 150.0, "station": 500.0}
TYPE_ORDER = {"node": 0, "way": 1, "relation": 2}


def transitive_duplicates(points: DataFrame, same_name_m: float = 3.0, unnamed_m: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """(key, canonical_key, group_size) of points (key, name, x, y, keys...): chains of equal non-empty names within
    ``same_name_m`` or of unnamed points within ``unnamed_m``, of equal ``keys``; canonical is the smallest key."""
    named = points.withColumn("name", F.coalesce("name", F.lit(""))).select("key", "name", "x", "y", *keys)

    def linked(rows: DataFrame, metres: float) -> DataFrame:
        left = rows.select(F.col("key").alias("id"), "name", "x", "y", *keys)
        right = rows.select(F.col("key").alias("other_id"), "name", F.col("x").alias("other_x"), F.col("y").alias("other_y"), *keys)
        return within_distance(left, right, metres, ["name", *keys]).where("id < other_id").select(F.col("id").alias("src"), F.col("other_id").alias("dst"))

    groups = weak_components(linked(named.where("name <> ''"), same_name_m).unionByName(linked(named.where("name = ''"), unnamed_m)))
    labelled = points.select("key").join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("canonical_key"))
    labelled = cut(labelled)
    return labelled.join(labelled.groupBy("canonical_key").agg(F.count("*").alias("group_size")), "canonical_key").select("key", "canonical_key", "group_size")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows that may merge: equal names or numbers in neighbouring grid cells of the widest radius, joined transitively."""
    reach = F.lit(None).cast("double")
    for category in NAME_METRES:
        reach = F.when(F.col("category") == category, F.lit(max(NAME_METRES[category], WIKIDATA_METRES[category]))).otherwise(reach)
    ties = F.filter(
        F.array(F.when(F.col("norm") != "", F.concat(F.lit("n:"), "norm")), F.when(F.col("qid").isNotNull() & (F.col("qid") != ""), F.concat(F.lit("q:"), "qid"))),
        lambda t: t.isNotNull(),
    )
    celled = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumn("_r", reach).select("key", "category", F.explode(ties).alias("tie"), F.floor(F.col("x") / F.col("_r")).alias("cx"), F.floor(F.col("y") / F.col("_r")).alias("cy"))
    named = lambda cx, cy: F.concat_ws("|", F.lit("~cell"), "category", "tie", cx.cast("string"), cy.cast("string"))
    own = celled.select(F.col("key").alias("src"), named(F.col("cx"), F.col("cy")).alias("dst"))
    cells = celled.select("category", "tie", "cx", "cy").distinct()
    step = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = cells.select("category", "tie", "cx", "cy", F.explode(step).alias("s")).select("category", "tie", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    across = moved.join(cells, ["category", "tie", "cx", "cy"]).select(named(F.col("ox"), F.col("oy")).alias("src"), named(F.col("cx"), F.col("cy")).alias("dst"))
    return weak_components(own.unionByName(across)).where(~F.col("node").startswith("~cell|")).select(F.col("node").alias("key"), F.col("component").alias("block"))


def _merge_block(pdf: pd.DataFrame, name_m: Mapping[str, float], number_m: Mapping[str, float]) -> pd.DataFrame:
    """Works a block through in order.  Canonical rows lie in a grid per tie: as they keep their distance, few share a cell."""
    order = pdf.assign(rank=pdf["osm_type"].map(TYPE_ORDER).fillna(9)).sort_values(["category", "rank", "osm_id", "key"])
    canonical: dict[tuple, list] = {}
    out = []
    for row in order.itertuples(index=False):
        best, own_cells = None, []
        for kind, reason, value, metres in (("q", "same_wikidata_nearby", row.qid, number_m), ("n", "same_name_nearby", row.norm, name_m)):
            if not isinstance(value, str) or not value:
                continue
            limit = metres[row.category]
            cx, cy = math.floor(row.x / limit), math.floor(row.y / limit)
            own_cells.append((row.category, kind, value, cx, cy))
            near = (other for dx in (-1, 0, 1) for dy in (-1, 0, 1) for other in canonical.get((row.category, kind, value, cx + dx, cy + dy), ()))
            for other in near:
                if math.hypot(row.x - other.x, row.y - other.y) <= limit:
                    rank = (other.rank, other.osm_id, 0 if kind == "q" else 1, other.key)
                    if best is None or rank < best[0]:
                        best = (rank, other.key, reason)
        if best:
            out.append((row.key, best[1], best[2]))
            continue
        for cell in own_cells:
            canonical.setdefault(cell, []).append(row)
        out.append((row.key, row.key, "canonical"))
    return pd.DataFrame(out, columns=["key", "canonical_key", "reason"])


def greedy_duplicates(rows: DataFrame, name_m: Mapping[str, float] = NAME_METRES, number_m: Mapping[str, float] = WIKIDATA_METRES) -> DataFrame:
    """(key, canonical_key, reason) of rows (key, category, osm_type, osm_id, norm, qid, x, y).

    In the order node, way, relation and id, a row merges into an already canonical row of its category with the same
    number or the same name near enough, preferring the first in that order; merging does not chain.  Rows that can
    never merge are canonical without a visit; the others are worked through block by block, a block being rows that
    chains of near cells with equal names or numbers hold together.
    """
    ship(rows.sparkSession)
    blocks = cut(_blocks(rows))
    sizes = blocks.groupBy("block").count().where("count > 1").select("block")
    open_ = rows.join(blocks.join(sizes, "block"), "key")
    schema = T.StructType([rows.schema["key"], T.StructField("canonical_key", T.StringType()), T.StructField("reason", T.StringType())])
    merged = cut(open_.groupBy("block").applyInPandas(lambda pdf: _merge_block(pdf, dict(name_m), dict(number_m)), schema))
    alone = rows.select("key").join(merged.select("key"), "key", "left_anti")
    return merged.unionByName(alone.select("key", F.col("key").alias("canonical_key"), F.lit("canonical").alias("reason")))


def merged_references(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(canonical_key, merged_refs, duplicate_count): the objects of a canonical row and of those merged into it, in order."""
    refs = rows.join(resolved, "key").groupBy("canonical_key").agg(F.sort_array(F.collect_set(F.struct("osm_type", "osm_id"))).alias("merged_refs"), F.count("*").alias("_n"))
    return refs.select("canonical_key", "merged_refs", (F.col("_n") - 1).alias("duplicate_count"))
