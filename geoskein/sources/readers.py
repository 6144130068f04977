"""Readers: text-first CSV, statistical matrices, GeoJSON, way and element dumps, boundary polygons."""

from __future__ import annotations

import glob
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.plans.session import cut

RESERVED = ("_source_file_id", "_source_row_number")
MOST_NAME_BYTES = 63


class SourceError(ValueError):
    """A source that does not hold what its reader requires."""


def check_names(names: Sequence[str]) -> None:
    """Refuses empty, NUL, overlong, duplicate and reserved column names."""
    if not names:
        raise SourceError("the source has no columns")
    for name in names:
        if not name or "\0" in name or len(name.encode()) > MOST_NAME_BYTES or name in RESERVED:
            raise SourceError(f"column name {name!r} is empty, overlong or reserved")
    if len(set(names)) != len(names):
        raise SourceError("column names repeat")


def header_names(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """The names in the first line, without a byte order mark."""
    line = spark.read.option("encoding", encoding).option("wholetext", "false").text(path).first()
    if line is None:
        raise SourceError(f"{path} is empty")
    parsed = spark.range(1).select(F.from_csv(F.lit(line[0].removeprefix("﻿")), ", ".join(f"c{i} string" for i in range(line[0].count(sep) + 1)), {"sep": sep}).alias("r")).first()["r"]
    names = [x for x in parsed]
    while names and names[-1] is None:
        names.pop()
    return [x or "" for x in names]


def text_csv(spark: SparkSession, path: str, source_file_id: int, sep: str = ",", encoding: str = "UTF-8", header: bool = True, numbered: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Every field as text, empty fields kept as '' (only ``\\N`` is NULL), with the file's id and 1-based row numbers.

    Headerless files get field_1 ... field_n.  A record of another width stops the read.  gzip is transparent.
    ``columns`` prunes the scan to those that the file has.
    """
    if header:
        names = header_names(spark, path, sep, encoding)
    else:
        first = spark.read.csv(path, sep=sep, encoding=encoding, header=False).limit(1)
        names = [f"field_{i + 1}" for i in range(len(first.columns))]
    check_names(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, sep=sep, encoding=encoding, header=header, mode="FAILFAST", nullValue="\\N", emptyValue="", quote='"', escape='"', multiLine=True, enforceSchema=True)
    df = df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]) if columns is None else df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names if n in set(columns)])
    df = df.withColumn(RESERVED[0], F.lit(source_file_id).cast("long"))
    if numbered:
        # dense numbers in the order of the file: places within partitions, and an offset per partition
        marked = cut(df.withColumn("_m", F.monotonically_increasing_id()))
        per = marked.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = F.broadcast(per.select("_p", before.alias("_before")))  # a row per partition
        place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        df = marked.withColumn("_p", F.shiftright("_m", 33)).join(offsets, "_p").withColumn(RESERVED[1], F.col("_before") + place + 1).drop("_m", "_p", "_before")
    return df


def statistics_csv(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated statistical table in UTF-8, with or without byte order mark, as texts."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def decoded_text(raw: Column) -> Column:
    """Bytes as UTF-8 without its mark, or as ISO-8859-1 where they are not UTF-8."""
    utf8 = F.try_validate_utf8(raw.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(raw, "ISO-8859-1")), "\\A\\ufeff", "")


def tidy_label(label: Column) -> Column:
    """White space, also the unbreakable, to single spaces."""
    return F.trim(F.regexp_replace(label, r"[\s\u00a0]+", " "))


def decimal_comma(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def unpivot_matrix(df: DataFrame, keys: Sequence[str], codes: DataFrame, value: str = "value") -> DataFrame:
    """A wide matrix to (keys..., code, label, value) by its sidecar (field, code, label): the order of fields is the codes' own."""
    fields = [c for c in df.columns if c not in set(keys)]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(value)) for c in fields])).alias("p")).select(*keys, "p.field", f"p.{value}")
    return long.join(codes, "field").select(*keys, "code", "label", value)


GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_areas(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """(properties, rings) of the polygons and multipolygons of a FeatureCollection; rings hold struct(x, y).

    Other geometry types, open or short rings and coordinates out of bounds stop the read.
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", GEOJSON).alias("d"))
    feature = doc.select(F.explode("d.features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    polygon = F.from_json("c", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
    raw = F.when(F.col("kind") == "Polygon", polygon).when(F.col("kind") == "MultiPolygon", multi)
    rings = F.transform(raw, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    out = feature.select("properties", "kind", rings.alias("rings"))
    x0, y0, x1, y1 = bounds
    good = F.forall(
        "rings",
        lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)),
    )
    checked = F.when(F.col("rings").isNull() | ~F.coalesce(good, F.lit(False)), F.raise_error(F.concat(F.lit("not a valid polygon: "), F.coalesce("kind", F.lit("no geometry"))))).otherwise(F.col("rings"))
    return out.select("properties", checked.alias("rings"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry_type, x, y) of line-separated GeoJSON point features, one per line: splittable."""
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:array<double>>"
    return spark.read.schema(schema).json(path).select("properties", F.col("geometry.type").alias("geometry_type"), F.get("geometry.coordinates", F.lit(0)).alias("x"), F.get("geometry.coordinates", F.lit(1)).alias("y"))


def overpass_elements(spark: SparkSession, path: str) -> DataFrame:
    """(osm_type, osm_id, tags, nodes, lat, lon) of an element dump; a way's point is its centre."""
    schema = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,nodes:array<long>,tags:map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    return e.select(
        F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), "e.tags", "e.nodes",
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"),
    )


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(osm_id, lon, lat): the mean position of a way's nodes (nodes: node_id, lon, lat)."""
    each = ways.select("osm_id", F.explode("nodes").alias("node_id"))
    return each.join(nodes, "node_id").groupBy("osm_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def poly_ring(text: str) -> list[tuple[float, float]]:
    """The first ring of a .poly boundary file, closed."""
    ring: list[tuple[float, float]] = []
    for line in text.splitlines()[2:]:
        if line.strip() == "END":
            break
        x, y = map(float, line.split()[:2])
        ring.append((x, y))
    if len(ring) < 3:
        raise SourceError("the boundary has no ring")
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def latest_file(pattern: str) -> str:
    """The one file a pattern names; several are ambiguous."""
    found = sorted(glob.glob(pattern))
    if len(found) != 1:
        raise SourceError(f"{pattern}: {len(found)} files ({', '.join(map(os.path.basename, found))})")
    return found[0]
