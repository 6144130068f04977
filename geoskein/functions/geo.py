"""Planar geometry and the map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid and the projection of UTM zone 32 north (ETRS89, EPSG:25832).
SEMI_MAJOR = 6378137.0
ECC = 0.0066943799901413165
SCALE = 0.9996
CENTRAL_MERIDIAN = 9.0
FALSE_EASTING = 500000.0
EARTH_RADIUS = 6371008.8


def with_utm32(df: DataFrame, longitude: str = "lon", latitude: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Easting ``x`` and northing ``y`` in metres of WGS84 degrees, by the transverse Mercator series to the sixth power.

    The shared terms are columns of their own, so that the generated code computes each of them once.
    """
    e2, e4, e6 = ECC, ECC**2, ECC**3
    ep = ECC / (1 - ECC)
    terms = df.withColumns({"_phi": F.radians(latitude), "_lam": F.radians(longitude) - math.radians(CENTRAL_MERIDIAN)})
    phi = F.col("_phi")
    terms = terms.withColumns({"_sin": F.sin(phi), "_cos": F.cos(phi), "_tan": F.tan(phi)})
    terms = terms.withColumns(
        {
            "_nu": SEMI_MAJOR / F.sqrt(1 - e2 * F.col("_sin") * F.col("_sin")),
            "_t": F.col("_tan") * F.col("_tan"),
            "_c": ep * F.col("_cos") * F.col("_cos"),
            "_a": F.col("_cos") * F.col("_lam"),
            # meridian arc: coefficients of phi, sin 2phi, sin 4phi, sin 6phi
            "_arc": SEMI_MAJOR
            * (
                (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
                + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
                - (35 * e6 / 3072) * F.sin(6 * phi)
            ),
        }
    )
    t, c, a, a2 = F.col("_t"), F.col("_c"), F.col("_a"), F.col("_a") * F.col("_a")
    # Horner form in the square of a
    east = a * (1 + a2 / 6 * ((1 - t + c) + a2 / 20 * (5 - 18 * t + t * t + 72 * c - 58 * ep)))
    north = a2 / 2 * (1 + a2 / 12 * ((5 - t + 9 * c + 4 * c * c) + a2 / 30 * (61 - 58 * t + t * t + 600 * c - 330 * ep)))
    projected = terms.withColumns({x: SCALE * F.col("_nu") * east + FALSE_EASTING, y: SCALE * (F.col("_arc") + F.col("_nu") * F.col("_tan") * north)})
    return projected.drop("_phi", "_lam", "_sin", "_cos", "_tan", "_nu", "_t", "_c", "_a", "_arc")


def utm32_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same projection as SQL text, for checks in another engine."""
    e2, ep = ECC, ECC / (1 - ECC)
    phi, lam = f"radians({lat})", f"(radians({lon}) - {math.radians(CENTRAL_MERIDIAN)!r})"
    nu = f"({SEMI_MAJOR} / sqrt(1 - {e2!r} * sin({phi}) * sin({phi})))"
    t, c, a = f"(tan({phi}) * tan({phi}))", f"({ep!r} * cos({phi}) * cos({phi}))", f"(cos({phi}) * {lam})"
    k0, k2 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    k4, k6 = 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072
    arc = f"({SEMI_MAJOR} * ({k0!r} * {phi} - {k2!r} * sin(2 * {phi}) + {k4!r} * sin(4 * {phi}) - {k6!r} * sin(6 * {phi})))"
    a2 = f"({a} * {a})"
    east = f"({a} * (1 + {a2} / 6 * ((1 - {t} + {c}) + {a2} / 20 * (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * ep!r}))))"
    north = f"({a2} / 2 * (1 + {a2} / 12 * ((5 - {t} + 9 * {c} + 4 * {c} * {c}) + {a2} / 30 * (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * ep!r}))))"
    return f"({SCALE} * {nu} * {east} + {FALSE_EASTING})", f"({SCALE} * ({arc} + {nu} * tan({phi}) * {north}))"


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def cell(value: Column, size: float | Column) -> Column:
    """Number of the grid cell; floor, so that negative coordinates fall below zero."""
    return F.floor(value / size).cast("long")


def ring_edges(rings: Column) -> Column:
    """Array of edges struct(x1, y1, x2, y2) of an array of rings of points; rings need not repeat their first point."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)
        closed = F.when(n > 0, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
        return F.transform(
            F.filter(F.transform(closed, lambda p, i: F.struct(p.alias("p"), F.try_element_at(closed, (i + 2).cast("int")).alias("q"))), lambda e: e["q"].isNotNull()),
            lambda e: F.struct(e["p"]["x"].alias("x1"), e["p"]["y"].alias("y1"), e["q"]["x"].alias("x2"), e["q"]["y"].alias("y2")),
        )

    edges = F.flatten(F.transform(rings, of_ring))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray to the right of the point meets the edge (half-open in y)."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def on_edge(x: Column, y: Column, e: Column) -> Column:
    """Whether the point lies on the edge."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    between = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return (cross == 0) & between


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over all edges of an area, holes and parts alike."""
    return F.size(F.filter(edges, lambda e: crosses(x, y, e))) % 2 == 1


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment; a segment of no length counts as its point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((x - x1) * dx + (y - y1) * dy) / length).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(squared_distance(x, y, x1 + along * dx, y1 + along * dy))
