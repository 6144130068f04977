"""Classes of map objects from their tags; absent tags are NULL columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag values that qualify an object for a category.
FOOD_AMENITIES = ("restaurant", "cafe", "bar", "pub")
CULTURE_TOURISM = ("museum", "gallery", "attraction", "viewpoint")
CULTURE_AMENITIES = ("theatre",)
CULTURE_HISTORIC = ("monument", "castle", "palace")
STATION_RAILWAY = ("station", "halt")
STATION_MODES = ("subway", "light_rail", "train")

Tag = Callable[[str], Column]


def has(tag: Tag, key: str, *values: str) -> Column:
    return F.coalesce(tag(key).isin(*values), F.lit(False))


def is_station(tag: Tag) -> Column:
    """A named railway station or halt, or a named public transport station of trains or undergrounds."""
    by_transport = has(tag, "public_transport", "station") & (has(tag, "train", "yes") | has(tag, "subway", "yes") | has(tag, "station", *STATION_MODES))
    return (F.coalesce(tag("name"), F.lit("")) != "") & (has(tag, "railway", *STATION_RAILWAY) | by_transport)


def station_mode(tag: Tag) -> Column:
    metro = has(tag, "station", "subway") | has(tag, "subway", "yes")
    urban = has(tag, "station", "light_rail") | has(tag, "network", "S-tog")
    return F.when(metro, "metro").when(urban, "urban_rail").otherwise("rail")


def stop_rule(tag: Tag) -> Column:
    """The rule by which an object is a bus stop, or NULL."""
    platform = has(tag, "public_transport", "platform") & has(tag, "bus", "yes")
    return F.when(has(tag, "highway", "bus_stop"), "highway=bus_stop").when(platform, "public_transport=platform;bus=yes")


def subtype(tag: Tag, category: Column) -> Column:
    """One exclusive subtype; NULL where no tag qualifies the object for its category."""
    food = F.when(has(tag, "amenity", *FOOD_AMENITIES), tag("amenity"))
    culture = (
        F.when(has(tag, "tourism", *CULTURE_TOURISM), tag("tourism"))
        .when(has(tag, "amenity", *CULTURE_AMENITIES), tag("amenity"))
        .when(has(tag, "historic", *CULTURE_HISTORIC), tag("historic"))
    )
    station = F.when(has(tag, "railway", *STATION_RAILWAY), tag("railway")).otherwise("public_transport_station")
    return F.when(category == "food_social", food).when(category == "cultural_tourist", culture).when(category == "station", station)


def qualifying_tags(tag: Tag, category: Column) -> Column:
    """The tags that qualify an object for its category, as key=value in the order of the rules."""
    of = lambda *rules: F.filter(F.array(*[F.when(has(tag, k, *v), F.concat(F.lit(f"{k}="), tag(k))) for k, v in rules]), lambda x: x.isNotNull())
    food = of(("amenity", FOOD_AMENITIES))
    culture = of(("tourism", CULTURE_TOURISM), ("amenity", CULTURE_AMENITIES), ("historic", CULTURE_HISTORIC))
    station = of(("railway", STATION_RAILWAY), ("public_transport", ("station",)), ("train", ("yes",)), ("subway", ("yes",)), ("station", STATION_MODES))
    return F.when(category == "food_social", food).when(category == "cultural_tourist", culture).when(category == "station", station)
