import pytest
from pyspark.sql import functions as F

from geoskein.functions import tags
from geoskein.operators import relational
from geoskein.sources import sinks


def test_update_from(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7), (None, "d", 8), (2, "e", 9)], "k long, name string, v int")
    new = spark.createDataFrame([(2, 60), (3, None), (None, 80), (None, 81), (9, 90)], "k long, v int")
    got = sorted(map(tuple, relational.update_from(rows, new, ["k"], ["v"]).collect()), key=lambda r: r[1])
    assert got == [(1, "a", 5), (2, "b", 60), (3, "c", None), (None, "d", 8), (2, "e", 60)]
    with pytest.raises(relational.ContractError):
        relational.update_from(rows, new.unionByName(new), ["k"], ["v"])
    assert relational.update_from(rows, new.limit(0), ["k"], ["v"]).count() == 5


def test_exclusive_sums(spark):
    cells = spark.createDataFrame([("x", "p", 1, 2.0), ("x", "q", 1, None), ("y", "p", 1, 4.0), ("y", "p", 2, 8.0)], "g string, a string, b int, v double")
    got = {r.g: (r.cells, r.total, r.p_only) for r in relational.exclusive_sums(cells, ["g"], ["a", "b"], "v", {"p_only": F.col("a") == "p"}, 2).collect()}
    assert got == {"x": (2, 2.0, 2.0), "y": (2, 12.0, 12.0)}
    with pytest.raises(relational.ContractError):
        relational.exclusive_sums(cells, ["g"], ["a"], "v", {})
    with pytest.raises(relational.ContractError):
        relational.exclusive_sums(cells, ["g"], ["a", "b"], "v", {}, 3)


def test_tag_rules(spark):
    cases = [
        ({"railway": "halt", "name": "A"}, True, "rail", "halt", None),
        ({"railway": "halt"}, False, None, None, None),
        ({"railway": "halt", "name": ""}, False, None, None, None),
        ({"public_transport": "station", "train": "yes", "name": "A", "network": "S-tog"}, True, "urban_rail", "public_transport_station", None),
        ({"public_transport": "station", "name": "A"}, False, None, None, None),
        ({"public_transport": "station", "station": "subway", "name": "A", "highway": "bus_stop"}, True, "metro", "public_transport_station", "highway=bus_stop"),
        ({"public_transport": "platform", "bus": "yes"}, False, None, None, "public_transport=platform;bus=yes"),
    ]
    for given, station, mode, kind, rule in cases:
        tag = lambda k: F.lit(given.get(k)).cast("string")  # noqa: B023, E731
        found = tags.is_station(tag)
        row = spark.range(1).select(found, F.when(found, tags.station_mode(tag)), tags.subtype(tag, F.when(found, "station")), tags.stop_rule(tag)).first()
        assert tuple(row) == (station, mode, kind, rule), given


def test_staged_write_keeps_the_former_table(spark, tmp_path):
    path = str(tmp_path / "t")
    checks = {"positive": F.col("v") > 0}
    sinks.staged_write(spark.createDataFrame([(1,)], "v int"), path, checks)
    with pytest.raises(relational.ContractError):
        sinks.staged_write(spark.createDataFrame([(-1,)], "v int"), path, checks)
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]
    sinks.staged_write(spark.createDataFrame([(2,), (3,)], "v int"), path, checks)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    assert not (tmp_path / "t.former").exists()
