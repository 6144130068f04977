import gzip
import json

import pytest
from pyspark.sql import functions as F

from geoskein.functions import typed
from geoskein.operators.relational import ContractError
from geoskein.sources import readers, sinks


def test_text_first_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,name,empty\n1,"x, ""y""",\n2,\\N,\n', encoding="utf-8")
    rows = readers.text_csv(spark, str(p), 9).orderBy("_source_row_number").collect()
    assert [(r.id, r.name, r.empty, r._source_file_id, r._source_row_number) for r in rows] == [("1", 'x, "y"', "", 9, 1), ("2", "", "", 9, 2)]
    with gzip.open(tmp_path / "b.csv.gz", "wt", encoding="iso-8859-1") as f:
        f.write("1;æ\n2;ø\n")
    got = readers.text_csv(spark, str(tmp_path / "b.csv.gz"), 1, sep=";", encoding="ISO-8859-1", header=False, numbered=False)
    assert got.columns[:2] == ["field_1", "field_2"] and sorted(r.field_2 for r in got.collect()) == ["æ", "ø"]
    assert readers.text_csv(spark, str(p), 9, columns=["name", "absent"], numbered=False).columns == ["name", "_source_file_id"]


@pytest.mark.parametrize("names", [[], ["a", ""], ["a", "a"], ["x" * 64], ["_source_file_id"], ["a\0"]])
def test_bad_names(names):
    with pytest.raises(readers.SourceError):
        readers.check_names(names)


def test_wrong_width_stops_the_read(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.text_csv(spark, str(p), 1, numbered=False).collect()


def test_statistics_and_matrices(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("﻿OMRÅDE;INDHOLD\n101 København;1,5\n".encode())
    df = readers.statistics_csv(spark, str(p))
    assert df.select(typed.code_prefix(F.col("OMRÅDE")), readers.decimal_comma(F.col("INDHOLD"))).first()[:] == ("101", 1.5)
    wide = spark.createDataFrame([("t", "1", "2")], "period string, field_5 string, field_6 string")
    codes = spark.createDataFrame([("field_5", "01", "Indre"), ("field_6", "02", "Øst")], "field string, code string, label string")
    assert sorted(map(tuple, readers.unpivot_matrix(wide, ["period"], codes).collect())) == [("t", "01", "Indre", "1"), ("t", "02", "Øst", "2")]
    raw = spark.createDataFrame([(bytearray("﻿Ærø".encode()),), (bytearray("Ærø".encode("iso-8859-1")),)], "b binary")
    assert [r[0] for r in raw.select(readers.decoded_text(F.col("b"))).collect()] == ["Ærø", "Ærø"]
    assert spark.range(1).select(readers.tidy_label(F.lit(" a\xa0 b "))).first()[0] == "a b"


def test_geojson_overpass_poly(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"n": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc, indent=1))
    assert sorted((r.properties["n"], len(r.rings), r.rings[0][1].x) for r in readers.geojson_areas(spark, str(p)).collect()) == [("a", 1, 1.0), ("b", 2, 1.0)]
    doc["features"][0]["geometry"]["coordinates"] = [ring[:3]]
    p.write_text(json.dumps(doc))
    with pytest.raises(Exception, match="not a valid polygon"):
        readers.geojson_areas(spark, str(p)).collect()
    lines = tmp_path / "f.jsonl"
    lines.write_text('{"properties":{"osm_id":"5"},"geometry":{"type":"Point","coordinates":[12.5,55.6]}}\n')
    assert readers.geojson_features(spark, str(lines)).first().y == 55.6
    o = tmp_path / "o.json"
    o.write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "nodes": [1, 7]}]}))
    e = readers.overpass_elements(spark, str(o))
    assert sorted((r.osm_type, r.lat, r.lon) for r in e.collect()) == [("node", 1.0, 2.0), ("way", 3.0, 4.0)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (7, 2.0, 4.0)], "node_id long, lon double, lat double")
    assert readers.way_points(e.where("osm_type = 'way'"), nodes).first()[:] == (2, 1.0, 2.0)
    assert readers.poly_ring("x\n1\n 0 0\n 1 0\n 1 1\nEND\nEND\n") == [(0, 0), (1, 0), (1, 1), (0, 0)]
    with pytest.raises(readers.SourceError):
        readers.latest_file(str(tmp_path / "*.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, snapshot_date string")
    p = str(tmp_path / "t")
    sinks.replace_snapshot(df, p)
    sinks.replace_snapshot(spark.createDataFrame([(9, "b")], "k int, snapshot_date string"), p)
    assert sorted((r.k, r.snapshot_date) for r in spark.read.parquet(p).collect()) == [(1, "a"), (9, "b")]
    q = str(tmp_path / "u")
    assert sinks.insert_new(df, q, ["k"]) == 2 and sinks.insert_new(df.union(df), q, ["k"]) == 0
    f = str(tmp_path / "frozen")
    assert sinks.insert_once(df, f) and not sinks.insert_once(df, f)
    with pytest.raises(ContractError):
        sinks.insert_once(df.limit(1), f)
    s = str(tmp_path / "staged")
    with pytest.raises(ContractError):
        sinks.staged_write(df, s, {"k": F.col("k") > 1})
    sinks.staged_write(df, s, {"k": F.col("k") > 0})
    assert spark.read.parquet(s).count() == 2
    assert sinks.write_counted(df, str(tmp_path / "c")) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_counted(df, str(tmp_path / "c"))
    assert sinks.ordered_digest(df, ["k"]) == sinks.ordered_digest(df.orderBy(F.desc("k")), ["k"]) != sinks.ordered_digest(df.limit(1), ["k"])
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.desc("k")))
    sinks.write_single_csv(df, str(tmp_path / "csv"), ["k"])
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1


def test_ledger(spark, tmp_path):
    src = tmp_path / "s.txt"
    src.write_text("x")
    path = str(tmp_path / "ledger.json")
    ledger = sinks.Ledger(path)
    one = ledger.register(str(src))
    assert ledger.register(str(src)) == one == sinks.Ledger(path).register(str(src))
    assert sinks.file_digests(spark, str(src)).first().sha256 == ledger.state["sources"][str(src)]["sha256"]
    with pytest.raises(ContractError):
        ledger.register(str(tmp_path))
    with pytest.raises(ContractError):
        ledger.register(str(src), "0" * 64)
    assert ledger.run(one, "t", {"sep": ","}, lambda: 3) == "success"
    assert sinks.Ledger(path).run(one, "t", {"sep": ","}, lambda: 1 / 0) == "already_imported"
    with pytest.raises(ContractError):
        ledger.run(one, "t", {"sep": ";"}, lambda: 3)
    with pytest.raises(RuntimeError):
        ledger.run(one, "u", {}, lambda: (_ for _ in ()).throw(RuntimeError("password=abc")))
    assert "abc" not in ledger.state["runs"][-1]["error"]
    assert ledger.migrate([("1", "a"), ("2", "b")], lambda t: None) == ["1", "2"] and ledger.migrate([("1", "a")], lambda t: None) == []
    with pytest.raises(ContractError):
        ledger.migrate([("1", "changed")], lambda t: None)
    src.write_text("y")
    with pytest.raises(ContractError):
        ledger.register(str(src))


def test_token_parses(spark):
    df = spark.createDataFrame([("$1,200.00", "1.5 baths", "T"), ("$12,00", "Half-bath", "no"), ("", "", "?"), (None, None, None)], "p string, b string, s string")
    value, where, _ = typed.fallback_number(F.lit(None).cast("string"), F.col("b"))
    out = df.select(typed.currency(F.col("p")).cast("double"), value, where, typed.boolean_token(F.col("s"))).collect()
    assert [tuple(r) for r in out] == [(1200.0, 1.5, "text_number", True), (None, 0.5, "text_half", False), (None, None, "missing", None), (None, None, "missing", None)]
