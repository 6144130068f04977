import csv
import io
import random

from geoskein.sources import csv_records as C

GOOD = "7,2011-04-05,Name,Place,Room,55.1,12.5,$10.00,3,4"
CASES = {
    GOOD: None,
    GOOD.replace("Name", '"The ""Blue"" loft, w/ view\nand sauna"'): None,
    '"7","2011-04-05","Name","Place","Room","55.1","12.5","$1,234.00","3","4"': None,
    GOOD.replace("$10.00", ""): None,
    GOOD.replace("$10.00", '""'): None,
    GOOD.replace("Name", '""""'): None,
    GOOD.replace("Name", '12" screen'): "quoting",
    GOOD.replace("Name", '"open'): "quoting",
    GOOD.replace("Name", '"a"b'): "quoting",
    GOOD.replace("Name", ' "a"'): "quoting",
    GOOD.replace("Name", 'a""b'): "quoting",
    GOOD + '"': "quoting",
    GOOD + ",": "column_count",
    GOOD.replace(",Name", ""): "column_count",
    "": "column_count",
    GOOD.replace(",", ";"): "column_count",
    GOOD.replace("7,", " 7,"): "bad_id",
    GOOD.replace("7,", ","): "bad_id",
    GOOD.replace("7,", "9223372036854775808,"): "bad_id",
    GOOD.replace("7,", "9223372036854775807,"): None,
    GOOD.replace("7,", "٧,"): "bad_id",
    GOOD.replace("7,", '"7\n",'): "bad_id",
    GOOD.replace("$10.00", "10.00"): "bad_price",
    GOOD.replace("$10.00", "$10.0"): "bad_price",
    GOOD.replace("$10.00", '"$12,00"'): "bad_price",
    GOOD.replace("$10.00", " "): "bad_price",
    GOOD.replace("$10.00", '"$10.00\n"'): "bad_price",
    GOOD.replace("Name", "x" * 400_000): None,
    GOOD.replace("Name", '"' + '""' * 200_000 + '"'): None,
}


def test_reasons(spark):
    rows = [(i, raw, "p", i) for i, raw in enumerate(CASES)] + [(1000, None, "p", 0), (0, GOOD, "p", 0)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, price string, parsed long")
    got = {}
    for r in C.classified(df).select("line_id", "reason").collect():
        got.setdefault(r.line_id, []).append(r.reason)
    assert got.pop(1000) == ["quoting"]
    assert got.pop(0) == [None, None]
    assert {k: v[0] for k, v in got.items()} == dict(list(enumerate(CASES.values()))[1:])
    loaded = C.loaded_records(df).where("line_id = 1").first()
    assert loaded.name == 'The "Blue" loft, w/ view\nand sauna' and loaded.price == "$10.00" and loaded.id == 7
    assert C.failed_records(df.limit(0)).count() == 0


def test_round_trip_of_written_records(spark):
    rng = random.Random(6)
    alphabet = ['"', ",", "a", "ø", " ", "\n", ";", "'"]
    want, rows = {}, []
    for i in range(300):
        name = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow([i, "2011-04-05", name, "p", "r", "1", "2", "$1,000", "3", "4"])
        rows.append((i, out.getvalue()))
        want[i] = name or None
    loaded = C.loaded_records(spark.createDataFrame(rows, "line_id long, raw_line string"))
    assert {r.id: r.name or None for r in loaded.collect()} == want
