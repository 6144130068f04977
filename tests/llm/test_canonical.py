import random
from collections import Counter

import pytest

from geoskein.llm import canonical as C

ENTRIES = [(1, "f", "Indre Havn"), (2, "f", "Måløvang"), (3, "f", "Valdby"), (4, "g", "Entire home"), (5, "g", "Entire place"), (6, "g", "Private room in condo"), (7, "g", "Tiny house"), (8, "g", "Entire loft")]


def _entries(spark):
    return spark.createDataFrame(ENTRIES, "canonical_id long, field_name string, canonical_value string")


def _mapped(spark, rows, entries=None):
    values = spark.createDataFrame([(f, v, v, 0) for f, v in rows], "field_name string, value string, text string, extra int")
    out = C.map_to_entries(values, _entries(spark) if entries is None else entries)
    return {(r.field_name, r.value): r.canonical_id for r in out.collect()}


def test_typed_values(spark):
    rows = {
        ("f", "near INDRE havn, Kbh"): 1, ("f", "Havn Indre"): 1, ("f", "IndreHavn"): 1, ("f", "Maaloevang"): 2, ("f", "Malvang"): 2, ("f", "Vadlby ★"): 3, ("f", "Kreuzfeld"): 0,
        ("f", "???"): 0, ("f", "Entire home"): 0, ("g", "Whole home"): 4, ("g", "Whole place"): 5, ("g", "Whole loft"): 8, ("g", "room in condo (private)"): 6, ("g", "our entrie place 65 m2"): 5, ("g", "Igloo"): 0, ("g", "Treehouse"): 0, ("g", "Wohle home"): 4,
        ("f", "word " * 3000 + "Valdby"): 3,
    }
    assert _mapped(spark, list(rows)) == rows


def test_readings_in_sql_equal_the_codecs(spark):
    rows = []
    for text in ("Måløvang", "Østerlund Æblehaven", "naïve ★ 東京", "plain"):
        for decoder in C.DECODERS:
            shown = text
            for _ in range(2):
                try:
                    shown = "".join(bytes([b]).decode(decoder) if b >= 0x80 and bytes([b]).decode(decoder, "ignore") else chr(b) for b in shown.encode("utf-8"))
                except UnicodeDecodeError:
                    break
                rows.append((text, shown))
    values = spark.createDataFrame([("f", v, v) for v in {s for _, s in rows}] + [("f", "Åø ok", "Åø ok"), ("f", "x\u20ac\u0100", "x\u20ac\u0100")], "field_name string, value string, text string")
    got = {}
    for r in C.readings(values).collect():
        got.setdefault(r.value, set()).add(r.reading)
    assert all(text in got[shown] for text, shown in rows)
    assert got["Åø ok"] == {"Åø ok"} and got["x\u20ac\u0100"] == {"x\u20ac\u0100"}


def test_replacements_need_evidence(spark):
    entries = spark.createDataFrame([(1, "g", "Entire home"), (2, "g", "Entire place"), (3, "g", "Entire loft"), (4, "g", "Private apartment"), (5, "g", "Private room")], "canonical_id long, field_name string, canonical_value string")
    seen = ["whole home", "whole place", "whole loft", "my home", "my place", "private apt", "st place", "private whole", "entire place", "cosy room", "private rm"]
    texts = spark.createDataFrame([("g", t) for t in seen], "field_name string, reading string")
    assert {(r.word, r.stands_for) for r in C.replacements(texts, entries).collect()} == {("whole", "entire"), ("apt", "apartment"), ("rm", "room")}
    assert C.replacements(texts.limit(0), entries).count() == C.replacements(texts, entries.limit(0)).count() == 0


def test_empty_tables(spark):
    assert _mapped(spark, [("f", "Valdby")], _entries(spark).limit(0)) == {("f", "Valdby"): 0}
    assert _mapped(spark, []) == {}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _apart(a, b):
    x, y = Counter(a), Counter(b)
    return max(sum((x - y).values()), sum((y - x).values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_pigeonhole_loses_no_pair(spark, seed):
    """Against brute force over all pairs of single words that folding leaves alone."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("bcx") for _ in range(rng.randint(3, 14))) for _ in range(60)})
    entries = [(i + 1, "f", w) for i, w in enumerate(words[:15])]
    typed = words[15:] + [w[:2] + "k" + w[3:] for w in words[:15]]
    k = lambda n: min(next(e for most, e in C.EDITS if n <= most), n - 1)
    want = {}
    for t in set(typed):
        near = [(d, -len(w), i) for i, _, w in entries if (d := _levenshtein(t, w)) <= k(len(w)) and (d < 3 or len(w) > C.SHORT or _apart(t, w) <= C.SHORT_LETTERS)]
        want["f", t] = min(near)[2] if near else 0
    got = _mapped(spark, [("f", t) for t in set(typed)], spark.createDataFrame(entries, "canonical_id long, field_name string, canonical_value string"))
    assert got == want
