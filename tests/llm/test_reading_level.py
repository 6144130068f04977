import os
import random

import pytest
from pyspark.sql import functions as F

from geoskein.llm import readability as R
from geoskein.llm.reading_level import reading_levels


def test_syllables():
    en = {"cat": 1, "window": 2, "table": 2, "make": 1, "beautiful": 3, "station": 2, "piano": 3, "walked": 1, "rested": 2, "churches": 2, "tables": 2, "idea": 3}
    assert {w: R.syllables(w, "en") for w in en} == en
    assert R.syllables("køkken", "da") == 2 and R.syllables("schlüssel", "de") == 2


def test_language_by_words_not_by_hint():
    of = lambda text: R.word_counts(text)[1]
    assert R.language(of("the key is by the door"), "da-DK") == "en"
    assert R.language(of("Nøglen er ved døren og den er ny"), None) == "da"
    assert R.language(of("xyz"), "DE") == "de"


def test_language_of_the_whole_text():
    english, danish = "the and of to in " * 400, "nøglen er ved døren og den er ny " * 4000
    assert R.counts(english + danish, None, {})["lang"] == "da"
    assert R.counts(danish + english, None, {})["lang"] == "da"


def test_hyphens():
    def parted(word, lang):
        at = [0, *R.hyphens(word, lang), len(word)]
        return "-".join(word[a:b] for a, b in zip(at, at[1:]))

    assert [parted(w, "en") for w in ("garden", "idea", "strength", "tables", "wanted", "special")] == ["gar-den", "i-de-a", "strength", "ta-bles", "wan-ted", "spe-cial"]
    assert [parted(w, "da") for w in ("køkkenet", "søen", "station")] == ["køk-ke-net", "sø-en", "sta-tion"]
    assert [parted(w, "de") for w in ("straße", "nation", "treppenhaus")] == ["stra-ße", "na-ti-on", "trep-pen-haus"]


def test_clauses_lines_and_markup():
    assert R.clauses("the cat is here and the dog is there. so what? yes!", "en") == 4
    assert R.clauses("- the lift\n- the garden\n", "en") == 2
    assert R.clauses("the door is red; the key is old: the lamp is new", "en") == 3
    assert R.clauses("...", "en") == 1
    assert R.plain("<p>hi</p>\n- one\n12) two") == "\nhi\n\none\ntwo"
    assert R.plain("a < b and c > d") == "a < b and c > d"
    long_tag = "<a title='" + "x" * 500 + "'>word</a>"
    assert R.word_counts(long_tag)[1] == {"word": 1}


def test_remembering_is_bounded():
    known = R._Remembering(len)
    for i in range(R.REMEMBERED + 5):
        assert known[str(i)] == len(str(i))
    assert len(known) <= R.REMEMBERED


def test_formulas_on_hand_counts():
    c = {"sentences": 4, "words": 60, "letters": 300, "syllables": 90, "polysyllables": 12, "long_words": 15, "hard_share": 0.1}
    got = {n: round(f(c), 3) for n, f in {**R.CLASSIC, **R.WITH_LIST}.items()}
    assert got["flesch_kincaid"] == round(0.39 * 15 + 11.8 * 1.5 - 15.59, 3)
    assert got["reading_ease"] == round(-(206.835 - 15.225 - 126.9), 3)
    assert got["gunning_fog"] == 14.0 and got["lix"] == 40.0
    assert got["dale_chall"] == round(1.579 + 0.744 + 3.6365, 3)
    assert len(R.CLASSIC) == 7 and len(R.WITH_LIST) == 7


def test_boundaries_part_the_levels():
    values = [1.0, 1.2, 2.0, 2.2, 3.0, 3.3, 4.0, 4.4, 5.0, 5.5]
    levels = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    b = R.boundaries(values, levels)
    assert [round(R.level(v, b)) for v in values] == levels
    assert R.boundaries([1.0, 1.0], [2, 2]) == sorted(R.boundaries([1.0, 1.0], [2, 2]))


EASY = "the cat is by the door we like the soft bed you can play in the park".split()
HARD = "notwithstanding endogeneity delineates jurisdiction pursuant amortisation heterogeneity supersedes subsidiarity".split()


def _text(rng, hard):
    words = HARD if hard else EASY
    return ". ".join(" ".join(rng.choice(words) for _ in range(18 if hard else 6)) for _ in range(6)) + "."


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, _text(rng, i % 2), "en") for i in range(240)]
    labels = [(i, 1, 5 if i % 2 else 1) for i in range(120)] + [(3, 2, 4), (None, 1, 2), (5, 1, None)]
    odd = [(500, None, "en"), (501, "  ", None), (502, "123 456 !!", "en"), (503, _text(rng, True) * 200, None), (None, "the cat", "en")]
    docs = spark.createDataFrame([(*r, "c") for r in rows + odd], "doc_id long, text string, lang string, level string")
    marks = spark.createDataFrame(labels, "doc_id long, annotator_id int, reading_level int")
    got = {r.doc_id: r.level for r in reading_levels(docs, marks).collect()}
    assert not {500, 501, 502, None} & set(got) and got[503] >= 3.5
    held_out = [(got[i] >= 3.5) == bool(i % 2) for i in range(120, 240)]
    assert sum(held_out) / len(held_out) >= 0.95
    assert reading_levels(docs, marks.limit(0)).count() == 0 and reading_levels(docs.limit(0), marks).count() == 0


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels_of_the_tables(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "reading_labels"))
    docs = docs.join(marks.select("doc_id").distinct(), "doc_id", "left_semi")
    truth = {r.doc_id: r.level for r in marks.groupBy("doc_id").agg(F.avg("reading_level").alias("level")).collect()}
    figures = {}
    for name, formulas in (("list", R.WITH_LIST), ("classic", R.CLASSIC)):
        levels = {r.doc_id: r.level for r in reading_levels(docs, marks.where("doc_id % 2 = 0"), formulas).where("doc_id % 2 = 1").collect()}
        found, true = {i for i, lv in levels.items() if lv >= 3.5}, {i for i in levels if truth[i] >= 3.5}
        figures[name] = (len(found & true) / len(found), len(found & true) / len(true))
    print(figures)
    assert min(figures["list"]) >= 0.93
    assert figures["classic"][0] >= 0.85 and figures["classic"][1] >= 0.6
