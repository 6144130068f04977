"""Reading level of each document: published readability formulas, calibrated on labelled examples, combined by their median.

Sentences, syllables (hyphenation rules) and words are counted over the whole text (``readability.py``).  Two sets of
formulas are offered: ``CLASSIC`` knows sentence length, syllables and letters only; ``WITH_LIST`` adds the formulas
that also count words outside a list of easy words (Dale-Chall and its kin), the list being graded by the levels of
the labelled texts its words occur in.  The list and the boundaries between levels are fitted on a bounded sample of
the labelled documents (``SAMPLE``), every word of it taken; scoring covers every document.

NULL, blank and wordless texts and rows without an id have no level and no row.  Copies get equal levels.  Without labels there is no level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm import readability as R
from geoskein.plans.session import cut, ship

#: Most labelled documents the fit uses, those with the smallest hash of the id.
SAMPLE = 20_000
#: Fewest labelled documents of a language for boundaries of its own.
OWN_LANGUAGE = 40

Formulas = dict[str, Callable[[dict], float]]


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, levels = [], []
        for text, lv in zip(batch["text"], batch["level"]):
            own = R.word_counts(text)[1]
            words += own
            levels += [lv] * len(own)
        yield pd.DataFrame({"word": words, "level": levels})


def _fitting(graded, formulas: Formulas):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = graded.value
        for batch in batches:
            rows = []
            for lv, text, hint in zip(batch["level"], batch["text"], batch["lang"]):
                if (c := R.counts(text, hint, known)) is not None:
                    rows.append([c["lang"], lv, *[float(f(c)) for f in formulas.values()]])
            yield pd.DataFrame(rows, columns=["lang", "level", *formulas])

    return run


def _levelling(graded, formulas: Formulas, bounds: dict[str, dict[str, list[float]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = graded.value
        for batch in batches:
            rows = []
            for doc_id, text, hint in zip(batch["doc_id"], batch["text"], batch["lang"]):
                if (c := R.counts(text, hint, known)) is not None:
                    own = bounds.get(c["lang"], bounds[""])
                    rows.append([doc_id, c["lang"], median(R.level(float(f(c)), own[name]) for name, f in formulas.items())])
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "level"])

    return run


def readable(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "lang").where("doc_id is not null").where(F.col("text").rlike(r"[^\s\p{Z}]"))


def reading_levels(documents: DataFrame, labels: DataFrame, formulas: Formulas | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, level): ``level`` runs from 1 to 5, ``lang`` is the language found in the text."""
    spark = documents.sparkSession
    ship(spark)
    formulas = R.WITH_LIST if formulas is None else formulas
    texts = readable(documents)
    nothing = texts.select("doc_id", "lang", F.lit(0.0).alias("level")).limit(0)
    voted = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    examples = cut(texts.join(F.broadcast(voted), "doc_id"))  # at most ``sample`` ids and levels
    if examples.isEmpty():
        return nothing
    # the words of at most ``sample`` texts; a word of a single text says little of its own
    listed = (
        examples.select("text", "level").mapInPandas(_word_rows, "word string, level double")
        .groupBy("word").agg(F.avg("level").alias("grade"), F.count("*").alias("n")).where("n >= 2")
    )
    graded = spark.sparkContext.broadcast({r.word: r.grade for r in listed.select("word", "grade").toLocalIterator()})
    scored = ", ".join(f"{name} double" for name in formulas)
    fit = examples.mapInPandas(_fitting(graded, formulas), f"lang string, level double, {scored}").toPandas()
    if fit.empty:
        return nothing
    bounds: dict[str, dict[str, list[float]]] = {}
    for lang, rows in [("", fit), *fit.groupby("lang")]:
        if not lang or (len(rows) >= OWN_LANGUAGE and (rows["level"] >= 3.5).sum() >= 5):
            bounds[lang] = {name: R.boundaries(rows[name].tolist(), rows["level"].tolist()) for name in formulas}
    return texts.mapInPandas(_levelling(graded, formulas, bounds), "doc_id long, lang string, level double")
