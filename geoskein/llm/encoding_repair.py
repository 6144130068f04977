"""Garbled text from a wrong character encoding: find it and restore the original.

Stages, all on distinct values so that a value repeated in a third of all rows costs as much as one:

1. distinct values with a character above ASCII (map-side combined ``groupBy``), cut to the checkpoint folder;
2. a Pandas UDF takes characters back to legacy bytes and runs the UTF-8 automaton over them (``mojibake.py``):
   well-formed spans are decoded whole, layer by layer;
3. confusions of two single-byte encodings leave no well-formed span, text changed to lower case a broken one.  Their
   candidates are decided by the corpus:
   each changed word, in any case, must be at least ``min_ratio`` times as frequent restored as garbled (an equality
   join with the word counts of all values, no collected lexicon).  Where restoring takes signs out of a word,
   repeated rows of the garbled word do not count against it: more rows restored than garbled, and ``min_ratio``
   times the distinct values that hold it garbled, suffice;
4. values that hold U+FFFD lost the bytes: they count as garbled; words are restored where one corpus word that fits
   the pattern is ``min_ratio`` times as frequent as any other.

NULL, empty and pure ASCII values are never garbled.  Ties between candidates go to the more frequent words, then to
the smaller text.  Repeated rows all come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm import mojibake as M
from geoskein.plans.session import cut, ship

NON_ASCII = r"[^\x00-\x7F]"
#: A restored word must be this many times as frequent as the garbled one.
MIN_RATIO = 5

_SCAN = (
    "value string, n long, restored string, encoding string, lost boolean, alien boolean, words array<string>, "
    "candidates array<struct<restored:string,encoding:string,before:array<string>,after:array<string>,odder:array<boolean>>>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for value, n in zip(batch["value"], batch["n"]):
            fixed = M.repair_utf8(value)
            candidates = []
            if fixed is None:
                for text, encoding in [*M.single_byte_candidates(value), *M.lower_cased_candidates(value)]:
                    if changed := M.changed_words(value, text):
                        candidates.append({"restored": text, "encoding": encoding, "before": [a for a, _ in changed], "after": [b for _, b in changed], "odder": [M.strangeness(a) > M.strangeness(b) for a, b in changed]})
            rows.append((value, n, fixed and fixed[0], fixed and fixed[1], M.REPLACEMENT in value, M.mixed_script(value), M.words(value), candidates))
        yield pd.DataFrame(rows, columns=["value", "n", "restored", "encoding", "lost", "alien", "words", "candidates"])


def garbled_values(values: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(value, restored, encoding) of every distinct garbled string in the column ``value`` of ``values``.

    ``restored`` is NULL where the original cannot be recovered; ``encoding`` names the layers, or ``lost``.
    An empty table gives an empty result.
    """
    ship(values.sparkSession)
    distinct = values.where(F.col("value").rlike(NON_ASCII)).groupBy("value").agg(F.count("*").alias("n"))
    # few bytes, much work: spread evenly over the shuffle partitions, which the planner would otherwise merge by bytes
    spread = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = cut(spread.mapInPandas(_scan, _SCAN))
    counts = (
        scanned.where("restored is null")
        .select(F.explode("words").alias("word"), "n")
        .groupBy("word").agg(F.sum("n").alias("word_n"))
        .where(F.col("word").rlike(NON_ASCII))
    )

    folded = (
        scanned.where("restored is null")
        .select("n", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word"))
        .where(F.col("word").rlike(NON_ASCII))
        .groupBy("word").agg(F.sum("n").alias("word_n"), F.count("*").alias("values_n"))
    )

    utf8 = scanned.where("restored is not null").select("value", "restored", "encoding")

    # single-byte confusions: evidence for each changed word
    tried = (
        scanned.where("restored is null and size(candidates) > 0")
        .select("value", "alien", F.posexplode("candidates").alias("c", "cand"))
        .select("value", "alien", "c", "cand.restored", "cand.encoding", F.explode(F.arrays_zip("cand.before", "cand.after", "cand.odder")).alias("w"))
        .select("value", "alien", "c", "restored", "encoding", F.lower("w.before").alias("before"), F.lower("w.after").alias("after"), F.col("w.after").alias("spelled"), "w.odder")
    )
    # one join finds the counts of garbled and of restored words alike
    asked = tried.select(F.explode(F.array("before", "after")).alias("word")).distinct().join(folded, "word")
    # in the case it would have, the restored word must be there too
    spellings = tried.select(F.col("spelled").alias("word")).distinct().join(counts, "word")
    own, known = F.coalesce("before_n", F.lit(0)), F.coalesce("before_values", F.lit(0))
    more_rows = (F.col("after_n") > own) & (F.col("after_n") >= min_ratio * known) & F.col("odder")
    weighed = (
        tried.join(asked.select(F.col("word").alias("before"), F.col("word_n").alias("before_n"), F.col("values_n").alias("before_values")), "before", "left")
        .join(asked.select(F.col("word").alias("after"), F.col("word_n").alias("after_n")), "after", "left")
        .join(spellings.select(F.col("word").alias("spelled"), F.col("word_n").alias("spelled_n")), "spelled", "left")
        .withColumn("good", (F.col("spelled_n").isNotNull() | F.col("encoding").endswith(M.LOWER)) & F.coalesce((F.col("after_n") >= min_ratio * own) | more_rows, F.lit(False)))
        .groupBy("value", "alien", "c", "restored", "encoding")
        .agg(F.min("good").alias("every"), F.max("good").alias("some"), F.min(F.coalesce("spelled_n", F.lit(0))).alias("support"))
        .where("every or (alien and some)")
        .groupBy("value")
        .agg(F.max_by(F.struct("restored", "encoding"), F.struct("every", "support", F.col("restored"))).alias("best"))
        .select("value", "best.restored", "best.encoding")
    )

    # lost bytes: the pattern of a word must lead to one dominant word
    pattern = F.regexp_replace("word", NON_ASCII, M.REPLACEMENT)
    whole = counts.where(~F.col("word").contains(M.REPLACEMENT)).withColumn("pattern", pattern)
    dominant = (
        whole.groupBy("pattern")
        .agg(F.max_by("word", F.struct("word_n", "word")).alias("word"), F.max("word_n").alias("first"), F.sum("word_n").alias("all"))
        .where(F.col("first") >= min_ratio * (F.col("all") - F.col("first")))
        .select("pattern", F.col("word").alias("whole_word"))
    )
    lost = scanned.where("restored is null and lost").select("value", "words").join(weighed, "value", "left_anti")
    mended = (
        lost.select("value", F.posexplode("words").alias("pos", "word"))
        .where(F.col("word").contains(M.REPLACEMENT))
        .join(dominant.withColumnRenamed("pattern", "word"), "word", "left")
        .groupBy("value")
        .agg(
            F.min(F.col("whole_word").isNotNull()).alias("every"),
            F.sort_array(F.collect_list(F.struct("pos", "word", "whole_word"))).alias("pairs"),
        )
    )
    lost = (
        lost.select("value").join(mended, "value", "left")
        .select(
            "value",
            F.when(
                F.col("every"),
                F.aggregate("pairs", F.col("value"), lambda acc, p: F.replace(acc, p["word"], p["whole_word"])),
            ).alias("restored"),
            F.lit("lost").alias("encoding"),
        )
    )
    # letters of two scripts within a word, but no encoding explains them
    alien = (
        scanned.where("restored is null and alien and not lost")
        .select("value", F.lit(None).cast("string").alias("restored"), F.lit("unknown").alias("encoding"))
        .join(weighed, "value", "left_anti")
    )
    return utf8.unionByName(weighed).unionByName(lost).unionByName(alien)


def stack_fields(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, value): one row per record and field, in a single pass over the records."""
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]
    return records.select(F.col(key).alias(key), F.explode(F.array(*pairs)).alias("p")).select(key, "p.field_name", "p.value")


def repair_records(records: DataFrame, key: str, fields: list[str], min_ratio: float = MIN_RATIO) -> DataFrame:
    """(key, field_name, value, restored, encoding) of every garbled field of every record."""
    stacked = stack_fields(records, key, fields).where(F.col("value").rlike(NON_ASCII))
    found = cut(garbled_values(stacked.select("value"), min_ratio))
    return stacked.join(found, "value").select(key, "field_name", "value", "restored", "encoding")
