"""Sources mixed to target weights: complete epochs, then a weighted sample by exponential keys up to the token budget.

The total is the largest for which every source that has documents reaches its share without more than its repeats
(or ``total_tokens`` where given).  A source's budget is met by whole passes over its documents and by one partial
pass: Efraimidis-Spirakis keys -ln(u) / weight, u from a hash of the id, are followed upwards while the running sum
of tokens stays within the budget.  The document that would exceed it is passed over, and the keys after it are
followed with what is left for documents that still fit, until the rest is below ``TOLERANCE`` of the budget or no
document fits.

Scale: no source is sorted.  Keys fall into ``BINS`` bins per source, one small aggregate gives the running sum at
every bin, and the bin in which the budget ends is cut into finer bins while it holds more than ``ROWS_IN_BIN`` rows,
however the weights are spread.  What a pass leaves behind is one interval of keys per source, so that the uses of
a document are an expression on its own row.

Defined results: texts of no tokens and sources without a target are used 0 times; targets without documents are
reported with 0 tokens, the other shares are scaled to 1; ties of keys go by id; of an id that comes again the
smallest (source, tokens, weight) counts, rows without an id do not; weights that are NULL, NaN or below 1e-6 count
as 1e-6; a source's last target row in the order of its columns counts; empty tables give no uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoskein.plans.session import cut

BINS = 4096
ROWS_IN_BIN = 200_000
#: The part of a source's budget that may be left over while documents still fit.
TOLERANCE = 0.001
SEED = 20110404


def quality_weight(text: Column) -> Column:
    """Weight of a text between 0.05 and 1: its share of letters, squared, by the share of its words that differ, by its sentence marks.

    The share of different words is taken with the square root of their number, as long texts repeat words anyhow.
    """
    text = F.coalesce(text, F.lit(""))
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]|  +", ""))
    letters = F.when(F.length(text) > 0, kept / F.length(text)).otherwise(0.0)
    words = F.split(F.lower(text), r"\s+")
    different = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / (F.lit(4.0) * F.sqrt(F.size(words))))
    short = F.least(F.lit(1.0), F.size(words) / F.lit(16.0))
    ended = F.when(F.rtrim(text).rlike(r"[.!?…][\"”’)\]]*$"), 1.0).otherwise(0.7)
    return F.greatest(F.lit(0.05), letters * letters * F.greatest(different, F.lit(0.25)) * F.greatest(short, F.lit(0.25)) * ended)


def exponential_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(u) / weight


def plan(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of either table: its share, budget, whole epochs and the tokens of the partial pass."""
    targets = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    have = documents.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    joined = targets.join(have, "source", "full").withColumn("available", F.coalesce("available", F.lit(0)))
    joined = joined.withColumn("usable", (F.col("available") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0))
    joined = cut(joined)
    scale = joined.where("usable").agg(F.sum("target_share").alias("s")).first()["s"]
    joined = joined.withColumn("share", F.when(F.col("usable"), F.col("target_share") / (scale or 1.0)).otherwise(0.0))
    if total_tokens is None:
        total_tokens = joined.where("usable").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("share")).alias("t")).first()["t"] or 0
    budget = joined.withColumn("budget", F.floor(F.col("share") * float(total_tokens)).cast("long"))
    epochs = F.when(F.col("usable"), F.least(F.col("max_repeats").cast("long"), F.floor(F.col("budget") / F.col("available")))).otherwise(0)
    out = budget.withColumn("epochs", epochs.cast("long"))
    rest = F.when(F.col("usable") & (F.col("epochs") < F.col("max_repeats")), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0)
    return out.withColumn("rest", rest.cast("long"))


def _passed(documents: DataFrame, open_: DataFrame) -> DataFrame:
    """One pass: for each row (source, gap, after_key, after_id) of ``open_`` the interval of keys taken.

    Gives (source, gap, after_key, after_id, stop_key, stop_id, taken): documents of at most ``gap`` tokens after
    (after_key, after_id) and before (stop_key, stop_id) are taken; the stop is NULL where all of them fit.
    """
    heads = ["source", "gap", "after_key", "after_id"]
    fits = (
        documents.where("tokens > 0").join(open_, "source")
        .where("tokens <= gap and (key > after_key or (key = after_key and doc_id > after_id))")
        .select(*heads, "doc_id", "tokens", "key", F.log("key").alias("at"))
    )
    # the range of keys in which the budget ends, narrowed bin by bin
    ranges = cut(fits.groupBy(*heads).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows"), F.sum("tokens").alias("all")).withColumn("start", F.lit(0).cast("long")))
    whole = ranges.where("all <= gap").select(*heads, F.lit(None).cast("double").alias("stop_key"), F.lit(None).cast("long").alias("stop_id"), F.col("all").alias("taken"))
    ranges = ranges.where("all > gap").select(*heads, "low", "high", "rows", "start")
    while (ranges.where("high > low").agg(F.max("rows").alias("m")).first()["m"] or 0) > ROWS_IN_BIN:
        width = (F.col("high") - F.col("low")) / BINS
        inside = fits.join(F.broadcast(ranges), heads).where("at between low and high")  # a row per source
        bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(BINS - 1), F.floor((F.col("at") - F.col("low")) / width))).otherwise(0)
        binned = inside.withColumn("bin", bin_).groupBy(*heads, "start", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"))
        upto = F.col("start") + F.sum("t").over(Window.partitionBy(*heads).orderBy("bin"))  # at most BINS rows per source
        binned = binned.withColumn("upto", upto).where("upto > gap")
        first = binned.groupBy(*heads).agg(F.min_by(F.struct("low", "high", "rows", (F.col("upto") - F.col("t")).alias("start")), "bin").alias("b"))
        narrowed = cut(first.select(*heads, "b.*"))
        if narrowed.join(ranges.select(*heads, F.col("rows").alias("was")), heads).where("rows < was").isEmpty():
            break  # equal keys cannot be parted further
        ranges = narrowed
    last = fits.join(F.broadcast(ranges), heads).where("at between low and high")
    run = F.col("start") + F.sum("tokens").over(Window.partitionBy(*heads).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = last.withColumn("run", run).where("run > gap").groupBy(*heads).agg(F.min(F.struct("key", "doc_id", (F.col("run") - F.col("tokens")).alias("taken"))).alias("s"))
    return whole.unionByName(over.select(*heads, F.col("s.key").alias("stop_key"), F.col("s.doc_id").alias("stop_id"), "s.taken"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``documents`` (doc_id, source, tokens, weight) -> uses (doc_id, source, tokens, uses) and the plan per source."""
    weight = F.greatest(F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(1e-6)), F.lit(1e-6)), F.lit(1e-6))
    given = documents.where("doc_id is not null").select("doc_id", F.struct("source", F.col("tokens").cast("long").alias("tokens"), weight.alias("weight")).alias("d"))
    single = given.groupBy("doc_id").agg(F.min("d").alias("d")).select("doc_id", "d.*")
    single = cut(single.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"), seed)).drop("weight"))
    planned = cut(plan(single, targets, total_tokens))
    rests = planned.where("rest > 0").select("source", F.col("rest").alias("gap"), F.lit(-1.0).alias("after_key"), F.lit(0).cast("long").alias("after_id"))
    least = planned.select("source", (F.col("budget") * TOLERANCE).alias("least"))
    open_, steps = cut(rests), []
    while not open_.isEmpty():
        step = cut(_passed(single, open_))
        steps.append(step)
        following = step.where("stop_key is not null").join(least, "source").where("gap - taken > least")
        open_ = cut(following.select("source", (F.col("gap") - F.col("taken")).alias("gap"), F.col("stop_key").alias("after_key"), F.col("stop_id").alias("after_id")))
    chosen = planned.select("source", "epochs")
    if steps:
        every = steps[0]
        for step in steps[1:]:
            every = every.unionByName(step)
        intervals = every.groupBy("source").agg(F.collect_list(F.struct("gap", "after_key", "after_id", "stop_key", "stop_id")).alias("intervals"))
        chosen = chosen.join(intervals, "source", "left")
    else:
        chosen = chosen.withColumn("intervals", F.expr("cast(null as array<struct<gap:bigint,after_key:double,after_id:bigint,stop_key:double,stop_id:bigint>>)"))
    once = F.expr(
        """exists(intervals, i -> tokens <= i.gap and (key > i.after_key or (key = i.after_key and doc_id > i.after_id))
                             and (i.stop_key is null or key < i.stop_key or (key = i.stop_key and doc_id < i.stop_id)))"""
    )
    uses = F.when(F.col("tokens") > 0, F.coalesce("epochs", F.lit(0)) + F.coalesce(once.cast("int"), F.lit(0))).otherwise(0)
    return single.join(chosen, "source", "left").select("doc_id", "source", "tokens", uses.cast("long").alias("uses")), planned


def reached_shares(uses: DataFrame, planned: DataFrame) -> DataFrame:
    """What each source contributes against its target."""
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    joined = planned.join(got, planned["source"].eqNullSafe(got["source"]), "left").drop(got["source"])
    total = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # one row per source
    return joined.select(
        "source", "target_share", "share", "max_repeats", "available", "budget", "epochs",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.when(total > 0, F.coalesce("mixed_tokens", F.lit(0)) / total).otherwise(0.0).alias("actual_share"),
    )
