"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut per source.

Every document gets a random key (a hash of a seed, its id and its text). Per source, the documents
are range-sorted by that key; sums per range, then prefix sums over the ranges, then prefix sums inside
the one range that holds the cut give the place where the source's budget ends. What is known of a
source (its whole passes and its cut) is one small row, joined back to the documents: texts are never
shuffled and a source of any size spreads over many ranges.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order; rows that tie in random order (same id and text) share what is left at the cut evenly, rounded
down; an empty table gives an empty table. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.llm.common import RUN, WORD, before_run, kept, ordered_runs, small, text_of

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Sources' rows are broadcast up to this number of sources, shuffled beyond.
SMALL_SOURCES = 100_000


def size_column(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_column(seed: str = SEED, id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of an md5, so that any SQL engine can repeat the order."""
    whole = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Shares of the total by weight, capped at ``epochs`` times a source's size; the excess goes to the others by
    weight. Sources sorted by cap per weight are capped in that order, so the level at which the rest stands
    follows from prefix sums over the sources.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(epochs))
    by = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    upto = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*by).rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    level = ranked.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("capped"), F.sum("w").over(onward).alias("open_w"))
    left = (F.col("total") - F.col("capped")).cast("double")
    free = level.select("*", (left * F.col("w") / F.col("open_w") <= F.col("cap")).alias("free"))
    # the first free source in this order sets the level for itself and all after it
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("capped"), F.col("open_w")))).over(everything)
    free = free.select("*", first.alias("first"))
    even = (F.col("total") - F.col("first.capped")).cast("double") * F.col("w") / F.col("first.open_w")
    return free.select("source", "source_size", F.least(even, F.col("cap").cast("double")).alias("target"))


def cuts(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, target, passes, cut_key, cut_words`` from ``source, key, size``.

    A document is taken whole ``passes`` times, once more if its key is below ``cut_key``; at ``cut_key`` it takes
    ``cut_words`` more.
    """
    runs = ordered_runs(keyed.select("source", "key", "size").where("size > 0"), ["source", "key"])
    ranges = kept(before_run(runs, ["source"], {"words": F.sum("size")}))
    goal = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    goal = kept(goal.withColumn("passes", passes).withColumn("rest", words - F.col("passes") * F.col("source_size")))
    source = F.col("r.source").eqNullSafe(F.col("g.source"))
    at = ranges.alias("r").join(small(goal, SMALL_SOURCES).alias("g"), source & (F.col("words_before") < F.col("rest")) & (F.col("rest") <= F.col("words_before") + F.col("words")))
    at = at.select(F.col("r.source").alias("at_source"), F.col(RUN).alias("at_run"), "words_before", "rest")
    inside = runs.join(small(at, SMALL_SOURCES), F.col("source").eqNullSafe(F.col("at_source")) & (F.col(RUN) == F.col("at_run")))
    same_key = inside.groupBy("source", "key", "words_before", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sofar = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = same_key.withColumn("before", F.col("words_before") + sofar).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
    cut = reached.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("long").alias("cut_words"))
    out = goal.join(small(cut, SMALL_SOURCES), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return kept(out.select("source", "source_size", "target", "passes", "cut_key", "cut_words"))


def with_cuts(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """``keyed`` (with ``source, key, size``) plus ``source_size, target, passes, extra``: whole passes and words of the cut pass."""
    p = small(plan.withColumnRenamed("source", "__source"), SMALL_SOURCES)
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0))
    joined = keyed.join(p, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("extra", extra.cast("long")).drop("__source", "cut_key", "cut_words")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: the words the mixture takes of it, repeats counted."""
    keyed = kept(docs.select("doc_id", "source", size_column().alias("size"), key_column(seed).alias("key")))
    rows = with_cuts(keyed, cuts(keyed, weights, epochs))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mixture with the columns of ``docs``: each as often as it is taken.

    A document cut by the budget stays whole; one of which nothing is taken goes.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "source", size_column().alias("size"), key_column(seed).alias("key"))
    plan = cuts(kept(packed.select("source", "size", "key")), weights, epochs)
    times = (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    rows = with_cuts(packed, plan).where("size > 0").withColumn("__times", times).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n")).select("__row.*")
