"""Substring joins without comparing every pair.

A text can contain a needle only if it has all of the needle's grams (runs of three characters). Needles are cut into theirs, and of
a text only the grams that some needle has become postings. Each needle is then looked up under the one of its grams that
the fewest texts have, and the few candidates are verified. Exact, whatever the grams' selectivity; needles
shorter than a gram are one gram themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.plans.session import materialise, sized_broadcast

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows where ``text`` contains ``needle`` (both non-empty strings), optionally equal on ``on``."""
    on = on or []
    needles = needles.where(F.length(needle) > 0)
    spelled = needles.select(F.col(needle).alias("__needle")).distinct()
    own = F.when(F.length("__needle") < GRAM, F.array("__needle")).otherwise(grams(F.col("__needle"), GRAM))
    cut = materialise(spelled.select("__needle", F.explode(own).alias("__gram")), "needle-grams")
    wanted = sized_broadcast(cut.select("__gram").distinct())
    sizes = [r[0] for r in cut.select(F.length("__gram")).distinct().collect()]  # 1, 2 or GRAM
    every = F.concat(*[grams(F.col(text), s) for s in sizes]) if sizes else grams(F.col(text), GRAM)
    postings = materialise(texts.withColumn("__gram", F.explode(every)).join(wanted, "__gram", "left_semi"), "postings")
    frequency = postings.groupBy("__gram").agg(F.count("*").alias("__df"))
    rarest = cut.join(frequency, "__gram").groupBy("__needle").agg(F.min(F.struct("__df", "__gram")).alias("r"), F.count("*").alias("here"))
    # a needle with a gram that no text has is in none
    complete = cut.groupBy("__needle").agg(F.count("*").alias("all")).join(rarest, "__needle").where(F.col("here") == F.col("all"))
    anchored = needles.join(complete.select("__needle", F.col("r.__gram").alias("__gram")), F.col(needle) == F.col("__needle")).drop("__needle")
    return postings.join(anchored, ["__gram", *on]).where(F.contains(F.col(text), F.col(needle))).drop("__gram")
