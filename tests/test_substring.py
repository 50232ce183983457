"""Substring joins against looking everywhere."""

import random

from claimweave.plans.substring import contains_join


def test_contains_join(spark):
    rnd = random.Random(6)
    word = lambda low, high: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(low, high)))
    texts = [(i, word(0, 30), rnd.randint(0, 1)) for i in range(120)] + [(200, None, 0)]
    needles = [(i, word(0, 6), rnd.randint(0, 1)) for i in range(80)] + [(90, "not in any", 0), (91, None, 1), (92, "abc", 0), (93, "abc", 0)]
    t = spark.createDataFrame(texts, "t int, text string, g int")
    n = spark.createDataFrame(needles, "n int, needle string, g int")
    want = sorted((a[0], b[0]) for a in texts for b in needles if a[1] and b[1] and b[1] in a[1] and a[2] == b[2])
    assert sorted((r.t, r.n) for r in contains_join(t, "text", n, "needle", ["g"]).collect()) == want
    wide = sorted((a[0], b[0]) for a in texts for b in needles if a[1] and b[1] and b[1] in a[1])
    assert sorted((r.t, r.n) for r in contains_join(t, "text", n.drop("g"), "needle").select("t", "n").collect()) == wide
    assert contains_join(t, "text", n.where("n < 0"), "needle", ["g"]).count() == 0


def test_only_grams_of_needles_become_rows(spark):
    """A long text gives as many rows as needles' grams are in it."""
    from pyspark.sql import functions as F
    t = spark.range(1).select(F.repeat(F.lit("0123456789 lorem ipsum "), 2_000).alias("text"))
    n = spark.createDataFrame([("lorem",), ("zzz",)], "needle string")
    joined = contains_join(t, "text", n, "needle")
    assert joined.count() == 1
