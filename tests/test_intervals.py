"""Windows and dates met through blocks of days against comparing all pairs, and a key too large for that."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from claimweave.operators import reads as R

DAY = dt.date(1999, 12, 20)


def window(rnd):
    a = None if rnd.random() < 0.15 else DAY + dt.timedelta(days=rnd.randint(0, 90))
    b = None if rnd.random() < 0.15 else (a or DAY) + dt.timedelta(days=rnd.choice([0, 1, 7, 8, 9, 63, 64, 65, 400, -3]))
    return a, b


def overlap(a, b, c, d):
    return (a is None or d is None or a <= d) and (c is None or b is None or c <= b)


def test_pairs_and_best_versions(spark, monkeypatch):
    rnd = random.Random(3)
    versions = [(rnd.choice("kkkl"), i, rnd.choice("ab"), *window(rnd), rnd.randint(0, 5), rnd.choice(["active", "superseded", "retracted"]), i) for i in range(90)]
    claims = [(rnd.choice("klm"), i, rnd.choice("ab"), *window(rnd)) for i in range(60)]
    dates = [(k, d) for k in "klm" for d in [None, dt.date(1, 1, 1), dt.date(9999, 12, 31), *(DAY + dt.timedelta(days=rnd.randint(-5, 120)) for _ in range(20))]]
    v = spark.createDataFrame(versions, "claim_key string, version_id long, normalized_object string, valid_from date, valid_to date, score_units long, status string, source_id long").withColumn(
        "object_value", F.col("normalized_object"))
    c = spark.createDataFrame(claims, "claim_key string, n long, normalized_object string, valid_from date, valid_to date")
    asked = spark.createDataFrame(dates, "claim_key string, as_of date")
    want_pairs = sorted((x[1], y[1], x[2] == y[2]) for x in claims for y in versions if x[0] == y[0] and overlap(y[3], y[4], x[3], x[4]))
    want_best = {}
    for k, d in dates:
        held = [((y[3] is not None, y[3] or DAY), y[5], y[1]) for y in versions if y[0] == k and y[6] != "retracted" and overlap(y[3], y[4], d, d)]
        if held:
            want_best[(k, d)] = max(held)[2]
    for many in (10_000, 30, 0):
        monkeypatch.setattr(R, "MANY_WINDOWS", many)
        assert sorted((r.n, r.version_id, r.same_object) for r in R.overlap_pairs(c, v).collect()) == want_pairs
        assert {(r.claim_key, r.as_of): r.version_id for r in R.truth_as_of(v, asked).collect()} == want_best


def test_one_key_with_many_versions_and_dates(spark):
    """10^5 windows of a day and 10^5 dates of one key; their product would be 10^10 pairs."""
    n = 100_000
    day = lambda i: F.date_from_unix_date((i * 20).cast("int"))
    v = spark.range(n).select(F.lit("k").alias("claim_key"), F.col("id").alias("version_id"), F.lit("a").alias("normalized_object"), F.lit("a").alias("object_value"), day(F.col("id")).alias("valid_from"),
                              F.date_add(day(F.col("id")), 3).alias("valid_to"), F.lit(1).cast("long").alias("score_units"), F.lit("active").alias("status"), F.col("id").alias("source_id"))
    start = time.time()
    asked = v.select("claim_key", F.date_add("valid_from", 2).alias("as_of"))
    assert R.truth_as_of(v, asked).where("as_of = date_add(date_from_unix_date(cast(version_id * 20 AS INT)), 2)").count() == n
    claims = v.select("claim_key", F.date_add("valid_from", 3).alias("valid_from"), F.date_add("valid_from", 19).alias("valid_to"), "normalized_object")
    assert R.overlap_pairs(claims, v).count() == n
    assert time.time() - start < 120
