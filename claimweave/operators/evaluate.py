"""Scoring of answers and aggregation of evaluation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.sources.corpus import QUESTION_TYPES


def truth_match(q: DataFrame | None = None) -> Column:
    """Object equal ignoring case (both absent counts), and the forbidden value neither answered nor mentioned."""
    same = F.when(F.col("expected_object_value").isNull(), F.col("object_value").isNull()).otherwise(
        F.lower(F.coalesce("object_value", F.lit(""))) == F.lower("expected_object_value"))
    said = F.lower(F.concat_ws(" ", F.coalesce("object_value", F.lit("")), F.coalesce("answer_text", F.lit(""))))
    forbidden = F.lower(F.coalesce("forbidden_object_value", F.lit("")))
    return same & ((forbidden == "") | ~F.contains(said, forbidden))


def _lowered(values: str) -> Column:
    return F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), F.lower)


def score_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """0/1 score per answered question by its metric, with expected and observed text."""
    x = questions.join(answers, "question_id")
    metric, match = F.col("metric"), truth_match()
    no = F.lit(False)
    history = F.when(F.col("as_of").isNotNull(), match).otherwise(_lowered("historical_objects") == _lowered("expected_historical_objects"))
    support = match & (F.array_sort(F.array_distinct(_lowered("support_source_refs"))) == F.array_sort(F.array_distinct(_lowered("expected_support_source_refs"))))
    open_expected = F.coalesce("expected_unresolved_conflict", no)
    ok = (
        F.when(metric.isin("current_truth_accuracy", "rollback_recovery_rate", "branch_isolation_score"), match)
        .when(metric == "historical_truth_accuracy", history)
        .when(metric == "provenance_accuracy", F.col("source_ref").eqNullSafe(F.col("expected_source_ref")))
        .when(metric == "merge_conflict_resolution_score", F.when(open_expected, F.col("unresolved_conflict")).otherwise(match & F.col("conflict_resolved")))
        .when(metric == "low_trust_warning_rate", F.col("had_low_trust_warning") == F.coalesce("expected_low_trust_warning", no))
        .when(metric == "support_set_accuracy", support))
    has_history = (metric == "historical_truth_accuracy") & (F.size(_lowered("expected_historical_objects")) > 0)
    is_open = (metric == "merge_conflict_resolution_score") & open_expected
    expected = (
        F.when(has_history, F.array_join("expected_historical_objects", " -> ")).when(metric == "provenance_accuracy", F.col("expected_source_ref"))
        .when(metric == "support_set_accuracy", F.array_join(F.array_sort("expected_support_source_refs"), ", "))
        .when(is_open, "unresolved_conflict").otherwise(F.coalesce("expected_object_value", "expected_source_ref")))
    observed = (
        F.when(has_history, F.array_join("historical_objects", " -> ")).when(metric == "provenance_accuracy", F.col("source_ref"))
        .when(metric == "support_set_accuracy", F.array_join(F.array_sort("support_source_refs"), ", "))
        .when(is_open, F.when(F.col("unresolved_conflict"), "unresolved_conflict").otherwise(F.col("object_value")))
        .otherwise(F.coalesce("object_value", "source_ref")))
    return x.select("system_name", "question_id", "metric", ok.cast("double").alias("score"), expected.alias("expected"), observed.alias("observed"))


def history_matches(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Ordered-history comparison on rows (question_id, position, object_value): equal length and equal at every position."""
    e = expected.select("question_id", "position", F.lower("object_value").alias("e"))
    o = observed.select("question_id", "position", F.lower("object_value").alias("o"))
    x = e.join(o, ["question_id", "position"], "full")
    return x.groupBy("question_id").agg(F.bool_and(F.col("e").eqNullSafe(F.col("o"))).alias("matches"))


def metric_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("system_name", "metric").agg(F.avg("score").alias("score"), F.count("*").cast("double").alias("n"))


def eval_summary(records: DataFrame, logs: DataFrame) -> DataFrame:
    """(item, accuracy, n): overall, mean of task means, abstention, and one row per task (known ones always)."""
    x = logs.select("question_id", F.coalesce(F.col("label"), F.lit(False)).cast("double").alias("v")).join(
        records.select("question_id", "question_type"), "question_id")
    x = x.withColumn("abstains", F.col("question_id").endswith("_abs"))
    spark = records.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in QUESTION_TYPES])).alias("question_type"))
    tasks = x.groupBy("question_type").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    tasks = known.join(tasks, "question_type", "full").select("question_type", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    acc = F.round(F.try_divide(F.col("s"), F.col("n")), 4)
    per_task = tasks.select(F.concat(F.lit("task:"), "question_type").alias("item"), F.coalesce(acc, F.lit(0.0)).alias("accuracy"), "n")
    zero = F.lit(0.0)
    overall = x.agg(F.round(F.avg("v"), 4).alias("a"), F.count("*").alias("n"))
    abstain = x.where("abstains").agg(F.round(F.avg("v"), 4).alias("accuracy"), F.count("*").alias("n"))
    mean = per_task.where("n > 0").agg(F.round(F.avg("accuracy"), 4).alias("a"), F.count("*").alias("n"))
    return (
        per_task.unionByName(overall.select(F.lit("overall").alias("item"), F.coalesce("a", zero).alias("accuracy"), "n"))
        .unionByName(mean.select(F.lit("task_averaged").alias("item"), F.coalesce("a", zero).alias("accuracy"), "n"))
        .unionByName(abstain.select(F.lit("abstention").alias("item"), "accuracy", "n")))


def first_log_rows(records: DataFrame, logs: DataFrame) -> DataFrame:
    """Shard logs combined: the first row per expected id, by (shard, row_no)."""
    known = logs.join(records.select("question_id"), "question_id", "left_semi")
    return known.groupBy("question_id").agg(F.min(F.struct("shard", "row_no", "label")).alias("f")).select("question_id", "f.shard", "f.label")


def id_coverage(records: DataFrame, logs: DataFrame) -> DataFrame:
    """(kind, question_id, n): expected ids nobody answered, ids answered again, ids nobody asked for."""
    seen = logs.groupBy("question_id").agg(F.count("*").alias("n"))
    x = records.select("question_id", F.lit(True).alias("wanted")).join(seen, "question_id", "full")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    extra = F.when(F.col("n").isNull(), 1).when(F.col("wanted").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    return x.select(kind.alias("kind"), "question_id", extra.cast("long").alias("n")).where("kind IS NOT NULL")


def shard_coverage(records: DataFrame, logs: DataFrame, *, allow_incomplete: bool = False) -> DataFrame:
    """Coverage counts; raises unless complete or ``allow_incomplete``."""
    gaps = id_coverage(records, logs)
    if not allow_incomplete and not gaps.isEmpty():
        raise ValueError("shard logs do not cover the corpus exactly once")
    n = gaps.groupBy("kind").agg(F.sum("n").alias("n"))
    spark = records.sparkSession
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ("missing", "duplicate", "unexpected")])).alias("kind"))
    counts = kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    expected = records.agg(F.count("*").alias("n")).select(F.lit("expected").alias("kind"), "n")
    observed = first_log_rows(records, logs).agg(F.count("*").alias("n")).select(F.lit("observed").alias("kind"), "n")
    return counts.unionByName(expected).unionByName(observed)


def governance_metrics(results: DataFrame) -> DataFrame:
    """Precision, recall and routing rates of the gate; an empty denominator gives 1.0."""
    exp, obs = F.col("expected_decision"), F.col("observed_status")
    quarantined = obs == "quarantined"

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    defs = (
        ("quarantine_precision", quarantined & (exp == "quarantine"), quarantined),
        ("quarantine_recall", quarantined & (exp == "quarantine"), exp == "quarantine"),
        ("unsafe_commit_block_rate", F.col("unsafe") & (obs != "applied"), F.col("unsafe")),
        ("benign_commit_pass_rate", (exp == "auto_apply") & (F.col("observed_decision") == "auto_apply"), exp == "auto_apply"),
        ("review_routing_accuracy", (exp == "require_review") & (obs == "review_required"), exp == "require_review"))
    totals = results.agg(*[n(num).alias(f"num{i}") for i, (_, num, _) in enumerate(defs)], *[n(den).alias(f"den{i}") for i, (_, _, den) in enumerate(defs)])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(F.round(F.try_divide(F.col(f"num{i}"), F.col(f"den{i}")), 4), F.lit(1.0)).alias("score"),
                              F.col(f"den{i}").cast("double").alias("n")) for i, (name, _, _) in enumerate(defs)])
    return totals.select(F.inline(rows))


def routing_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("expected_decision", "observed_status").agg(F.count("*").cast("double").alias("n"))
