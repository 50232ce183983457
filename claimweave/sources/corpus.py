"""Chat-memory corpora: questions with their dated sessions of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from claimweave.plans.epochs import Epochs
from claimweave.plans.ordered import numbered

RECORD = ("question_id string, question_type string, question string, answer string, question_date string, "
          "haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<string>, answer_session_ids array<string>")
_FIELDS = [f.strip().split(" ")[0] for f in RECORD.split(", ")]
_NESTED = "array<struct<" + RECORD.replace(" ", ":").replace(",:", ",") + ">>"
TURN = "role string, content string, has_answer boolean"
# The task names always reported.
QUESTION_TYPES = ("single-session-user", "single-session-preference", "single-session-assistant", "multi-session", "temporal-reasoning", "knowledge-update")


def read_corpus(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Records from a JSON list, an object holding one under data/records/examples, or JSON lines.

    Prefer ``lines`` at scale: one big document cannot be split between tasks.  Sessions stay
    JSON text here so that odd entries (a session that is no list, a turn that is no object)
    can be handled one by one in ``session_turns``.
    """
    schema = RECORD + "".join(f", {k} {_NESTED}" for k in ("data", "records", "examples"))
    raw = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    own = F.array(F.struct(*_FIELDS))
    items = F.coalesce("data", "records", "examples", own)
    text = ("question_id", "question_type", "question", "answer")
    lists = ("haystack_session_ids", "haystack_dates", "haystack_sessions", "answer_session_ids")
    rows = raw.select(F.inline(items))
    return rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text], "question_date",
        *[F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")).alias(c) for c in lists])


def session_turns(records: DataFrame) -> DataFrame:
    """One row per turn; sessions that are not lists count as empty, turns that are not objects are dropped."""
    s = records.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("session_index", "session"))
    texts = F.when(F.col("session").startswith("["), F.from_json("session", "array<string>"))
    objects = F.filter(texts, lambda t: t.startswith("{"))
    t = s.select("question_id", "session_index", F.get("haystack_dates", F.col("session_index")).alias("session_date"),
                 F.posexplode(objects).alias("turn_index", "turn"))
    parsed = t.withColumn("turn", F.from_json("turn", TURN))
    return parsed.select("question_id", "session_index", "session_date", "turn_index",
                         F.coalesce("turn.role", F.lit("unknown")).alias("role"), F.coalesce("turn.content", F.lit("")).alias("content"),
                         F.coalesce("turn.has_answer", F.lit(False)).alias("has_answer"))


def corpus_stats(records: DataFrame, turns: DataFrame) -> DataFrame:
    """Counts, abstentions and session/turn sizes as (item, value), with one row per question type."""
    per = turns.groupBy("question_id").agg(F.count("*").alias("turns"))
    r = records.select("question_id", "question_type", F.size("haystack_sessions").alias("sessions")).join(per, "question_id", "left")
    n_turns = F.coalesce("turns", F.lit(0).cast("long"))
    total = r.agg(
        F.count("*").cast("double").alias("record_count"), F.count(F.when(F.col("question_id").endswith("_abs"), 1)).cast("double").alias("abstention_count"),
        F.round(F.avg("sessions"), 4).alias("avg_sessions"), F.max("sessions").cast("double").alias("max_sessions"),
        F.round(F.avg(n_turns), 4).alias("avg_turns"), F.max(n_turns).cast("double").alias("max_turns"))
    items = total.unpivot([], total.columns, "item", "value")
    by_type = r.groupBy("question_type").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("type:"), "question_type").alias("item"), "value")
    return items.unionByName(by_type)


def select_shard(records: DataFrame, order: str, *, start_index: int = 0, limit: int | None = None) -> DataFrame:
    """Records start_index .. start_index+limit-1 of the ordered corpus."""
    if start_index < 0:
        raise ValueError("start_index must be non-negative")
    rows = numbered(records, [], [order])
    rows = rows.where(F.col("position") > start_index)
    return rows.where(F.col("position") <= start_index + limit) if limit is not None else rows


def select_sample(records: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Seeded sample: the ``size`` records with the smallest hash of (key, seed); all of them if fewer exist."""
    if size < 0:
        raise ValueError("sample size must be non-negative")
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(size).orderBy(key)


def select_records(records: DataFrame, key: str, *, limit: int | None = None, sample_size: int | None = None, sample_seed: int = 0,
                   start_index: int = 0) -> DataFrame:
    """A shard or a sample of the corpus, never both."""
    if sample_size is None:
        return select_shard(records, key, start_index=start_index, limit=limit)
    if limit is not None or start_index:
        raise ValueError("use either a shard (start_index, limit) or a sample, not both")
    return select_sample(records, key, sample_size, sample_seed)


def read_hypotheses(spark: SparkSession, path: str, *, list_file: bool = False) -> DataFrame:
    """Answer or evaluation logs: JSON lines (default), or one JSON list / object."""
    schema = "question_id string, hypothesis string, autoeval_label struct<model:string,label:boolean>"
    rows = spark.read.schema(schema).option("multiLine", str(list_file).lower()).json(path)
    return rows.where(F.coalesce("question_id", "hypothesis").isNotNull())


def resume_append(new_rows: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows not answered yet, to be written with mode('append')."""
    return new_rows.join(done.select(key), key, "left_anti")


def append_log(new_rows: DataFrame, path: str, key: str = "question_id") -> DataFrame:
    """Append the rows whose id the log at ``path`` does not have yet, as one epoch; returns the whole log.

    A run that is killed leaves nothing that readers see; repeated, it adds what is missing. One run appends at a time.
    """
    log = Epochs(new_rows.sparkSession, path)
    fresh = resume_append(first_per_group(new_rows, [key], [F.col(c) for c in new_rows.columns]), log.read("rows", new_rows.schema), key)
    epoch = log.next()
    log.write("rows", fresh, epoch)
    log.commit(epoch)
    return log.read("rows", new_rows.schema).drop("epoch")


INSTRUCTIONS = (
    "Answer the question from the dated chat history below and nothing else.",
    "When a fact changed, use the latest supported statement before the question date unless older history is asked for.",
    "Say that the answer is unknown when the history does not support one.",
)


def prompt_rows(records: DataFrame, turns: DataFrame, *, max_sessions: int | None = None, history_format: str = "json",
                show_evidence: bool = False) -> DataFrame:
    """One context row per question from its last sessions; answers and evidence labels are left out.

    ``show_evidence`` is for debugging only.
    """
    if history_format not in ("json", "nl"):
        raise ValueError("history_format must be 'json' or 'nl'")
    start = F.greatest(F.lit(0), F.size("haystack_sessions") - max_sessions) if max_sessions is not None else F.lit(0)
    r = records.select("question_id", "question_type", "question", "question_date", start.alias("start"), F.size("haystack_sessions").alias("n"), "haystack_dates")
    t = turns.join(r.select("question_id", "start"), "question_id").where("session_index >= start")
    evidence = F.col("has_answer") if show_evidence else F.lit(False)
    if history_format == "json":
        turn = F.struct("turn_index", "role", "content", F.when(evidence, True).alias("has_answer"))
    else:
        turn = F.struct("turn_index", F.concat("role", F.when(evidence, F.lit(" [evidence]")).otherwise(F.lit("")), F.lit(": "), "content").alias("line"))
    sessions = t.groupBy("question_id", "session_index").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    frame = r.select("question_id", "haystack_dates", F.explode(F.expr("CASE WHEN n > start THEN sequence(start, n - 1) ELSE cast(array() as array<int>) END")).alias("session_index"))
    s = frame.join(sessions, ["question_id", "session_index"], "left").withColumn(
        "date", F.coalesce(F.get("haystack_dates", F.col("session_index")), F.lit("unknown")))
    if history_format == "json":
        empty = F.expr("cast(array() as array<struct<role:string,content:string,has_answer:boolean>>)")
        shown = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["has_answer"].alias("has_answer")))
        part = F.struct("session_index", "date", F.coalesce(shown, empty).alias("turns"))
    else:
        head = F.concat(F.lit("[Session "), F.col("session_index").cast("string"), F.lit(" | "), "date", F.lit("]"))
        part = F.struct("session_index", F.concat_ws("\n", F.array(head), F.transform("turns", lambda x: x["line"]), F.array(F.lit(""))).alias("block"))
    history = s.groupBy("question_id").agg(F.array_sort(F.collect_list(part)).alias("history"))
    body = F.to_json("history") if history_format == "json" else F.array_join(F.transform("history", lambda x: x["block"]), "\n")
    lines = [F.lit(x) for x in INSTRUCTIONS] + [
        F.concat(F.lit("Question date: "), F.coalesce("question_date", F.lit("unknown"))), F.concat(F.lit("Question type: "), "question_type"),
        F.lit("History:"), F.coalesce(body, F.lit("[]" if history_format == "json" else "")), F.lit("Question:"), F.col("question"), F.lit("Answer:")]
    return r.join(history, "question_id", "left").select("question_id", "question_type", "question", "question_date", F.concat_ws("\n", *lines).alias("prompt"))


def session_texts(turns: DataFrame) -> DataFrame:
    """One row per session with its turns in order: ``blocks`` as "role: content", and the joined contents."""
    one = F.struct("turn_index", "role", "content")
    return turns.groupBy("question_id", "session_index", "session_date").agg(F.array_sort(F.collect_list(one)).alias("turns")).withColumn(
        "text", F.array_join(F.transform("turns", lambda t: t["content"]), " "))


def first_per_group(df: DataFrame, group: list[str], order: list, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each group; Spark cuts groups before shuffling them."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= keep).drop("__rn")
