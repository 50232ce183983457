"""Conversations with faults, and their cheapest repair to the structure ``(s?(ua)+)?``.

Order, faults and gaps come from DataFrame expressions. The repair is the square-root checkpointed dynamic program of
``repair``: a conversation of up to ``LONG`` rows is solved in one go, streamed through a worker one conversation at a time. A
longer one, of any length, is cut into stretches of rows that lie in range-partitioned runs: each stretch yields its
min-plus matrix, chained backwards they give the cost vectors at the cut points (the checkpoints), each stretch then says where each
start state would lead, chained forwards they give its true start; then all stretches are walked on their own. Only
the text hash of one conversation is sequential by its definition; lines stream through it in order.

Rows are ordered by turn (nulls first), ties by role and text. Defined results: null roles and texts are one blank, a null conversation is one of
its own; rows that repeat are duplicates of the first; blank rows go; an empty table gives no rows; further columns are
ignored; a text of any length is one row's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.llm import repair
from claimweave.llm.common import RUN, kept, ordered_runs, small, workers
from claimweave.plans.session import materialise

#: Rows of a conversation that are solved together; longer conversations are cut into stretches of as many.
LONG = 256
#: Rows of tables about long conversations that are broadcast; more are shuffled.
SMALL_LONG = 100_000
MARKS, SEEN = "[.!?]", r"[^\x20\x09-\x0D]"
ORDER = ("turn", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a checksum of conversation and turn."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name) % 20).alias("f"))
    text = F.when(F.col("f") == 1, F.lit("")).when(F.col("f") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text"))
    rows = rows.where("f <> 0").withColumn("role", F.when(F.col("f") == 4, F.lit("user")).otherwise(F.col("role"))).withColumn("text", text)
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def code_column(duplicate: Column) -> Column:
    """A row's code for the repair."""
    initial = F.left("role", F.lit(1))
    of = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    last = F.regexp_extract("text", rf"({SEEN})[\x20\x09-\x0D]*\z", 1)
    cut = F.when(~last.rlike(MARKS), 4).otherwise(0)
    return F.when(~F.col("text").rlike(SEEN), 9).when(duplicate, 8).otherwise(of + cut).cast("int")


def _bounded(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Groups of neighbouring rows with equal ``keys``, streamed: at most one batch is held beside what the caller keeps."""
    import itertools

    rows = (r for b in batches for r in b.to_pylist())
    return itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _lines(rows: list[dict], edits) -> Iterator[tuple[str, str | None]]:
    """Each edit's letter with the line it leaves, if any."""
    for letter, i, state in edits:
        role = "user" if state == repair.AFTER_U else "assistant"
        if letter == "K":
            role = rows[i]["role"]
        yield letter, None if letter == "D" else f"{role}:{'' if i is None else rows[i]['text']}"


def _codes(rows: list[dict]) -> bytes:
    return bytes(min(r["code"], repair.GONE) for r in rows)


ANSWER = "conv_id long, cost long, audit string, repaired_sha256 string"


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations in order to their repairs."""
    out: list[tuple] = []
    for (conv,), group in _bounded(batches, ["conv_id"]):
        rows = list(group)
        codes = _codes(rows)
        cost = repair.checkpoints(codes, repair.FINAL, len(codes))[0][repair.START]
        hash, audit = hashlib.sha256(), []
        for n, (letter, line) in _numbered(_lines(rows, repair.walk(codes, repair.START, repair.FINAL, True))):
            audit.append(letter)
            if line is not None:
                hash.update(line.encode("utf-8", "surrogatepass") if n == 0 else b"\n" + line.encode("utf-8", "surrogatepass"))
        out.append((conv, cost, "".join(audit), hash.hexdigest()))
        if len(out) >= 1_000:
            yield _answers(out)
            out = []
    yield _answers(out)


def _numbered(lines):
    """Lines with the number of lines left before them."""
    n = 0
    for letter, line in lines:
        yield n, (letter, line)
        n += line is not None


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["conv_id", "cost", "audit", "repaired_sha256"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run to one min-plus matrix per stretch."""
    for (conv, run, part), group in _bounded(batches, ["conv_id", RUN, "part"]):
        flat = [c for line in repair.across(_codes(list(group))) for c in line]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, RUN: run, "part": part, "m": flat}], schema=pa.schema([("conv_id", pa.int64()), (RUN, pa.int32()), ("part", pa.int64()), ("m", pa.list_(pa.int64()))]))


def _ends(pdf):
    """Cost vectors behind each stretch of one conversation: its matrices (one small row per stretch) chained backwards."""
    pdf = pdf.sort_values([RUN, "part"])
    costs, ends = repair.FINAL, []
    for m in reversed(pdf["m"].tolist()):
        ends.append(list(costs))
        costs = tuple(min(min(m[q * 4 + p] + costs[p] for p in range(4)), repair.FAR) for q in range(4))
    pdf["after"] = ends[::-1]
    pdf["last"] = [False] * (len(pdf) - 1) + [True]
    pdf["cost"] = costs[repair.START]
    return pdf[["conv_id", RUN, "part", "after", "last", "cost"]]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each stretch leads from each state."""
    for (conv, run, part), group in _bounded(batches, ["conv_id", RUN, "part"]):
        rows = list(group)
        codes, after, last = _codes(rows), tuple(rows[0]["after"]), rows[0]["last"]
        to = []
        for q in range(repair.STATES):
            end = q
            if repair.checkpoints(codes, after, max(1, len(codes)))[0][q] < repair.FAR:
                for _, _, end in repair.walk(codes, q, after, last):
                    pass
            to.append(end)
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, RUN: run, "part": part, "to": to}], schema=pa.schema([("conv_id", pa.int64()), (RUN, pa.int32()), ("part", pa.int64()), ("to", pa.list_(pa.int32()))]))


def _starts(pdf):
    """The state in which each stretch of one conversation is entered."""
    pdf = pdf.sort_values([RUN, "part"])
    state, starts = repair.START, []
    for to in pdf["to"].tolist():
        starts.append(state)
        state = int(to[state])
    pdf["enter"] = starts
    return pdf[["conv_id", RUN, "part", "enter"]]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches, with what is known of these, to ``conv_id, run, part, place, letter, line``."""
    schema = pa.schema([("conv_id", pa.int64()), (RUN, pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("cost", pa.int64()), ("letter", pa.string()), ("line", pa.string())])
    for (conv, run, part), group in _bounded(batches, ["conv_id", RUN, "part"]):
        rows = list(group)
        edits = repair.walk(_codes(rows), rows[0]["enter"], tuple(rows[0]["after"]), rows[0]["last"])
        out = [{"conv_id": conv, RUN: run, "part": part, "place": i, "cost": rows[0]["cost"], "letter": a, "line": b} for i, (a, b) in enumerate(_lines(rows, edits))]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to one answer per conversation; lines are hashed as they come."""
    for (conv,), group in _bounded(batches, ["conv_id"]):
        hash, audit, some, cost = hashlib.sha256(), [], False, 0
        for r in group:
            audit.append(r["letter"])
            cost = r["cost"]
            if r["line"] is not None:
                hash.update((b"\n" if some else b"") + r["line"].encode("utf-8", "surrogatepass"))
                some = True
        yield _answers([(conv, cost, "".join(audit), hash.hexdigest())])


class Conversations:
    """The conversations of one table (``conv_id, turn, role, text``), in order, with the code of each row."""

    def __init__(self, rows: DataFrame, long: int = LONG):
        self.long = long
        keyed = workers(rows).withColumn("same", F.struct(F.xxhash64("role", "text"), F.hash("text", "role")))
        #: Turns of any number lie in several runs, so a row's place is its run and its place in it.
        self.runs = ordered_runs(keyed.select("conv_id", *ORDER, "same"), ["conv_id", *ORDER])
        inside = W.partitionBy(RUN, "conv_id").orderBy(*ORDER)
        placed = self.runs.select("*", F.row_number().over(inside).alias("at"), *self._neighbour(inside))
        self.placed = materialise(self._coded(placed), "turns")

    @staticmethod
    def _neighbour(inside) -> list[Column]:
        before = F.row_number().over(inside) == 1
        previous = F.lag("role").over(inside)
        again = (F.lag("role").over(inside) == F.col("role")) & (F.lag("text").over(inside) == F.col("text"))
        return [before.alias("opens"), F.left(previous, F.lit(1)).alias("previous"), F.coalesce(again, F.lit(False)).alias("again")]

    def _coded(self, placed: DataFrame) -> DataFrame:
        """Adds the row's code, its stretch and whether its role may not follow the one before."""
        # the first row of each run gets its neighbour from the run before: one small row per run
        edge = self.runs.groupBy(RUN, "conv_id").agg(F.max(F.struct(*ORDER)).alias("end"))
        carried = edge.select(F.col(RUN).alias("r"), F.col("conv_id").alias("c"), F.left(F.lag("end.role").over(W.partitionBy("conv_id").orderBy(RUN)), F.lit(1)).alias("carried"))
        carried = small(kept(carried.where("carried IS NOT NULL")), SMALL_LONG)
        placed = placed.join(carried, F.col("opens") & (F.col(RUN) == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
        pair = F.concat(F.when(F.col("opens"), F.col("carried")).otherwise(F.col("previous")), F.left("role", F.lit(1)))
        placed = placed.withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
        # role and text seen earlier: the first place of each, where there are several (partial sums, so a very common row costs one row per task)
        firsts = placed.groupBy("conv_id", "same").agg(F.min(F.struct(RUN, "at")).alias("first"), F.count("*").alias("times")).where("times > 1")
        firsts = small(kept(firsts.select(F.col("conv_id").alias("f_conv"), F.col("same").alias("f_same"), F.col("first"))), SMALL_LONG)
        placed = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("same") == F.col("f_same")), "left")
        later = F.coalesce(F.struct(RUN, "at") > F.col("first"), F.lit(False))
        return placed.select("conv_id", *ORDER, RUN, "at", "illegal", code_column(later).alias("code"), F.floor((F.col("at") - 1) / self.long).alias("part"))

    def counts(self) -> DataFrame:
        """Per conversation: ``n_rows, gaps, blank, duplicate, truncated, illegal``."""
        n = lambda c: F.sum(c.cast("long"))
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        return self.placed.groupBy("conv_id").agg(
            F.count("*").alias("n_rows"), F.coalesce(span, F.lit(0)).alias("gaps"), n(F.col("code") == 9).alias("blank"), n(F.col("code") == 8).alias("duplicate"),
            n(F.col("code").between(4, 7)).alias("truncated"), n(F.col("illegal")).alias("illegal"))

    def repairs(self, counts: DataFrame) -> DataFrame:
        """``conv_id, cost, audit, repaired_sha256`` of every conversation with rows."""
        long = kept(counts.where(F.col("n_rows") > self.long).select(F.col("conv_id").alias("l_conv")))
        slim = self.placed.select("conv_id", RUN, "at", "part", "role", "text", "code")
        if long.isEmpty():
            return self._short(slim)
        is_long = F.col("conv_id").eqNullSafe(F.col("l_conv"))
        short = slim.join(small(long, SMALL_LONG), is_long, "left_anti")
        return self._short(short).union(self._long(slim.join(small(long, SMALL_LONG), is_long, "left_semi")))

    def _short(self, rows: DataFrame) -> DataFrame:
        ordered = rows.drop("part").repartition("conv_id").sortWithinPartitions("conv_id", RUN, "at")
        return ordered.mapInArrow(_short, ANSWER)

    def _long(self, rows: DataFrame) -> DataFrame:
        keys = ["conv_id", RUN, "part"]

        def stretches(df: DataFrame) -> DataFrame:
            return df.repartition(*keys).sortWithinPartitions(*keys, "at")

        def joined(df: DataFrame, more: DataFrame) -> DataFrame:
            right = small(more, SMALL_LONG).withColumnsRenamed({k: f"k_{k}" for k in keys})
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
            return df.join(right, on).drop(*[f"k_{k}" for k in keys])

        rows = kept(stretches(rows))
        key = f"conv_id long, {RUN} int, part long"
        m = rows.mapInArrow(_matrices, f"{key}, m array<long>")
        ends = kept(m.groupBy("conv_id").applyInPandas(_ends, f"{key}, after array<long>, last boolean, cost long"))
        known = kept(stretches(joined(rows, ends)))
        starts = known.mapInArrow(_exits, f"{key}, to array<int>").groupBy("conv_id").applyInPandas(_starts, f"{key}, enter int")
        edits = stretches(joined(known, kept(starts))).mapInArrow(_edited, f"{key}, place long, cost long, letter string, line string")
        return edits.repartition("conv_id").sortWithinPartitions("conv_id", RUN, "part", "place").mapInArrow(_hashed, ANSWER)


def repaired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Per conversation its faults and cheapest repair: ``conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    found = Conversations(rows, long)
    counts = kept(found.counts())
    repairs = found.repairs(counts).withColumnRenamed("conv_id", "r_conv")
    return counts.join(repairs, F.col("conv_id").eqNullSafe(F.col("r_conv"))).drop("r_conv")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The repairs of all conversations of ``rows`` after damage; one without rows left has zeros and the hash of nothing."""
    done = repaired(damaged(rows)).withColumnRenamed("conv_id", "d_conv")
    out = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
