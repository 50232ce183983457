"""Packing documents into sequences of a fixed number of tokens, by the cutting-stock linear program over their lengths.

A document longer than a sequence fills whole sequences by itself; what is left of it (or the whole shorter document) is an item.
Items are counted by length class (units of ``UNIT`` tokens), which is all that the linear program sees: column generation
over patterns of classes, priced by a knapsack. Items are ranked inside their class and the rounded patterns say
which ranks share a sequence. That many sequences are kept as the items' tokens can fill, those of the
least waste; items of the others are cut to fill what is missing in the kept ones, and the last tokens form sequences whose lengths are
powers of two. So no sequence needs padding, and only a few documents in a hundred are cut.

Ranks and the places of fillers come from range-partitioned prefix sums; windows work inside one sequence only. Ids are made
twice for the documents that are cut, once for all others, and never stored.

Defined results: a null text is empty and has the end id alone; null ids come first; rows that repeat (id and text) are packed each for
itself; ties in length are ranked by id, then by a hash of the text; a very long text fills many sequences;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from claimweave.llm import cutting_stock, token_files
from claimweave.llm.common import kept, running, small, text_of, workers
from claimweave.plans.session import materialise

CAPACITY, UNIT, END_ID = 4096, 32, 2
#: Rows of cut documents that are broadcast to find their texts; more are shuffled.
SMALL_CUT = 50_000
PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _measuring(path: str, end: int, capacity: int):
    """Batches of ``doc_id, tie, text`` to ``doc_id, tie, n, crcs``: a crc for every ``capacity`` ids of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_files.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, token_files.ROWS):
                part = batch.slice(at, token_files.ROWS)
                ids, sizes = own.encode(part.column(2).to_pylist(), end)
                view, place, crcs, ends = memoryview(ids), 0, [], [0]
                for n in sizes.tolist():
                    crcs += [zlib.crc32(view[4 * (place + a):4 * (place + min(n, a + capacity))]) for a in range(0, n, capacity)]
                    ends.append(len(crcs))
                    place += n
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(crcs, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), lists], names=["doc_id", "tie", "n", "crcs"])

    return run


def _cutting(path: str, end: int):
    """Batches of ``text, places (start, length, ...)`` to ``place`` rows with their crcs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_files.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, token_files.ROWS):
                part = batch.slice(at, token_files.ROWS)
                ids, sizes = own.encode(part.column(0).to_pylist(), end)
                view, places = memoryview(ids), part.column(1).to_pylist()
                before = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                rows = [{**p, "ids_crc32": zlib.crc32(view[4 * (b + p["start"]):4 * (b + p["start"] + p["length"])])} for b, ps in zip(before, places) for p in ps]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in PIECES]))

    return run


class Packing:
    """The packing of one table of documents (``doc_id`` and ``text``)."""

    def __init__(self, docs: DataFrame, path: str, end: int = END_ID, capacity: int = CAPACITY, unit: int = UNIT):
        self.path, self.end, self.capacity, self.unit = path, end, capacity, unit
        self.docs = workers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))
        measured = materialise(self.docs.mapInArrow(_measuring(path, end, capacity), "doc_id long, tie long, n long, crcs array<long>"), "measured")
        rest = F.col("n") % capacity
        items = measured.where(rest > 0).select(
            "doc_id", "tie", F.col("n").alias("doc_tokens"), (F.col("n") - rest).alias("start"), rest.alias("length"),
            F.element_at("crcs", -1).alias("ids_crc32"), F.ceil(rest / unit).cast("int").alias("cls"))
        #: Items with their class and their rank in it.
        self.items = materialise(running(items, ["cls"], ["length", "doc_id", "tie"], {"rank": F.lit(1)}), "items")
        by_class = self.items.groupBy("cls").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()  # capacity / unit rows
        total = sum(r.tokens for r in by_class)
        #: Sequences of several items, and tokens that remain for the last ones.
        self.full, self.tail = divmod(total, capacity)
        rows = cutting_stock.plan({r.cls: r.n for r in by_class}, capacity // unit, self.full)
        self.plan = docs.sparkSession.createDataFrame(rows, "p_cls int, low long, high long, each long, first long")
        self.tails = [1 << b for b in reversed(range(capacity.bit_length())) if self.tail >> b & 1]
        self.whole = measured.where(F.col("n") >= capacity)

    def own_sequences(self) -> DataFrame:
        """Pieces that fill a sequence alone."""
        times = F.floor(F.col("n") / self.capacity)
        rows = running(self.whole, [], ["doc_id", "tie"], {"before": times})
        rows = rows.select("doc_id", "n", "before", F.posexplode(F.slice("crcs", F.lit(1), times.cast("int"))).alias("i", "crc"))
        return rows.select(
            "doc_id", (F.col("i").cast("long") * self.capacity).alias("start"), F.lit(self.capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
            F.col("n").alias("doc_tokens"), (F.col("before") + F.col("i") + (self.full + len(self.tails))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def shared_sequences(self) -> DataFrame:
        """Pieces in sequences of several items: the planned items, then the cut ones that fill them."""
        spark = self.docs.sparkSession
        # the plan has a few rows per pattern, and as many patterns as classes, whatever the table's size
        fits = (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        placed = self.items.join(F.broadcast(self.plan), fits, "left").withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
        placed = materialise(placed.drop("p_cls", "low", "high", "each", "first"), "placed")
        inside = W.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(W.unboundedPreceding, -1)
        planned = placed.where("sequence_id IS NOT NULL")
        offset = F.coalesce(F.sum("length").over(inside), F.lit(0))

        fillers = running(placed.where("sequence_id IS NULL").drop("sequence_id"), [], ["cls", "rank"], {"at": F.col("length")})
        gaps = planned.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < self.capacity).withColumn("gap", self.capacity - F.col("used"))
        gaps = kept(running(gaps, [], ["sequence_id"], {"at": F.col("gap")}))
        end = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
        last = []
        for i, size in enumerate(self.tails):
            last.append((self.full + i, 0, size, end))
            end += size
        gaps = gaps.select("sequence_id", "used", "gap", "at").union(spark.createDataFrame(last, "sequence_id long, used long, gap long, at long"))

        def in_buckets(df: DataFrame, size: str, at: str) -> DataFrame:
            """Each stretch once per ``capacity`` tokens of the fillers' line that it touches (two at most)."""
            ends = [F.floor(x / self.capacity) for x in (F.col("at"), F.col("at") + F.col(size) - 1)]
            return df.withColumn("bucket", F.explode(F.sequence(*ends))).withColumnRenamed("at", at)

        left, right = in_buckets(fillers, "length", "at_f"), in_buckets(gaps, "gap", "at_g")
        low, high = F.greatest("at_f", "at_g"), F.least(F.col("at_f") + F.col("length"), F.col("at_g") + F.col("gap"))
        met = left.join(right, "bucket").where((low < high) & (F.floor(low / self.capacity) == F.col("bucket")))
        place = F.struct(
            F.col("doc_id"), (F.col("start") + low - F.col("at_f")).alias("start"), (high - low).alias("length"), F.lit(None).cast("long").alias("ids_crc32"),
            F.col("doc_tokens"), F.col("sequence_id"), (F.col("used") + low - F.col("at_g")).alias("offset"))
        # an item has fewer tokens than a sequence, so the list of its pieces is bounded
        cut = kept(met.groupBy("cls", "rank").agg(F.first("doc_id").alias("id"), F.first("tie").alias("tie"), F.first("length").alias("tokens"), F.first("ids_crc32").alias("crc"), F.collect_list(place).alias("places")))
        uncut = cut.where(F.size("places") == 1).select("crc", F.col("places")[0].alias("p"))
        uncut = uncut.select(*[F.col("crc").alias(c) if c == "ids_crc32" else F.col(f"p.{c}").alias(c) for c in PIECES])
        several = small(cut.where(F.size("places") > 1).select("cls", "rank", "id", F.col("tie").alias("t"), "places"), SMALL_CUT)
        texts = self.docs.join(several, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t"))).dropDuplicates(["cls", "rank"])
        pieces = texts.select("text", "places").mapInArrow(_cutting(self.path, self.end), ", ".join(f"{c} long" for c in PIECES))
        return planned.withColumn("offset", offset).select(*PIECES).union(uncut).union(pieces)

    def pieces(self) -> DataFrame:
        return self.own_sequences().union(self.shared_sequences())


def packed(docs: DataFrame, path: str, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return Packing(docs, path, end, capacity).pieces()
