"""N-gram Jaccard join as a blocked sparse matrix product, and the groups its links make.

The document by n-gram incidence matrix is never multiplied whole. Its columns are dealt into blocks by hash, per class of
row sizes, in a number that follows from the size-derived bound on how far two similar rows can differ: rows
that reach the similarity agree entirely in at least one non-empty block. Only rows that meet in a block are
multiplied, and their overlap counts decide; a pair whose sizes or whose overlap so far rules the
similarity out is dropped. Nothing is lost: the blocks are a filter without false negatives.

Rows that meet in a block are not multiplied pair by pair. Of each block's rows the one that meets most others is the
pivot, and each row is multiplied with its pivots only. What a row and a pivot do not share, their difference, is
small among near copies, and two rows' distance follows from their differences to the same pivot. So the
rows around a pivot are joined on the first elements of their differences (what the pivot lacks first), as many as the size bound
asks for, with bounds on the places at which two similar rows can first meet; what is left is multiplied whole. A
large group of near copies, similar to each other or not, costs about its size, not its square, and no link
between components is missed. Equal sets are one row of the matrix.

Words are blank-separated (ASCII blanks), ``A-Z`` in lower case; a document's set has its distinct ``width``-word
shingles (64-bit hashes); with fewer words, the whole sequence as one.

Defined results: null, empty and blank texts have an empty set and are linked with nothing, not even each other; rows with
equal texts are in one group; null ids take part, but a component is named by its smallest id that is not null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm import shingle_arrays as A
from claimweave.llm.common import Scratch, kept, small, text_of, workers

#: Blocks of columns in which two rows are multiplied.
COLUMN_BLOCKS = 4
#: Rows of class or component tables that are broadcast; larger ones are shuffled.
SMALL_ROWS = 400_000


def _keys(width: int):
    @F.arrow_udf("struct<k1:bigint,k2:bigint,n:bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        rows, parts = texts.to_pylist(), []
        for a, b in A.groups(rows):
            hashes, bounds = A.shingle_sets(rows[a:b], width)
            parts.append((*A.set_keys(hashes, bounds), np.diff(bounds)))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(3)]
        return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["k1", "k2", "n"])

    return keys


def _arrays(width: int):
    @F.arrow_udf("array<bigint>")
    def arrays(texts: pa.Array) -> pa.Array:
        rows, hashes, sizes = texts.to_pylist(), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, b in A.groups(rows):
            h, bounds = A.shingle_sets(rows[a:b], width)
            hashes.append(h.view(np.int64))
            sizes.append(np.diff(bounds))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(hashes), type=pa.int64()))

    return arrays


def _signatures(width: int, percent: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in A.groups(rows):
                hashes, bounds = A.shingle_sets(rows[a:b], width)
                k1, _ = A.set_keys(hashes, bounds)
                signatures, owner, need = A.block_signatures(hashes, bounds, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signatures, type=pa.int64()), pa.array(k1[owner], type=pa.int64()), pa.array(need.astype(np.int32))], names=["block", "row", "need"])

    return deal


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, component`` for the rows that ``links`` (``a, b``) connect; a component is named by its smallest row.

    Smallest labels spread along links and labels are followed to their own labels, so a component settles in
    about as many rounds as the logarithm of its diameter.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links-both")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("row"), "label", F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["row"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["row"] == near["a"]).select("row", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("row").alias("via"), F.col("label").alias("further"))
        moved = spread.join(jump, spread["label"] == jump["via"]).select("row", F.least("label", "further").alias("label"), "old")
        after = scratch.keep(moved.select("row", "label", (F.col("old") > F.col("label")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = after
        if labels.where("moved").isEmpty():
            scratch.drop(both)
            return labels.select("row", F.col("label").alias("component"))


class JaccardJoin:
    """The join of one table of documents (``doc_id`` and ``text``); further columns are not looked at."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent, self.scratch = width, percent, Scratch(docs.sparkSession)
        self.docs = workers(docs).select("doc_id", text_of().alias("text")).withColumn("t", F.xxhash64("text"))
        keyed = self.docs.withColumn("k", _keys(width)("text"))
        #: Every document with the keys of its set.
        self.sets = self.scratch.keep(keyed.select("doc_id", "t", "k.k1", "k.k2", "k.n"), "sets")
        classes = self.sets.where("n > 0").groupBy("k1", "k2").agg(
            F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")).alias("pick"), F.first("n").alias("n"))
        self.classes = self.scratch.keep(classes, "classes")

    def _dealt(self) -> DataFrame:
        """``block, row, need`` of one document per class, as its copies have the same blocks."""
        one = self.classes.select(F.col("pick.doc_id").alias("o_id"), F.col("pick.t").alias("o_t"))
        rest = self.sets.join(one, (F.col("t") == F.col("o_t")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left_anti")
        rest = self.scratch.keep(rest.select(F.col("doc_id").alias("r_id"), F.col("t").alias("r_t")).distinct(), "copies")
        texts = self.docs.join(small(rest, SMALL_ROWS), (F.col("t") == F.col("r_t")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left_anti")
        return texts.select("text").mapInArrow(_signatures(self.width, self.percent), "block bigint, row bigint, need int")

    def block_rows(self) -> DataFrame:
        """``block, row`` of the blocks in which different rows meet, of rows that meet others in as many as a link needs.

        Counts per block are summed before the shuffle, and only blocks with several rows are looked up again, so a block that
        very many rows share is no task of its own.
        """
        dealt = self._dealt()
        shared = self.scratch.keep(dealt.groupBy("block").agg(F.count("*").alias("m")).where("m > 1").select("block"), "shared-blocks")
        met = self.scratch.keep(dealt.join(shared, "block").select("block", "row", "need").distinct(), "met")
        # a document that is there twice with one text is dealt twice
        shared_by_two = self._of_several(met, ["block"])
        enough = shared_by_two.groupBy("row", "need").agg(F.count("*").alias("m")).where(F.col("m") >= F.shiftright("need", 1)).select("row", "need")
        able = self.scratch.keep(shared_by_two.join(enough, ["row", "need"]).select("block", "row"), "able")
        rows = self.scratch.keep(self._of_several(able, ["block"]).select("block", "row"), "block-rows")
        self.scratch.drop(shared, met, able)
        return rows

    @staticmethod
    def _of_several(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose group of ``keys`` has different values of ``row``; groups are told by partial minima and maxima."""
        several = rows.groupBy(*keys).agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select(*keys)
        return rows.join(several, keys, "left_semi")

    def columns_of(self, rows: DataFrame) -> DataFrame:
        """``row, k2, n, ids``: the incidence of the given rows, one document standing for each class."""
        picks = self.classes.join(small(rows.select(F.col("row").alias("k1")).distinct(), SMALL_ROWS), "k1").select("k1", "k2", "n", "pick.doc_id", "pick.t")
        picks = picks.select(F.col("k1").alias("row"), "k2", "n", F.col("doc_id").alias("p_id"), F.col("t").alias("p_t"))
        texts = self.docs.join(small(picks, SMALL_ROWS), (F.col("t") == F.col("p_t")) & F.col("doc_id").eqNullSafe(F.col("p_id")))
        return self.scratch.keep(texts.select("row", "k2", "n", _arrays(self.width)("text").alias("ids")).dropDuplicates(["row", "k2"]), "columns")

    def most_apart(self, n: Column, m: Column) -> Column:
        """The largest symmetric difference of similar sets of sizes ``n`` and ``m``."""
        return n + m - F.ceil((n + m) * self.percent / (100 + self.percent)) * 2

    def multiply(self, pairs: DataFrame, columns: DataFrame) -> DataFrame:
        """The pairs (``a, b``) whose rows are similar.

        Their columns are multiplied block by block, summing the overlap; a pair is given up as soon as its overlap so far and what is
        left of the smaller row cannot reach the similarity.
        """
        cut = F.transform(F.sequence(F.lit(0), F.lit(COLUMN_BLOCKS - 1)), lambda b: F.filter("ids", lambda x: F.pmod(x, F.lit(COLUMN_BLOCKS)) == b))
        blocks = columns.select("row", "n", cut.alias("blocks"))
        left, right = (blocks.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
        met = pairs.join(right, "b").join(left, "a").withColumn("need", F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / (100 + self.percent)))
        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("shared"), F.col("n_a").alias("left_a"), F.col("n_b").alias("left_b"))

        def add(done: Column, block: Column) -> Column:
            hopeless = done["shared"] + F.least(done["left_a"], done["left_b"]) < F.col("need")
            both = F.size(F.array_intersect(block["blocks_a"], block["blocks_b"])).cast("long")
            return F.when(hopeless, done).otherwise(F.struct(
                (done["shared"] + both).alias("shared"), (done["left_a"] - F.size(block["blocks_a"])).alias("left_a"), (done["left_b"] - F.size(block["blocks_b"])).alias("left_b")))

        done = met.select("a", "b", "need", F.aggregate(F.arrays_zip("blocks_a", "blocks_b"), start, add)["shared"].alias("shared"))
        return done.where(F.col("shared") >= F.col("need")).select("a", "b")

    def differences(self, rows: DataFrame, columns: DataFrame) -> DataFrame:
        """``pivot, row, n, apart, near, first``: each row against the pivots of its blocks.

        ``near``: they are linked. ``first``: the leading elements of their difference at which a link to another row around the
        pivot can first show, elements that the pivot lacks before those that the row lacks, each by hash.
        """
        met = rows.groupBy("block").agg(F.count("*").alias("m"))
        standing = self.scratch.keep(rows.join(met, "block").groupBy("row").agg(F.sum("m").alias("met")), "standing")
        pivot = rows.join(standing, "row").groupBy("block").agg(F.max(F.struct("met", "row")).alias("p"))
        pairs = rows.join(pivot, "block").where("row <> p.row").select(F.col("p.row").alias("pivot"), "row").distinct()
        own = columns.select("row", "n", "ids")
        other = columns.select(F.col("row").alias("pivot"), F.col("n").alias("n_p"), F.col("ids").alias("ids_p"))
        both = pairs.join(own, "row").join(other, "pivot")
        both = both.select("pivot", "row", "n", "n_p", F.concat(F.array_except("ids", "ids_p"), F.array_except("ids_p", "ids")).alias("d"))
        near = F.size("d") <= self.most_apart(F.col("n"), F.col("n_p"))
        # a row near the pivot looks for rows that are not: they meet in the first half of its difference, or a little
        # later for the rows' unequal sizes
        places = F.when(near, F.floor(F.size("d") * 100 / (100 + self.percent)) + 2).otherwise(F.floor(F.col("n") * (100 - self.percent) / self.percent) + 1)
        return self.scratch.keep(both.select("pivot", "row", "n", F.size("d").alias("apart"), near.alias("near"), F.slice("d", F.lit(1), places.cast("int")).alias("first")), "differences")

    def linked(self) -> DataFrame:
        """``row, component`` of the rows that have links."""
        rows = self.block_rows()
        columns = self.columns_of(rows)
        around = self.differences(rows, columns)
        spread = around.select("pivot", "row", "n", "apart", "near", F.posexplode("first").alias("place", "id"))
        spread = self.scratch.keep(self._of_several(spread, ["pivot", "id"]), "spread")
        one, two = (spread.select("pivot", "id", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "apart", "near", "place")]) for x in "ab")
        limit = self.most_apart(F.col("n_a"), F.col("n_b"))
        possible = ((F.col("place_a") * 2 <= F.col("apart_a") - F.col("apart_b") + limit) & (F.col("place_b") * 2 <= F.col("apart_b") - F.col("apart_a") + limit))
        meet = one.join(two, ["pivot", "id"]).where((F.col("row_a") < F.col("row_b")) & ~(F.col("near_a") & F.col("near_b")) & possible)
        others = self.multiply(meet.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct(), columns)
        links = self.scratch.keep(around.where("near").select(F.col("pivot").alias("a"), F.col("row").alias("b")).union(others), "links")
        self.scratch.drop(rows, columns, around, spread)
        return components(links, self.scratch)

    def grouped(self) -> DataFrame:
        """``doc_id, t, n, component_id, winner``: every document with the smallest id of its group, and which one stays."""
        labels = self.linked().withColumnRenamed("row", "k1")
        linked = self.scratch.keep(self.classes.join(labels, "k1").select("k1", "k2", "first", "pick", "component"), "linked")
        best = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.min("pick").alias("winner"))
        # a large component is one key of this join: its side is sent to all tasks, or else Spark splits it
        joined = linked.join(small(best, SMALL_ROWS), "component").select("k1", "k2", "component_id", "winner")
        alone = self.classes.join(labels, "k1", "left_anti").select("k1", "k2", F.col("first").alias("component_id"), F.col("pick").alias("winner"))
        of_class = self.scratch.keep(joined.union(alone), "groups")
        out = self.sets.join(of_class, ["k1", "k2"], "left")
        return out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "winner")


def linked_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    return JaccardJoin(docs, width, percent).grouped().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the smallest id (then text hash) stays.

    Documents without words all stay; of rows that repeat the id and text that stay, one does.
    """
    join = JaccardJoin(docs, width, percent)
    won = F.col("winner.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("winner.t") == F.col("t"))
    gone = join.grouped().where("n > 0").select("doc_id", "t", won.alias("won"))
    fate = kept(gone.groupBy("doc_id", "t").agg(F.first("won").alias("won"), F.count("*").alias("times")).where("not won or times > 1"))
    lost, repeated = fate.where("not won"), fate.where("won").select("doc_id", "t")
    keyed = docs.withColumn("__t", F.xxhash64(text_of()))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = small(keys.select(F.col("doc_id").alias("__k_id"), F.col("t").alias("__k_t")), SMALL_ROWS)
        return rows.join(k, (F.col("__t") == F.col("__k_t")) & F.col("doc_id").eqNullSafe(F.col("__k_id")), how)

    stay = among(keyed, lost, "left_anti")
    if repeated.isEmpty():
        return stay.select(*names)
    once = among(stay, repeated, "left_semi").dropDuplicates(["doc_id", "__t"])
    return among(stay, repeated, "left_anti").select(*names).union(once.select(*names))
