"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short, documents long, so the measure is containment: the share of an item's word
shingles that a document has. Items are partitioned by size in powers of two. All items of a partition
keep a MinHash sketch of the same length, their ``k`` smallest shingle hashes, with ``k`` one more than the number
of shingles an item of the partition may miss. A document with enough of an item's shingles
therefore has at least one hash of its sketch: the search loses nothing. Documents are not sketched (an item
is too small a part of a long text for that); their shingle hashes probe the sketches, and what they hit is
verified on the shingles themselves.

Words are runs of letters, marks and digits in lower case. An item with fewer words than a shingle is one
shingle of all its words, and documents are then shingled at that width too.

Defined results: null or wordless items and texts match nothing; items with equal shingles are
one item, reported under its smallest id with their number; repeated documents each get their rows; null ids are
kept as nulls; very long texts are one row's work; an empty table of documents or of items gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import kept, small, text_of

WIDTH = 5
PERCENT = 80
#: Sketches (16 bytes a row) and hits are broadcast up to these numbers of rows, items up to this number of shingles in all; beyond, they are shuffled.
SMALL_SKETCH, SMALL_HITS, SMALL_ITEM_SHINGLES = 1_000_000, 500_000, 1_000_000
WORDS = r"[\p{L}\p{M}\p{N}]+"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def shingles(words: str, width: int, join) -> Column:
    """One value per position of a full shingle; ``words`` names an array column, ``join`` combines a list of columns."""
    starts = F.slice(F.col(words), 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: join([w, *[F.get(F.col(words), i + j) for j in range(1, width)]]))


def hashed(words: str, width: int) -> Column:
    return shingles(words, width, lambda parts: F.xxhash64(*parts))


def spelled(words: str, width: int) -> Column:
    return shingles(words, width, lambda parts: F.concat_ws(" ", *parts))


def at_widths(words: str, widths: list[int], kind) -> Column:
    arrays = [kind(words, w) for w in widths]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def item_sets(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, n_items, shingles, hashes, n`` per distinct item; hashes ascending."""
    listed = items.select("item_id", word_list(text_of()).alias("words")).where("size(words) > 0")
    by_width = [F.when(F.size("words") == w, spelled("words", w)) for w in range(1, width)]
    sets = listed.select("item_id", F.array_sort(F.array_distinct(F.coalesce(*by_width, spelled("words", width)))).alias("shingles"))
    one = sets.groupBy("shingles").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    split = one.withColumn("parts", F.transform("shingles", lambda s: F.split(s, " ")))
    as_hash = F.transform("parts", lambda p: F.coalesce(
        *[F.when(F.size(p) == w, F.xxhash64(*[F.get(p, F.lit(j)) for j in range(w)])) for w in range(1, width + 1)]))
    return kept(split.select(
        "item_id", "n_items", "shingles", F.array_sort(F.array_distinct(as_hash)).alias("hashes"), F.size("shingles").alias("n"),
        F.size(F.get("parts", F.lit(0))).alias("width")))


def sketches(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``hash, item_no``: each item's smallest hashes, as many as its size partition asks for."""
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1  # the largest size of the item's partition
    length = (F.floor(most * (100 - percent) / 100) + 1).cast("int")
    return sets.select(F.explode(F.slice("hashes", F.lit(1), length)).alias("hash"), "item_key")


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` (all columns) with each item they contain: ``item_id, n_items, item_shingles, shared``.

    Every item with at least ``percent`` of its distinct shingles in the text.
    """
    sets = item_sets(items, width).withColumn("item_key", F.xxhash64("shingles"))
    widths = sorted({width, *[r.width for r in sets.select("width").distinct().collect()]})  # at most ``width`` values
    lookup = kept(sketches(sets, percent).distinct())
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_of().alias("__text"))
    key = [F.xxhash64("__text").alias("__k1"), F.xxhash64(F.lit(1), "__text").alias("__k2")]
    probes = keyed.select(*key, word_list(F.col("__text")).alias("words")).select("__k1", "__k2", F.explode(at_widths("words", widths, hashed)).alias("hash"))
    hits = kept(probes.join(small(lookup, SMALL_SKETCH), "hash").select("__k1", "__k2", "item_key").distinct())
    near = keyed.select("__row", "__text", *key).join(small(hits, SMALL_HITS), ["__k1", "__k2"])
    near = near.select("__row", "item_key", word_list(F.col("__text")).alias("words"))
    near = near.select("__row", "item_key", at_widths("words", widths, spelled).alias("here"))
    if (sets.agg(F.sum("n")).first()[0] or 0) <= SMALL_ITEM_SHINGLES:
        sets = F.broadcast(sets)
    verified = near.join(sets, "item_key").select(
        "__row", "item_id", "n_items", F.col("n").alias("item_shingles"), F.size(F.array_intersect("shingles", "here")).alias("shared"))
    verified = verified.where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
    return verified


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_items, item_shingles, shared, containment`` per document and item found in it."""
    rows = contaminated(docs.select("doc_id", "text"), items, width, percent)
    return rows.select("__row.doc_id", "item_id", "n_items", F.col("item_shingles").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared"),
                       (F.col("shared") / F.col("item_shingles")).alias("containment"))


def without_benchmark(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = contaminated(docs.select("text"), items, width, percent)
    texts = kept(found.select(F.xxhash64("__row.text").alias("__k1"), F.xxhash64(F.lit(1), "__row.text").alias("__k2")).distinct())
    keyed = docs.withColumns({"__k1": F.xxhash64(text_of()), "__k2": F.xxhash64(F.lit(1), text_of())})
    return keyed.join(small(texts, SMALL_HITS), ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
