"""Token ids as Parquet: list columns with dictionary or delta encoding, controlled row groups, page indexes.

Documents are range-partitioned by id, encoded in Arrow batches and written by Spark's committing writer, one file per
range, rows in ascending order of id. A file holds the metadata columns beside the id lists; Parquet writes
column and offset indexes for each page, so a reader that wants a few documents or only ``n_tokens`` skips the rest.
Ids are dictionary-encoded while the dictionary fits and delta-encoded (format version 2) beyond.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with equal ids are
ordered by a hash of their text; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from claimweave.llm.common import before_run, kept, small, text_of, workers
from claimweave.llm.transducer import byte_names
from claimweave.plans.session import scratch_dir

END_ID = 2
#: Row groups, pages and dictionaries of the id files.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 32 << 20, 256 << 10, 5_000, 1 << 20
#: Remembered words per worker; when full they are forgotten.
MOST_WORDS = 300_000
#: Texts that a worker encodes at once.
ROWS = 500
SCHEMA = "doc_id bigint, tie bigint, file int, n_tokens bigint, ids array<int>"
SMALL_FILES = 200_000


# White space as the tokenizer's expressions know it; its splitting expression for texts below U+0250, where
# letters and numbers can be listed.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
_WORDS = re.compile(f"[^{BLANKS}]+")
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]")


class WordEncoder:
    """Ids of whole texts through the library, asked once per piece that it encodes on its own.

    The tokenizer drops white space, normalises and then splits by an expression, so the ids of a text are those of its
    blank-separated words in a row: nothing composes across a blank. Texts that stay below U+0250 are in
    composed form already and are split further, by the same expression, into words, digits and marks, which
    repeat more.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model, self.names = self.tokenizer.model, byte_names()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))

    def encode(self, texts: list[str], end: int) -> tuple[bytes, np.ndarray]:
        """All ids end to end as little-endian integers, and the number of ids of each text (with its end id)."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known, split, pieces, words = self.known, [], set(), set()
        for text in texts:
            lowered = (text or "").lower()  # a small letter may lie beyond although its capital does not
            whole = _BEYOND.search(lowered) or self.special.search(text or "")
            parts = _WORDS.findall(text or "") if whole else _PIECES.findall(lowered)
            split.append(parts)
            (words if whole else pieces).update(w for w in parts if w not in known)
        words = sorted(words - pieces)
        for w in pieces:  # normalised and split already: only the merges remain, on the bytes' names
            named = w if w.isascii() and w.isprintable() else "".join(map(self.names.__getitem__, w.encode("utf-8")))
            known[w] = array("i", [t.id for t in self.model.tokenize(named)]).tobytes()
        for at in range(0, len(words), 1_000):
            some = words[at:at + 1_000]
            known.update((w, array("i", e.ids).tobytes()) for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)))
        close = array("i", [end]).tobytes()
        flat = [b"".join([known[w] for w in s]) + close for s in split]
        sizes = np.array([len(f) // 4 for f in flat], dtype=np.int64)
        for w in (*pieces, *words):
            if len(w) > 64:
                del known[w]
        return b"".join(flat), sizes


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, with what it remembers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encoding(path: str, end: int):
    """Batches of ``doc_id, tie, file, text`` to ``doc_id, tie, file, n_tokens, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, sizes = own.encode(part.column(3).to_pylist(), end)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sizes), lists], names=["doc_id", "tie", "file", "n_tokens", "ids"])

    return run


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values, bounds = np.asarray(ids.values).astype("<i4", copy=False), np.asarray(ids.offsets)
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(bounds, bounds[1:])], type=pa.int64())


def write_ids(docs: DataFrame, path: str, target: str, end: int = END_ID) -> None:
    """Writes ``doc_id, file, n_tokens, ids`` to the folder ``target``; ``file`` numbers the files in order of id."""
    keyed = workers(docs).select("doc_id", text_of().alias("text")).withColumn("__tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    numbered = ranged.select(F.col("doc_id").cast("long").alias("doc_id"), "__tie", F.spark_partition_id().alias("file"), "text")
    (numbered.mapInArrow(_encoding(path, end), SCHEMA).write
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(target))


def read_ids(spark, target: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(target)


def digests(spark, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: ``start`` counts the ids of all documents before."""
    files = read_ids(spark, target)
    slim = kept(files.select("doc_id", "tie", F.col("file").alias("__run"), "n_tokens", ids_crc32("ids").alias("ids_crc32")))
    offsets = before_run(slim, [], {"n": F.sum("n_tokens")}).select(F.col("__run").alias("__r"), "n_before")
    inside = W.partitionBy("__run").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = slim.select("*", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    rows = rows.join(small(offsets, SMALL_FILES), F.col("__run") == F.col("__r"))
    return rows.select("doc_id", (F.col("n_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` into the shared folder and returns the digests of what was written."""
    spark = docs.sparkSession
    target = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, target, end)
    return digests(spark, target)
