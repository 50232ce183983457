"""Token counts of whole texts, as the tokenizers library gives them for a byte-level BPE file.

The counting is done by the transducers of ``transducer.py`` in Arrow batches; no shuffle, bounded memory per worker.
Defined results: a null text is empty and has no token; a special token's string inside a text is that one token, the
library's default; null ids and repeated rows each have their count; a very long text is cut where a pre-token always ends; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from claimweave.llm.common import text_of, workers
from claimweave.llm.transducer import token_counts

LIMIT = 512
#: Texts that a worker unpacks at once.
ROWS = 1_000


def counter(path: str):
    """A column function: tokens of a text column."""

    @F.arrow_udf(LongType())
    def tokens(texts: pa.Array) -> pa.Array:
        some = [token_counts(texts.slice(at, ROWS).to_pylist(), path) for at in range(0, len(texts), ROWS)]
        return pa.array([n for counts in some for n in counts], type=pa.int64())

    return tokens


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document."""
    text: Column = text_of()
    rows = workers(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counter(path)(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
