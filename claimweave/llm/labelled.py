"""Labelled rows for fitting: hold-out by crc32 of the id, bounded samples, texts joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import kept, small, text_of

#: Labelled rows of each label that a model is fitted on, about; all if there are fewer. Taken by a hash of the id.
FIT_ROWS = 8_000
SMALL_ROWS = 4 * FIT_ROWS


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, held: int) -> Column:
    """Whether a row is held out; a null id is not."""
    return F.coalesce(remainder(modulus) == held, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` of a bounded sample of the rows that may be learnt from, and how many of each label there are in all.

    A document labelled more than once counts once, with the larger label; null labels and ids teach nothing.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(f"doc_id is not null and label in (0, 1)").where(~held_out(modulus, held))
    usable = kept(usable.groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # two rows at most
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, rows / n))) for k, n in counts.items()], F.lit(1.0))
    chance = (F.xxhash64(F.lit(label), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    picked = usable.where(chance < share)
    texts = docs.select("doc_id", text_of().alias("text")).join(small(picked, SMALL_ROWS), "doc_id")
    return kept(texts.select("text", "label")), counts
