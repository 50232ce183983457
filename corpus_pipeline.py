"""A training corpus from ``documents``: five stages, each one of the training-data operators with production parameters.

Every stage takes the documents its predecessor kept and returns documents with the same columns; the last one writes token
ids and returns the digests of its files. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontaminate, mixture, ngram_join, token_files, toxicity
from claimweave.llm.common import table
from claimweave.plans.session import materialise

#: Near duplicates share 80 % of their five-word shingles or more; a benchmark item counts as leaked at the same share.
SHINGLE_WORDS, PERCENT = 5, 80


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts are judged by the intercept; repeated rows share their fate; an empty table stays empty; columns stay as they are.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null and wordless texts all stay; of rows that repeat id and text one stays; ties go to the smaller text hash; a null id loses to any
    other; an empty table stays empty; columns stay as they are.
    """
    return ngram_join.one_of_each_group(docs, SHINGLE_WORDS, PERCENT)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts stay, as do all if there are no items; repeated rows share their fate; an empty table stays empty; columns stay.
    """
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"), SHINGLE_WORDS, PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    Texts without words are not taken; a null source is one of its own; rows that tie share what is left; an empty table stays empty;
    columns stay as they are.
    """
    return mixture.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token id files; returns one row per document of the mixture: ``doc_id, start, n_tokens, ids_crc32``.

    A null text has the end id alone; null ids come first; repeated rows each have their ids; an empty table gives no rows.
    """
    return token_files.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_duplicates_out),
    ("benchmark decontamination", benchmark_out),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_ids),
]

#: A trained classifier decides in the first stage, which SQL cannot express; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
