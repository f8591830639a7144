"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact_dedup, mixing, near_dup, shared, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 4 doesn't predict as toxic; learnt from the labels outside the held-out rows.

    Null and empty texts have the score of an empty text; repeated rows stay or go together; long texts are read whole;
    without labels all score alike and stay. An empty table gives no rows; other columns may have any names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.harmless(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id; null ids come last.

    Null counts as empty, so of null, empty and blank texts one stays each way they normalise; repeated rows are copies.
    An empty table gives no rows; other columns, of any name, are carried as they are.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more.

    The document with the group's smallest id stays; rows without an id stay; null, empty and wordless texts stay. An
    empty table gives no rows; other columns may have any names.
    """
    return near_dup.one_of_each(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets ask, at most twice.

    A null source is a source, the last; texts without words come with their source's draw; rows that share an id share
    their draw, rows without an id draw by their texts. An empty table gives no rows; other columns may have any names.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of ids and decoded text.

    Null and empty texts have no ids; null ids and repeated rows stay; long texts are encoded whole. An empty table gives no
    rows; other columns are not read.
    """
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The toxicity model is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
