"""Queries of this subpackage: name -> callable(spark, sf_dir), and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, cluster, exact_dedup, fingerprint, importance, kd_shards, mixing, near_dup, records, repeats, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the 50k byte-level vocabulary."""
    return bpe.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@_query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the multilingual rank file."""
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@_query
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of all documents, written and read back."""
    return records.token_records(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@_query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents' sources."""
    return mixing.mix(documents(spark, sf_dir))


ORACLES["op6_mix"] = mixing.ORACLE


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


ORACLES["op9_exact_dedup"] = exact_dedup.ORACLE


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five words, similarity 0.8 or more."""
    return near_dup.near_groups(documents(spark, sf_dir), k=5, num=80, den=100)


ORACLES["op2_ngram_jaccard_join"] = near_dup.ORACLE


@_query
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand at two places of the documents."""
    found = repeats.repeated_spans(documents(spark, sf_dir), min_words=50)
    text = F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    extra = F.transform("extra", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return found.select("doc_id", "n_words", "repeated_words", "extra_words", F.array_join(text, ",").alias("spans"), F.array_join(extra, ",").alias("extra_spans"))


ORACLES["op10_repeated_passages"] = repeats.ORACLE


@_query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(documents(spark, sf_dir))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learnt from the labels outside the held-out rows."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op1_url_filter"] = url_filter.ORACLE


@_query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution: a quarter of those with 20 words or more."""
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, min_words=20)


ORACLES["op11_importance"] = importance.ORACLE


@_query
def op12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clusters of all embeddings."""
    return cluster.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10)


ORACLES["op12_cluster"] = cluster.ORACLE


@_query
def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of even bytes."""
    return kd_shards.shard(documents(spark, sf_dir), shards=24)


ORACLES["op13_kd_shards"] = kd_shards.ORACLE
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
