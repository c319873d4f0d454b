"""A training corpus in five stages: quality, language, near copies, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, kneser_ney, langid, mixing, simhash
from gridloom.llm.common import new_path, scratch, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold.

    Null and empty texts go; repeated rows of an id stay if one of them is within the threshold; rows without an id stay if
    they hold text. Any further columns stay as they are; an empty table stays empty; texts are read whole.
    """
    return kneser_ney.accepted(docs, kneser_ney.judge(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the classifier knows and whose n-grams are likely in it; null texts and texts without
    a letter go, as does every row if nothing could be learned. Repeated rows stay or go alike; any further columns stay;
    an empty table stays empty."""
    small_batches(spark)
    return langid.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have similarity 0.8 or more, that of smallest id.

    Of rows that repeat an id one stays; rows without an id stay; null and empty texts are copies of each other. Any
    further columns stay as they are; an empty table stays empty; texts are compared whole.
    """
    small_batches(spark)
    return simhash.deduplicate(docs, k=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mixture of sources takes them; those without words go. Null is a source of its own;
    rows that share an id are taken alike; any further columns stay; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to; null and empty texts have none. Each
    row gives one, repeated or not; an empty table gives none; texts are encoded whole."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL can express neither the model's perplexity nor the fingerprints; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others keep of documents. A stage's own tables go once its rows are written, and these
    at the end, but those of the last stage but one, which the result reads."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for at, (_, stage) in enumerate(STAGES[:-1]):
            with scratch(spark):
                path = new_path(spark, "stage", 1 + (at == len(STAGES) - 2))
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
