"""From raw documents to tokens: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns digests of the encoded texts.
``run`` writes each stage's rows to the shared folder before the next one starts, so
a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from caseflow.llm.common import cut, table
from caseflow.llm.queries import tokenizer_path

#: Least similarity, in percent, of texts of which one stays.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the fused evidence accepts."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (similarity NEAR_PERCENT or more), the document with the smallest id."""
    return near_dedup.deduplicate(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics."""
    return mixing.sample(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return sentencepiece_codec.digests(docs, sentencepiece_codec.read_model(tokenizer_path()))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: SQL cannot express the trained and sampled stages; tests replay them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
