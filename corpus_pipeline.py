"""A corpus pipeline of five stages over ``documents``: toxicity, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents. Null and empty texts pass every stage: they are not toxic, equal
ones are copies of each other (one stays), they hold no personal data, are always mixed in, and have no ids. Equal rows are copies of each other; of rows that share a doc_id and stand for their class one stays,
rows without a doc_id all stay. Very long texts pass like others, whole. Further columns are carried along whatever their names; an
empty table passes every stage and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlake.llm import pieces, pii, probminhash, raking, toxicity
from scanlake.llm.queries import vocabulary
from scanlake.llm.words import importable, read, staged


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    importable(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id."""
    importable(spark)
    return probminhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind; n_chars follows the text."""
    importable(spark)
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target shares of tokens."""
    importable(spark)
    return raking.sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids."""
    importable(spark)
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("encoding", encoded)]

#: Learned scores, sketches and fitting by turns have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
