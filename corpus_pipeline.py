"""The training-data pipeline over `documents`: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next stage's docs. All but the last return the columns of `documents`.

Defined results, in every stage: a null text counts as an empty one and stays null; empty texts are neither
toxic nor near duplicates nor leaks, hold no secrets and have no tokens; texts are read whole, whatever their
length; rows without doc_id pass all stages, as nothing can name them (the toxicity stage judges them by their
text); an empty table stays empty; without labels of both classes nothing is toxic, without benchmark items
nothing is a leak; further columns are kept whatever their names, but for `token_ids` and `decoded`, which the
last stage makes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termflow.llm import bpe, decontam, near_dedup, secrets, toxicity
from termflow.llm.common import drop_cut, table, written

#: Similarity of near duplicates in percent: that of stages on word shingles; the 85 of `op3_near_dedup` is its query's contract.
NEAR_PERCENT = near_dedup.SIMILAR


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among them, doesn't reject; a score at the limit rejects, and repeated rows go or stay together."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id; of several rows of that the one whose text sorts first."""
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included; rows of one doc_id go together."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the text."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and what these decode to."""
    return bpe.add_tokens(docs, bpe.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: The models, signatures and merges of the stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(functools.partial(stage, spark, docs, sf_dir))
        if k:
            drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
