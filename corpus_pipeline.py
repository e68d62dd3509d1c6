"""From raw documents to packed training sequences: toxicity, near copies, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns documents again; the last
returns the packed pieces. Nothing but the stage's own verdict removes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import jaccard, mixing, packing, pii, toxicity
from hirelake.llm.common import materialise
from hirelake.llm.queries import bpe_50k, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard 0.8 or more stays, the one with the smallest doc_id."""
    return jaccard.without_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no document goes."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, up to three times, until the sources have their shares of words."""
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids with their place in a sequence."""
    return packing.best_fit_packing(docs, bpe_50k())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", redact),
    ("source mix", mix_sources),
    ("packing", pack),
]

#: Tokenising, nearest examples and chosen paths are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
