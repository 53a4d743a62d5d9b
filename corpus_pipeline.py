"""Corpus cleaning from raw documents to token ids, one stage per operator.

Each stage takes all that the one before kept.  Stages that filter return the columns of
documents; the last one returns token counts and digests.

Defined results, as of the operators: null and empty texts stay and have no tokens; null ids are documents of their
own; columns beyond those of documents, whatever their names, pass through all stages but the last; empty tables give
empty results, and without labels or benchmark items nothing is rejected for them; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontam, neardup, secrets, toxicity
from ledgerloom.llm.arrays import stored
from ledgerloom.llm.queries import table, tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go."""
    return toxicity.without_toxic(docs, toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"))))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % or more of their five-word shingles the smallest doc_id stays."""
    return neardup.deduplicate(docs, size=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(docs, *tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_neardup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scans", hide_secrets),
    ("byte_bpe", encode),
]
#: a trained classifier and merges of byte pairs can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
