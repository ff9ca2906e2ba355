"""A training-data pipeline over ``documents``: quality, toxicity, near duplicates, decontamination, tokens.

Each stage works on all rows that the stages before it kept, and its result is written as Parquet and read again. A null text counts as
an empty one; rows with a null id pass the stages that compare documents by id. Extra columns pass through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mdframe.llm.bpe import digest_documents
from mdframe.llm.common import staged, table, tune, unstage
from mdframe.llm.decontaminate import keep_uncontaminated
from mdframe.llm.minhash import keep_one
from mdframe.llm.quality import fit_quality, keep_good
from mdframe.llm.toxicity import fit_toxicity, keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores under 0.3."""
    tune(spark)
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8 or more."""
    tune(spark)
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with digests of the ids and of what they decode to."""
    tune(spark)
    return digest_documents(docs, with_ids=True)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Trained scores and byte-pair merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
