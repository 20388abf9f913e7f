"""A training corpus in five stages over ``documents``; each keeps or drops whole rows, the last adds what it takes of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvina.llm.common import materialise
from corvina.llm.decontam import drop_contaminated
from corvina.llm.langid import fit_languages, reject_undetermined
from corvina.llm.mixing import take_mix
from corvina.llm.simhash import drop_near_duplicates
from corvina.llm.toxicity import fit_toxicity, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain, fitted on the labelled rows among them, doesn't call toxic."""
    return reject_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows where the mixture inference finds a language that stands out."""
    return reject_undetermined(docs, fit_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of SimHash fingerprints."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with any benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words of, with how many."""
    return take_mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stages are fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
