"""The corpus pipeline: quality, language, near-duplicates, benchmark passages, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last keep the columns of ``documents``. ``run`` chains them over ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonalvec.llm import common, decontaminate, language, neardup, packing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    return quality.good(docs, common.table(spark, sf_dir, "labels"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose code in the best language is too long go."""
    return language.with_a_language(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a five-word similarity of 0.8 or more one row stays, that of the least id."""
    return neardup.one_per_group(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_identified),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("packing", packed),
]

#: SQL can't express the learned stages; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder; those of the stage before it are removed then."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
