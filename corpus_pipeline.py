"""Preparation of a training corpus from ``documents``, in stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and
returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes every
stage's result as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from clickflow.llm.common import Store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rejected = toxicity.score(docs, model).where("score >= 0.5").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier line are cut out of the texts; every document stays."""
    return line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, min_tokens=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with 5-word shingle Jaccard of 0.8 or more, the smallest doc_id stays."""
    classes = ngram_join.near_duplicates(docs, width=5, num=80, den=100)
    kept = classes.where("component_id = doc_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampling rate of each remaining document for the target mix of domains."""
    return mixing.mix_to_targets(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mixing", mix),
]

#: Learned scores and iterated fits have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
