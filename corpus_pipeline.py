"""The corpus pipeline: reject toxic documents, drop copies and near-copies, remove benchmark leaks, pack what is left.

Every stage takes null and empty texts as equal and treats texts of any length whole; all but the last return the rows
they keep as they are, extra columns and all. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.common import MADE, stored, swept
from fathomline.llm.decontamination import decontaminated
from fathomline.llm.exact_dedup import deduplicated
from fathomline.llm.packing import packed
from fathomline.llm.simhash import near_deduplicated
from fathomline.llm.tokens import tokenizer_path
from fathomline.llm.toxicity import accepted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; equal texts have equal scores. Without labels of both classes all stay."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text: the smallest doc_id, null last; of repeated rows one."""
    return deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near-copies: the smallest doc_id, null last; repeated rows stay or go together."""
    return near_deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; the rows of one doc_id, null included, are one document."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids; documents of one place on the curve follow their doc_ids."""
    return packed(docs, tokenizer_path(), end_id=2, length=4096)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each earlier stage's are written to the shared folder and read again.

    A stage's own tables, and its predecessor's rows, are deleted when its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(MADE)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        swept(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
