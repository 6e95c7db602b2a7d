"""From raw documents to token numbers: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's documents. All but the last return the columns of
``documents``. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesight.llm.pipeline import encoded, exact_copies, known_language, mixed, near_copies
from lakesight.session import materialize

STAGES = [
    ("language", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mix", mixed),
    ("encode", encoded),
]

#: SQL has no neural network, no Pareto sample by this hash and no BPE: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
