"""The training-corpus pipeline: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.llm import decontaminate, linededup, mixing, quality, simhash
from turnmill.llm.common import materialize, table

STAGES = [
    ("quality", quality.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
