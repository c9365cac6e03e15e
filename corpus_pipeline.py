"""A corpus pipeline: documents through quality rules, near-dedup, redaction, mixing and tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, pieces, pii, quality
from tessera.llm.common import stored, table

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", neardup.stage),
    ("personal data", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL can't express tokenization; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
