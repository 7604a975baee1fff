"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import jaccard_join, language_id, packing, personal_data, quality_rules
from vacantia.session import cut_lineage

STAGES = [
    ("quality_rules", quality_rules.kept_documents),
    ("language_id", language_id.kept_documents),
    ("jaccard_join", jaccard_join.kept_documents),
    ("personal_data", personal_data.redacted),
    ("packing", packing.packed_documents),
]

# Trees, naive Bayes, the semi-Markov field and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
