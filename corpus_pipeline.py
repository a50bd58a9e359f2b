"""The corpus pipeline: language ID, line dedup, near-duplicate removal, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire import scratch
from quire.llm.langid import stage_language_id
from quire.llm.linededup import stage_line_dedup
from quire.llm.packing import stage_packing
from quire.llm.simhash import stage_simhash

STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("packing", stage_packing),
]

#: A classifier's decisions and token packing can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``, each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
