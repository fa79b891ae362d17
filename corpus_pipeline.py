"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import save
from graphloom.llm.decontaminate import stage_decontaminate
from graphloom.llm.language_id import stage_language
from graphloom.llm.line_dedup import stage_line_dedup
from graphloom.llm.near_dedup import stage_near_dedup
from graphloom.llm.packing import stage_packing

STAGES = [
    ("language", stage_language),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("packing", stage_packing),
]

#: Learned and hashed stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
