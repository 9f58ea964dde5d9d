"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage works on all that its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import stages
from sparkweft.llm.common import Scratch

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixture),
    ("sharding", stages.sharding),
]

#: Learned language profiles and the flow's block plan have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = scratch.keep(stage(spark, docs, sf_dir))
        docs = out
    return docs
