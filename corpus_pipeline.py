"""A corpus pipeline of the operators in corpuslode/llm: filter, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslode.llm import stages
from corpuslode.llm.common import documents, stage

STAGES = [
    ("language", stages.language),
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("substrings", stages.substrings),
    ("packing", stages.packed),
]

#: SQL can express neither the trained stages nor the packing; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
