"""A corpus pipeline over ``documents``: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the last returns
the mix: the documents words are taken from, with their source's target, the words taken and the
slots they go to. A stage's result is written as Parquet and read back for the next.

Every row is judged by its own text, also if its doc_id is missing or repeats. Rows that repeat both doc_id and text count as one
document. Columns beyond those of ``documents`` are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, decontaminate, fmindex, mixing, quality, simhash

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", fmindex.stage),
    ("decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
]

#: Learned rules, SimHash and pseudorandom draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
