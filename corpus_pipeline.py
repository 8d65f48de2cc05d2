"""A corpus pipeline: quality rules, exact dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; its result
is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.byte_bpe import encoding_stage
from folioframe.llm.exact_dedup import exact_stage
from folioframe.llm.jaccard_join import near_duplicate_stage
from folioframe.llm.mixing import mixing_stage
from folioframe.llm.quality_rules import quality_stage
from folioframe.llm.common import remove_folder, shared_folder

STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express the encoding stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last goes to a folder that all executors share.

    A folder is deleted once the next one is written; that of the last stage's input stays, as the result is lazy.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if done:
            remove_folder(spark, f"{base}/{done}")
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
