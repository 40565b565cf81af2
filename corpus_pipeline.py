"""A training corpus from `documents`: STAGES in order, each stage's rows written as Parquet and read again as the next one's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from caseloom.llm import pipeline_stages as stages
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_repeated_lines),
    ("ngram_jaccard", stages.without_near_copies),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: The field's training, the seeded draw and the tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, at once; between them rows lie in the warehouse, which all executors share, until the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    out = None
    for k, (name, stage) in enumerate(STAGES):
        before, out = out, f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
