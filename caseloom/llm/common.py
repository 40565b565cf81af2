"""Shared pieces of the training-data operators."""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, null text as empty: other columns, whatever their names, go no further.

    No alias where the name is right already: the optimizer keeps it in some branches of a plan alone, and equal exchanges then
    aren't reused.
    """
    return df.select(F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_long_id(rows: DataFrame) -> DataFrame:
    """For operators that pack ids as 64-bit numbers: other integers are widened, and text must be of digits (else the cast fails)."""
    return rows if rows.schema["doc_id"].dataType.typeName() == "long" else rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what one Arrow batch holds of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all, so that the zeros of small ones compress."""
    return np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def block_key(ids: list) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(ids, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def digest(col: Column) -> Column:
    """128 bits of a string or binary column."""
    return F.unhex(F.md5(col))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names; a machine's own folder is set only where that is unset and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(os.environ.get("TMPDIR", "/tmp"), "caseloom-checkpoints"))
    return df.checkpoint()


def without_estimates(df: DataFrame) -> DataFrame:
    """A checkpointed frame without the optimizer's estimate of its size.

    A checkpoint keeps that of the plan it cuts, and a join's is the product of its sides': over the rounds of a loop the number's digits
    multiply, and the driver has no memory for it after a dozen.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)
