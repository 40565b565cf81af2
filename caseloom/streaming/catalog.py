"""A catalogue kept up to date from a stream of files: the last row of each key, unchanged ones left as they are.

A micro-batch writes a new version beside the old one; a version counts once its folder holds Spark's _SUCCESS mark, so a batch that
is run again after a failure starts from the same predecessor and gives the same rows. Versions before the predecessor go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; ties in order are broken by the content's digest. Rows with a null key go."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("content").desc())
    return rows.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def with_content(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the digest of all columns but key and order."""
    return rows.withColumn("content", F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in (key, order)))), 256))


def upserted(old: DataFrame | None, new: DataFrame, key: str, order: str, batch: int) -> DataFrame:
    """The catalogue after a batch; changed_in tells the batch in which a key's content last changed."""
    rows = latest(with_content(new, key, order), key, order).withColumn("changed_in", F.lit(batch).cast("bigint"))
    if old is None:
        return rows
    had = old.select(key, F.col(order).alias("_order"), F.col("content").alias("_content"), F.col("changed_in").alias("_changed"))
    fresh = rows.join(had, key, "left").where(F.col("_order").isNull() | (F.col(order) >= F.col("_order")))
    fresh = fresh.withColumn("changed_in", F.when(F.col("_content") == F.col("content"), F.col("_changed")).otherwise(F.col("changed_in"))).select(*rows.columns)
    return old.join(fresh.select(key), key, "left_anti").select(*rows.columns).unionByName(fresh)


def versions(spark: SparkSession, target: str) -> list[int]:
    """All whole versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def version(spark: SparkSession, target: str, before: int) -> int | None:
    """The last whole version lower than a batch's number."""
    return max((n for n in versions(spark, target) if n < before), default=None)


def forget(spark: SparkSession, target: str, before: int) -> None:
    """Drops versions lower than one."""
    for n in versions(spark, target):
        if n < before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def catalog(spark: SparkSession, target: str, before: int = 1 << 62) -> DataFrame | None:
    """The catalogue as it stands, or None."""
    found = version(spark, target, before)
    return None if found is None else spark.read.parquet(f"{target}/{found}")


def follow(spark: SparkSession, source: str, schema: StructType | str, target: str, state: str, key: str, order: str, kind: str = "json", files_per_batch: int = 1000) -> StreamingQuery:
    """Brings the catalogue at target up to date with all files at source, then ends; later calls take new files only."""
    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        upserted(catalog(session, target, number), rows, key, order, number).write.mode("overwrite").parquet(f"{target}/{number}")
        forget(session, target, version(session, target, number) or 0)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
