"""Sinks: JSON lines, split releases with manifests and schemas, vocabularies, canonical datasets. Spark's commit makes each write whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caseloom.operators.components import cut


def write_json_lines(rows: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One JSON object a line, null fields kept; in folders by the columns `by`."""
    rows.write.mode(mode).partitionBy(*by).option("ignoreNullFields", "false").json(path)


def write_vocabulary(rows: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """Sorted tab-separated text, gzipped."""
    rows.sort(*order).write.mode(mode).option("sep", "\t").option("compression", "gzip").csv(path)


def schema_json(rows: DataFrame) -> str:
    return rows.schema.json()


def write_release(spark: SparkSession, rows: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> DataFrame:
    """Completed rows as JSON lines in a folder a split, their schema beside them; returns split, rows."""
    done = rows.where("completed")
    write_json_lines(done, f"{path}/data", (split,), mode)
    spark.createDataFrame([(schema_json(done),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/schema")
    return done.groupBy(split).agg(F.count("*").alias("rows"))


def canonical_dataset(rows: DataFrame, order: Sequence[str], id_: str = "record_id", digest: str = "source_hash") -> DataFrame:
    """Rows with unique processing ids and marked copies; nothing is dropped.

    Repeated ids get ::row-N (N: their rank in order, from 0) and keep the first one as duplicate_source_id. A row whose digest an earlier row has
    names that row's id in exact_duplicate_of; null digests are equal to each other, null ids stay null.
    """
    # ranks of all rows come from ranks in their partition of the order, so no window holds all rows
    ranked = ranks(rows, order)
    n = ranked.groupBy(F.col(id_).alias("_named")).agg(F.count("*").alias("_n"))
    named = ranked.join(n, F.col(id_).eqNullSafe(F.col("_named"))).withColumn("duplicate_source_id", F.when(F.col("_n") > 1, F.col(id_))).withColumn(id_, F.when(F.col("_n") > 1, F.concat(F.col(id_), F.lit("::row-"), F.col("row_index").cast("string"))).otherwise(F.col(id_))).drop("_named", "_n")
    firsts = named.groupBy(F.col(digest).alias("_digest")).agg(F.min(F.struct("row_index", id_)).alias("_first"))
    out = named.join(firsts, F.col(digest).eqNullSafe(F.col("_digest")))
    return out.withColumn("exact_duplicate_of", F.when(F.col("row_index") > F.col("_first.row_index"), F.col(f"_first.{id_}"))).drop("_digest", "_first")


def ranks(rows: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Rows with their rank (from 0) in a total order: dealt by range, numbered in each part, and lifted by the sizes of the parts before.

    Ties may rank in any order. The sizes are one row a part. Dealt rows are kept: dealt twice, they fall into other parts.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def manifest(rows: DataFrame, text: str = "text", kind: str = "source_kind") -> DataFrame:
    """One row: records, characters and their mean, kinds (map), marked copies and renamed ids."""
    by = rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c"), F.count("exact_duplicate_of").alias("d"), F.count("duplicate_source_id").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(total("n").alias("records"), total("c").alias("total_characters"), F.try_divide(F.sum("c"), F.sum("n")).alias("mean_characters"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("source_kinds"), total("d").alias("exact_duplicate_texts"), total("r").alias("duplicate_id_rows"))
