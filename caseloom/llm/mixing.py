"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the corpus's whole size. A source's target
stops at `epochs` times its own size and the excess goes to the others by weight, again and again: the fixed point is
min(weight * level, cap), and the level follows from a running sum over the sources sorted by cap / weight.

A document is taken floor(target / source size) times, and once more if it lies in the fraction left: documents stand
in a seeded order, cut into HASH_BUCKETS ranges of the hash, each again into as many; ranges below the cut are taken whole, and only the
range of the second cut, about a millionth of a source, is ordered. The taken size misses a target by half a document at
most. Rows outside that range are decided where they lie: the table of sources is broadcast if it has at most
MOST_NAMES bytes of names and MOST_SOURCES rows, else joined by source and SALTS salts.

Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own. Repeated rows count as
often as they occur. Only the id, text and source columns are read. A corpus without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, checkpointed

EPOCHS, SEED, HASH_BUCKETS = 3, 20, 1024
MOST_SOURCES, MOST_NAMES, SALTS = 100_000, 1 << 23, 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> with target; one row a source."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = W.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    upto = by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = F.col("cap") / F.col("weight")
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * float(epochs))
        .withColumn("ratio", ratio)
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("open", F.max(F.col("free").cast("int")).over(upto) == 1)
        .withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (whole copies that the mix takes) and taken (words) of each row; keep: and these columns, as the struct row."""
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        *([F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []),
    ).withColumns({"b": F.pmod(F.shiftright("h", 40), F.lit(HASH_BUCKETS)), "b2": F.pmod(F.shiftright("h", 20), F.lit(HASH_BUCKETS))})
    buckets = rows.groupBy("source", "b").agg(F.sum("size").alias("bucket_size"))
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs)
    running = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = buckets.withColumn("upto", F.sum("bucket_size").over(running))
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    beyond = F.col("upto") > F.col("left")
    plan = checkpointed(
        upto.alias("x")
        .join(sources.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")))
        .select("x.source", "x.b", "x.upto", "x.bucket_size", "y.source_size", "y.target")
        .withColumn("whole", F.floor(share + 1e-12))
        .withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .groupBy("source", "source_size", "target", "whole", "left")
        .agg(F.min(F.when(beyond, F.struct("b", (F.col("upto") - F.col("bucket_size")).alias("below")))).alias("cut"))
        .select("source", "source_size", "target", "whole", "left", F.coalesce("cut.b", F.lit(HASH_BUCKETS)).alias("cut"), F.coalesce("cut.below", F.lit(0)).alias("below"))
    )
    # the range of the cut, in ranges of its own
    parts = by_source(rows, plan).where("b = cut").groupBy("source", "b2", "left", "below").agg(F.sum("size").alias("part_size"))
    upto2 = F.col("below") + F.sum("part_size").over(W.partitionBy("source").orderBy("b2").rowsBetween(W.unboundedPreceding, W.currentRow))
    fine = parts.withColumn("upto", upto2).groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("b2", (F.col("upto") - F.col("part_size")).alias("below")))).alias("fine"))
    named = plan.alias("x").join(fine.withColumnRenamed("source", "of").alias("y"), F.col("x.source").eqNullSafe(F.col("y.of")), "left")
    known = by_source(rows, checkpointed(named.select("source", "source_size", "target", "whole", "left", "cut", F.coalesce("fine.b2", F.lit(HASH_BUCKETS)).alias("cut2"), F.coalesce("fine.below", F.lit(0)).alias("below"))))
    again = F.col("whole") < epochs
    last = (F.col("b") == F.col("cut")) & (F.col("b2") == F.col("cut2"))
    under = (F.col("b") < F.col("cut")) | ((F.col("b") == F.col("cut")) & (F.col("b2") < F.col("cut2")))
    apart = known.where(~last).withColumn("repeats", F.col("whole") + (again & under).cast("bigint"))
    order = W.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(order), F.lit(0))
    within = known.where(last).withColumn("repeats", F.col("whole") + (again & (F.col("below") + inside + F.col("size") / 2 <= F.col("left"))).cast("bigint"))
    return apart.unionByName(within).select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("bigint").alias("taken"), *(["row"] if keep else []))


def by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan: without a shuffle of the rows if the plan is small, and with salted sources if not."""
    n, names = plan.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("source").cast("string"))), F.lit(0))).first()
    plan = plan.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if n <= MOST_SOURCES and names <= MOST_NAMES:
        return rows.join(F.broadcast(plan), same).drop("of")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("own", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt"))).drop("of", "own", "salt")


def applied(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of df, all columns, as often as the mix takes them; a row without words, which has no size to take, stays once."""
    took = mix(df, id_col, text_col, source_col, weights, epochs, seed, keep=df.columns)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("repeats")).cast("int")
    return took.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(f"row.{c}").alias(c) for c in df.columns))
