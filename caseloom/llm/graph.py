"""Relational helpers: connected components and lookups that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, without_estimates

#: A key has one salt for each of so many parts of all members that it has, so at most twice as many pairs of key and salt are hot.
SHARES = 1 << 14
STARS = 8
#: Bits of the map by which rows are told from those that surely have no partner: 4 MB at most.
BITS, BUCKET = 1 << 25, 1 << 15


def perhaps_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with `_perhaps`: false where the key is surely not among keys (of the first column), so that only the others need an exchange.

    A map of BITS bits, one hash a key, is broadcast. More keys than bits make it say yes to all, which costs time only.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = keys.select(bit(keys.columns[0]).alias("_bit")).groupBy(F.expr(f"_bit div {BUCKET}").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_bit") % BUCKET).alias("_map"))
    found = rows.withColumn("_bit", bit(key)).withColumn("_bucket", F.expr(f"_bit div {BUCKET}")).join(F.broadcast(bits), "_bucket", "left")
    byte = f"cast(conv(hex(substring(_map, cast((_bit % {BUCKET}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.withColumn("_perhaps", F.coalesce(F.expr(f"shiftright({byte}, cast(_bit % 8 as int)) & 1 = 1"), F.lit(False))).select(*rows.columns, "_perhaps")


def with_group(rows: DataFrame, groups: DataFrame, key: str, salt: Column, cut: bool = True) -> DataFrame:
    """rows with the columns of their group, nulls without one; groups: one row for each key, `members` telling how many rows it has; cut: their lineage.

    Keys with more than one of SHARES parts of all members are hot: fewer than SHARES of them exist, whatever the input, so their list is
    broadcast. Rows of a hot key are dealt over as many salts as it has parts, so no task gets more than its share of them,
    rows without a key likewise, and all others over their key alone, in one exchange.
    """
    rest = [c for c in groups.columns if c not in (key, "members")]
    groups = checkpointed(groups) if cut else groups
    # groups stand three times in the plan: all columns are asked for, so that each has the same exchange below it
    whole = groups.where(" and ".join(f"{c} is not null" for c in ("members", *rest)))
    total = whole.agg(F.sum("members").alias("_all"))
    hot = whole.crossJoin(F.broadcast(total)).select(key, F.ceil(F.col("members") * SHARES / F.col("_all")).cast("int").alias("_cuts")).where("_cuts > 1")
    # renamed: rows and groups may come from one frame
    hot = hot.select(F.col(key).alias("_hot"), F.col("_cuts"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(salt), F.lit(SHARES))).when(F.col("_cuts") > 1, F.pmod(F.xxhash64(salt), F.col("_cuts"))).otherwise(0).cast("int")).drop("_hot", "_cuts")
    dealt = groups.select(F.col(key).alias("_of"), *rest).join(F.broadcast(hot), F.col("_of") == F.col("_hot"), "left")
    dealt = dealt.select("_of", *rest, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_cuts"), F.lit(1)) - 1)).alias("_part"))
    return salted.join(dealt, (F.col(key) == F.col("_of")) & (F.col("_salt") == F.col("_part")), "left").select(*rows.columns, *rest)


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with the minimum m of a, joined under a few salts: the middle of a large star has as many rows as the star."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(STARS)).cast("int"))
    return salted.join(least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(STARS - 1)))), ["a", "_salt"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> node, component (the smallest node reachable), for nodes that have an edge to another.

    Alternating large and small stars until a round changes nothing: each round is two joins with pre-aggregated minima, its lineage cut.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    e, before = without_estimates(e), None
    while True:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        large = with_least(both.where("b > a"), both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = with_least(large, large.groupBy("a").agg(F.min("b").alias("m"))).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = without_estimates(checkpointed(small))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
