"""What a review found on larger tables: results that differed from SQL, and plans and memory that outgrew their limits."""

from collections import Counter

from caseloom.llm import graph
from caseloom.operators import scoring as S
from caseloom.sources import sinks
from pyspark.sql import functions as F


def test_canonical_dataset_keeps_all_rows(spark):
    """Many partitions of the order, whose sizes and rows Spark would read by different exchanges; nulls."""
    n = 40_000
    digest = lambda k: None if k % 1000 == 7 else f"{k % 9000:064d}"
    rows = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k")).withColumn("record_id", F.when(F.col("k") % 500 != 3, F.concat(F.lit("r"), (F.col("k") % 30_000).cast("string")))).withColumn("source_hash", F.when(F.col("k") % 1000 != 7, F.format_string("%064d", F.col("k") % 9000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(old, ("24", "200k", "false"), strict=True):
            spark.conf.set(k, v)
        got = {r.k: (r.record_id, r.row_index, r.duplicate_source_id, r.exact_duplicate_of) for r in sinks.canonical_dataset(rows, ["k"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    ids = [None if k % 500 == 3 else f"r{k % 30_000}" for k in range(n)]
    copies = Counter(ids)
    new = [None if i is None else f"{i}::row-{k}" if copies[i] > 1 else i for k, i in enumerate(ids)]
    firsts: dict = {}
    want = {k: (new[k], k, ids[k] if copies[ids[k]] > 1 else None, new[f] if (f := firsts.setdefault(digest(k), k)) < k else None) for k in range(n)}
    assert got == want


def test_scorer_has_few_steps_of_python(spark, monkeypatch):
    """Each step has a worker of its own on every core: twenty of them in one stage filled an executor."""
    row = {"article": "a", "patient": "p", "item": "1", "task": "observations", "collection": "items", "label": "serum sodium", "evidence": [("s", "sodium of 130 mmol/L")], "text": "130", "unit": "mmol/L", "time_text": "day 1", "assertion": "present", "fields": {"flag": "low"}}
    names = [f.split(" ")[0] for f in S.ITEM.split(", ")]
    reference = spark.createDataFrame([[row.get(n) for n in names]], S.ITEM)
    predicted = spark.createDataFrame([[(row | {"label": "sodium level", "text": "130 mmol", "time_text": "on day 1"}).get(n) for n in names]], S.ITEM)
    frames, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: frames.append(df) or cut(df))
    steps = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython")
    matches = S.matched_items(reference, predicted)
    scores = S.attribute_scores(matches)
    assert steps(frames[0]) <= 8 and steps(scores) <= 4
    assert {(r.field, r.correct, r.total) for r in scores.collect() if r.field} == {("assertion", 1, 1), ("time", 1, 1), ("value", 1, 1), ("unit", 1, 1), ("flag", 1, 1)}


def test_matching_takes_groups_across_batches(spark):
    """Groups that lie over the ends of Arrow batches, and a null in their key."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        pairs = spark.range(60).selectExpr("nullif(id div 4, 3) AS g", "concat('l', id % 2) AS l", "concat('r', (id div 2) % 2) AS r", "CASE WHEN id % 4 IN (0, 3) THEN 1.0D ELSE 0.9D END AS weight")
        got = [tuple(r) for r in S.assigned(pairs, ("g",), "l", "r").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert Counter(got) == Counter((None if g == 3 else g, f"l{k}", f"r{k}", 1.0) for g in range(15) for k in range(2))


def test_estimates_stay_small_over_rounds(spark, monkeypatch):
    """A chain takes a round for each doubling; its estimated sizes once were numbers of millions of digits."""
    frames, checkpointed = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: frames.append(df) or checkpointed(df))
    node = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << 40))
    edges = spark.range(200).select(node(F.col("id")).alias("a"), node(F.col("id") + 1).alias("b"))
    out = graph.connected_components(edges).collect()
    least = min(r.node for r in out)
    assert len(out) == len({r.node for r in out}) == 201 and {r.component for r in out} == {least}
    bits = [f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for f in frames]
    assert len(bits) > 5 and max(bits) < 1000
