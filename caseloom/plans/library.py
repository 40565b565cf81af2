"""Queries that apply the library's operators to the driver's tables, each beside SQL that was written on its own and shares no text with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions import labels
from caseloom.operators import checks as C, nested as N, records as R, reports as P, scoring as S, selection as L, terms as V, timeline as X
from caseloom.sources import readers, sinks
from caseloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col
r9 = lambda x: F.round(x, 9)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scores


@query("""
WITH x AS (SELECT l.doc_id, d.lang, d.source, coalesce(d.n_chars >= 1000, false) AS p, l.quality = 1 AS q FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
g AS (SELECT 0 AS level, NULL AS name, * FROM x UNION ALL SELECT 1, lang, * FROM x UNION ALL SELECT 2, source, * FROM x),
n AS (SELECT level, name, sum(CASE WHEN p AND q THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p AND NOT q THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN q AND NOT p THEN 1 ELSE 0 END)::BIGINT AS fn FROM g GROUP BY level, name)
SELECT level, name, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision_, round(tp / nullif(tp + fn, 0), 9) AS recall_, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM n""")
def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a length rule against quality labels: of all, by language and by source; a label without its document counts as not predicted."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", "left")
    rows = rows.select("lang", "source", F.coalesce(c("n_chars") >= 1000, F.lit(False)).alias("p"), (c("quality") == 1).alias("q"))
    sums = P.leveled(rows, [(), ("lang",), ("source",)], [F.count_if(F.expr("p and q")).alias("tp"), F.count_if(F.expr("p and not q")).alias("fp"), F.count_if(F.expr("q and not p")).alias("fn")])
    scores = S.prf(c("tp"), c("fp"), c("fn"))
    return sums.select("level", F.when(c("level") == 1, c("lang")).when(c("level") == 2, c("source")).alias("name"), "tp", "fp", "fn", r9(scores["precision"]).alias("precision_"), r9(scores["recall"]).alias("recall_"), r9(scores["f1"]).alias("f1"))


@query("""
WITH x AS (SELECT d.lang, coalesce(d.n_chars >= 1000, false) AS p, l.quality = 1 AS q, l.doc_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id),
n AS (SELECT lang, count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (q AND NOT p) AS fn, count(*) FILTER (q) AS c FROM x GROUP BY lang),
s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM n)
SELECT (SELECT count(*) FROM n) AS groups, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 9) AS fbeta_micro, (SELECT round(avg(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 1)), 9) FROM n) AS fbeta_macro,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 1), 9) AS recall_ FROM s""")
def label_scores_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Micro and macro F2 over languages."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "left").withColumn("p", F.coalesce(c("n_chars") >= 1000, F.lit(False))).withColumn("q", c("quality") == 1)
    by = rows.groupBy("lang").agg(F.count_if(F.expr("p and q")).alias("tp"), F.count_if(F.expr("p and not q")).alias("fp"), F.count_if(F.expr("q and not p")).alias("fn"), F.lit(0).alias("correct"), F.lit(0).alias("total"))
    out = S.fbeta_summary(by)
    return out.crossJoin(by.agg(F.count("*").alias("groups"))).select("groups", *(r9(c(x)).alias(x) for x in ("fbeta_micro", "fbeta_macro")), r9(c("precision")).alias("precision_"), r9(c("recall")).alias("recall_"))


def _order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as items of their order: the part is the label, quoted in the line's segment; the sixth line and those without a number are for review only."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    lines = table(spark, folder, "lineitem").join(part, c("l_partkey") == c("p_partkey"))
    null = F.lit(None).cast("string")
    id_ = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    label = F.concat_ws(" ", F.lit("item"), id_, c("p_name"))
    return lines.select(
        c("l_orderkey").cast("string").alias("article"), F.lit("p1").alias("patient"), id_.alias("item"), F.when(c("l_linenumber") % 2 == 0, "observations").otherwise("conditions").alias("task"), F.lit("items").alias("collection"),
        label.alias("label"), null.alias("key"), F.array(F.struct(id_.alias("segment"), label.alias("quote"))).alias("evidence"), F.coalesce(c("l_linenumber") == 6, F.lit(True)).alias("review_only"), F.lit(False).alias("imaging"),
        c("l_quantity").alias("number"), null.alias("text"), F.lit("kg").alias("unit"), null.alias("comparator"), null.alias("time_text"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_iso"), F.lit("present").alias("assertion"), F.lit("index_patient").alias("subject"), null.alias("temporality"), F.create_map(F.lit("flag"), c("l_returnflag")).alias("fields"),
        c("l_partkey").alias("_part"),
    )


def _order_prediction(items: DataFrame) -> DataFrame:
    """Every fifth part is missed, every seventh is denied; ids are others and lines stand in no order."""
    return items.where("_part % 5 <> 0").withColumn("item", F.reverse("item")).withColumn("assertion", F.when(c("_part") % 7 == 0, "absent").otherwise("present"))


@query("""
WITH l AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'observations' ELSE 'conditions' END AS task, l_linenumber = 6 AS review, l_partkey % 5 <> 0 AS kept FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT task, count(*) FILTER (kept AND NOT review)::BIGINT AS tp, 0::BIGINT AS fp, count(*) FILTER (NOT kept AND NOT review)::BIGINT AS fn FROM l GROUP BY task),
a AS (SELECT task, tp, fp, fn FROM n UNION ALL SELECT NULL, sum(tp), sum(fp), sum(fn) FROM n),
f AS (SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM a)
SELECT task, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / nullif(tp + fp, 0), 9) AS precision_, round(tp / nullif(tp + fn, 0), 9) AS recall_, round(f1, 9) AS f1, CASE WHEN task IS NULL THEN round((SELECT avg(f1) FROM f WHERE task IS NOT NULL), 9) END AS macro_f1 FROM f""")
def item_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Matched items of orders: scores by task and of all, with the mean over tasks."""
    reference = _order_items(spark, folder)
    predicted = _order_prediction(reference)
    scores = S.task_scores(S.item_counts(reference, predicted, S.matched_items(reference, predicted)))
    return scores.select("task", *(c(f"scores.{x}").cast("bigint").alias(x) for x in ("tp", "fp", "fn")), r9(c("scores.precision")).alias("precision_"), r9(c("scores.recall")).alias("recall_"), r9(c("scores.f1")).alias("f1"), r9(c("macro_f1")).alias("macro_f1"))


@query("""
WITH l AS (SELECT l_partkey % 7 <> 0 AS sure FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 0 AND l_linenumber <> 6),
f AS (SELECT unnest(['assertion', 'subject', 'time', 'value', 'unit', 'comparator', 'category']) AS grp, unnest(['assertion', 'subject', 'time', 'value', 'unit', 'comparator', 'flag']) AS field),
n AS (SELECT grp, field, count(*) FILTER (grp <> 'assertion' OR sure) AS correct, count(*) AS total FROM l CROSS JOIN f GROUP BY grp, field),
a AS (SELECT * FROM n UNION ALL SELECT grp, NULL, correct, total FROM n UNION ALL SELECT NULL, NULL, sum(correct), sum(total) FROM n)
SELECT grp, field, correct::BIGINT AS correct, total::BIGINT AS total, round(correct / total, 9) AS accuracy FROM a""")
def attribute_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes of matched items: by field, by group and of all."""
    reference = _order_items(spark, folder)
    scores = S.attribute_scores(S.matched_items(reference, _order_prediction(reference)))
    return scores.select(c("group").alias("grp"), "field", c("correct").cast("bigint").alias("correct"), c("total").cast("bigint").alias("total"), r9(c("accuracy")).alias("accuracy"))


@query("""
WITH e AS (SELECT user_id % 20 AS s, event_type AS t, event_id FROM events), p AS (SELECT s, t, count(*) AS n FROM e WHERE event_id % 5 <> 0 GROUP BY s, t), r AS (SELECT s, t, count(*) AS n FROM e WHERE event_id % 7 <> 0 GROUP BY s, t),
m AS (SELECT coalesce(p.t, r.t) AS t, coalesce(p.n, 0) AS pn, coalesce(r.n, 0) AS rn FROM p FULL JOIN r ON p.s = r.s AND p.t = r.t),
x AS (SELECT t AS label, sum(least(pn, rn))::BIGINT AS tp, sum(pn - least(pn, rn))::BIGINT AS fp, sum(rn - least(pn, rn))::BIGINT AS fn FROM m GROUP BY t)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision_, round(tp / nullif(tp + fn, 0), 9) AS recall_, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM x""")
def edge_match(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset match of predicted and reference edges."""
    e = table(spark, folder, "events").select((c("user_id") % 20).alias("s"), c("event_type").alias("label"), "event_id")
    out = S.multiset_scores(e.where("event_id % 7 <> 0"), e.where("event_id % 5 <> 0"), ["s", "label"], ["label"])
    return out.select("label", *(c(f"scores.{x}").cast("bigint").alias(x) for x in ("tp", "fp", "fn")), r9(c("scores.precision")).alias("precision_"), r9(c("scores.recall")).alias("recall_"), r9(c("scores.f1")).alias("f1"))


@query("""
WITH e AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, role FROM conversations),
r AS (SELECT conv_id, turn AS a, nxt AS b FROM e WHERE nxt IS NOT NULL), p AS (SELECT conv_id, turn AS a, nxt AS b, turn % 3 = 2 AS wrong FROM e WHERE nxt IS NOT NULL AND turn % 4 <> 3)
SELECT true AS labelled, (SELECT count(*) FROM p WHERE NOT wrong) AS tp, (SELECT count(*) FROM p WHERE wrong) AS fp, (SELECT count(*) FROM r) - (SELECT count(*) FROM p WHERE NOT wrong) AS fn
UNION ALL SELECT false, (SELECT count(*) FROM p), 0, (SELECT count(*) FROM r) - (SELECT count(*) FROM p)""")
def edge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Turns' order as edges, some predicted backwards as 'after', some of a wrong kind, some missing; with and without relations."""
    from pyspark.sql import Window

    e = table(spark, folder, "conversations").select("conv_id", c("turn").cast("string").alias("a"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).cast("string").alias("b"), "turn")
    edges = e.where("b is not null")
    reference = edges.select("conv_id", "a", "b", F.lit("before").alias("relation"))
    kept = edges.where("turn % 4 <> 3")
    predicted = kept.select("conv_id", F.concat(F.lit("q"), "b").alias("a"), F.concat(F.lit("q"), "a").alias("b"), F.when(c("turn") % 3 == 2, "causes").otherwise("After").alias("relation"))
    events = e.select("conv_id", c("a").alias("ref"), F.concat(F.lit("q"), "a").alias("pred"))
    return S.edge_scores(reference, predicted, events, ["conv_id"]).groupBy("labelled").agg(*(F.sum(f"scores.{x}").cast("bigint").alias(x) for x in ("tp", "fp", "fn")))


@query("""
WITH r AS (SELECT l_orderkey, l_suppkey, max({'kind': l_returnflag, 'wanted': l_quantity > 25}) AS x FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_suppkey, max({'kind': CASE WHEN l_linenumber = 3 THEN 'Z' ELSE l_returnflag END, 'wanted': l_quantity > 20}) AS x FROM lineitem WHERE l_linenumber <> 5 GROUP BY ALL),
b AS (SELECT r.x.kind AS rk, r.x.wanted AS rw, p.x.kind AS pk, coalesce(p.x.wanted, false) AS pw FROM r LEFT JOIN p ON r.l_orderkey = p.l_orderkey AND r.l_suppkey = p.l_suppkey)
SELECT count(*) FILTER (rk = pk) AS correct, count(*) AS total, count(*) FILTER (rw AND pw) AS tp, count(*) FILTER (pw AND NOT rw) AS fp, count(*) FILTER (rw AND NOT pw) AS fn FROM b""")
def file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds and wanted flags of keyed rows against predictions that miss some."""
    lines = table(spark, folder, "lineitem")
    reference = lines.select("l_orderkey", "l_suppkey", c("l_returnflag").alias("kind"), (c("l_quantity") > 25).alias("wanted"))
    predicted = lines.where("l_linenumber <> 5").select("l_orderkey", "l_suppkey", F.when(c("l_linenumber") == 3, "Z").otherwise(c("l_returnflag")).alias("kind"), (c("l_quantity") > 20).alias("wanted"))
    return S.file_scores(reference, predicted, ["l_orderkey", "l_suppkey"]).select("kinds.correct", "kinds.total", "wanted.tp", "wanted.fp", "wanted.fn")


@query("""
WITH e AS (SELECT user_id, event_type, event_id FROM events), r AS (SELECT user_id, event_type, count(*) FILTER (event_id % 3 <> 0) AS n, count(*) FILTER (event_id % 3 = 0) AS v FROM e WHERE event_id % 4 <> 0 GROUP BY ALL), p AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE event_id % 5 <> 0 GROUP BY ALL),
b AS (SELECT coalesce(r.n, 0) AS rn, coalesce(r.v, 0) AS rv, coalesce(p.n, 0) AS pn FROM r FULL JOIN p ON r.user_id = p.user_id AND r.event_type = p.event_type), m AS (SELECT *, least(rn, pn) AS tp FROM b), t AS (SELECT *, least(pn - tp, rv) AS taken FROM m)
SELECT sum(tp)::BIGINT AS tp, sum(pn - tp - taken)::BIGINT AS fp, sum(rn - tp)::BIGINT AS fn, sum(taken)::BIGINT AS ignored FROM t""")
def series_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Points of users and types as multisets, those for review take predictions without counting."""
    e = table(spark, folder, "events")
    reference = e.where("event_id % 4 <> 0").select("user_id", "event_type", (c("event_id") % 3 == 0).alias("review_only"))
    out = S.series_scores(reference, e.where("event_id % 5 <> 0").select("user_id", "event_type"), ["user_id", "event_type"])
    return out.select(*(c(f"scores.{x}").cast("bigint").alias(x) for x in ("tp", "fp", "fn")), c("ignored").cast("bigint").alias("ignored"))


@query("""
WITH f AS (SELECT unnest(['cheap', 'heavy', 'returned']) AS flag), l AS (SELECT l_discount > 0.05 AS r1, l_discount > 0.06 AS p1, l_quantity > 40 AS r2, l_quantity > 35 AS p2, l_returnflag = 'R' AS r3, l_returnflag <> 'A' AS p3 FROM lineitem),
x AS (SELECT flag, CASE flag WHEN 'cheap' THEN r1 WHEN 'heavy' THEN r2 ELSE r3 END AS r, CASE flag WHEN 'cheap' THEN p1 WHEN 'heavy' THEN p2 ELSE p3 END AS p FROM l CROSS JOIN f)
SELECT flag, count(*) FILTER (r AND p) AS tp, count(*) FILTER (p AND NOT r) AS fp, count(*) FILTER (r AND NOT p) AS fn FROM x GROUP BY flag""")
def flag_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three flags' confusion matrices in one scan."""
    flags = {"cheap": (c("l_discount") > 0.05, c("l_discount") > 0.06), "heavy": (c("l_quantity") > 40, c("l_quantity") > 35), "returned": (c("l_returnflag") == "R", c("l_returnflag") != "A")}
    return S.flag_scores(table(spark, folder, "lineitem"), flags).select("flag", *(c(f"scores.{x}").cast("bigint").alias(x) for x in ("tp", "fp", "fn")))


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, max(l_extendedprice) AS e, max(l_tax) AS t FROM lineitem GROUP BY ALL), o AS (SELECT k, n, p, s, 'price' AS g, e > 30000 AS ok FROM l UNION ALL SELECT k, n, p, s, 'tax', t > 0.02 FROM l),
a AS (SELECT * FROM o WHERE k % 3 <> 0), b AS (SELECT k, n, p, s, g, CASE WHEN n = 1 THEN NOT ok ELSE ok END AS ok FROM o WHERE k % 4 <> 0),
j AS (SELECT coalesce(a.g, b.g) AS g, a.ok AS was, b.ok AS now FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n AND a.p = b.p AND a.s = b.s AND a.g = b.g),
t AS (SELECT count(*) FILTER (now IS NULL) // 2 AS lost, count(*) FILTER (was IS NULL) // 2 AS fresh, count(*) FILTER (was IS NOT NULL AND now IS NOT NULL) // 2 AS common FROM j)
SELECT g AS grp, count(*) FILTER (was AND now IS NOT NULL) AS previously_correct, count(*) FILTER (was AND NOT now) AS regressed, count(*) FILTER (was IS NULL AND now) AS new_correct, count(*) FILTER (was IS NULL) AS new_total,
  any_value(lost)::BIGINT AS lost_matches, any_value(fresh)::BIGINT AS new_matches, any_value(common)::BIGINT AS common_matches FROM j CROSS JOIN t GROUP BY g""")
def paired_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that two runs judged: what the second lost, broke and gained."""
    told = F.explode(F.array(F.struct(F.lit("price").alias("group"), (c("e") > 30000).alias("ok")), F.struct(F.lit("tax").alias("group"), (c("t") > 0.02).alias("ok"))))
    keys = ["k", "n", "p", "s"]
    lines = table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s")).agg(F.max("l_extendedprice").alias("e"), F.max("l_tax").alias("t"))
    o = lines.select(*keys, told.alias("x")).select(*keys, "x.group", F.lit("f").alias("field"), "x.ok")
    out = S.paired_fields(o.where("k % 3 <> 0"), o.where("k % 4 <> 0").withColumn("ok", F.when(c("n") == 1, ~c("ok")).otherwise(c("ok"))), keys)
    return out.withColumnRenamed("group", "grp")


@query("""
WITH a AS (SELECT event_type AS t, avg(value) AS v, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS t, avg(value) AS v, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT a.t AS event_type, CASE WHEN a.n < 5 OR b.n < 5 THEN 'inconclusive' WHEN b.v - a.v >= 0.5 - 1e-12 AND b.n - a.n >= -1000 - 1e-12 THEN 'promising_component' ELSE 'retain_control_and_review' END AS recommendation, b.v - a.v >= 0.5 - 1e-12 AS value_ok FROM a JOIN b ON a.t = b.t""")
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Two arms' metrics against the least change allowed."""
    e = table(spark, folder, "events")
    arm = lambda k, n: e.where(c("user_id") % 2 == k).groupBy("event_type").agg(F.avg("value").alias(f"{n}v"), F.count("*").alias(f"{n}n"))
    both = arm(0, "a").join(arm(1, "b"), "event_type")
    told = S.recommendation({"value": c("av"), "n": c("an").cast("double")}, {"value": c("bv"), "n": c("bn").cast("double")}, {"value": 0.5, "n": -1000.0}, (c("an") >= 5) & (c("bn") >= 5))
    return both.select("event_type", told["recommendation"].alias("recommendation"), told["checks"]["value"].alias("value_ok"))


# ---- duplicates, samples, reports


@query("""
SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies, CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN min(doc_id) OVER (PARTITION BY text) END AS exact_duplicate_of FROM documents""")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every record kept, later ones of equal text marked with the first one's id."""
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    first = rows.groupBy("source_hash").agg(F.min("doc_id").alias("f"), F.count("*").alias("copies"))
    return rows.join(first, "source_hash").select("doc_id", c("source_hash").alias("digest"), "copies", F.when(c("f") < c("doc_id"), c("f")).alias("exact_duplicate_of"))


@query("""
WITH x AS (SELECT doc_id, lang || '-' || (doc_id % 40) AS id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents WHERE lang IS NOT NULL),
y AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM x), z AS (SELECT *, CASE WHEN n > 1 THEN id || '::row-' || row_index ELSE id END AS record_id FROM y)
SELECT record_id, row_index, CASE WHEN n > 1 THEN id END AS duplicate_source_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY row_index) > 1 THEN first_value(record_id) OVER (PARTITION BY text ORDER BY row_index) END AS exact_duplicate_of FROM z""")
def canonical_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with unique processing ids in place of repeated ones, copies marked."""
    rows = table(spark, folder, "documents").where("lang is not null").select("doc_id", F.concat_ws("-", "lang", (c("doc_id") % 40).cast("string")).alias("record_id"), F.sha2("text", 256).alias("source_hash"))
    return sinks.canonical_dataset(rows, ["doc_id"]).select("record_id", "row_index", "duplicate_source_id", "exact_duplicate_of")


@query("""
SELECT lang, count(*) AS n, sum(n_chars) AS total, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean_chars,
percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS p95_nearest, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY n_chars), 6) AS p95_linear, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY n_chars), 6) AS median_chars FROM documents GROUP BY lang""")
def length_report(spark: SparkSession, folder: str) -> DataFrame:
    """Both conventions of the 95th percentile."""
    n, mean, median, near, most, total = P.stats("n_chars")
    linear = P.linear_stats("n_chars")
    out = table(spark, folder, "documents").groupBy("lang").agg(n, mean, median, near, most, total, linear[3].alias("linear"), linear[4])
    return out.select("lang", "n", "total", "least", "most", F.round("mean", 6).alias("mean_chars"), c("p95").alias("p95_nearest"), F.round("linear", 6).alias("p95_linear"), F.round("median", 6).alias("median_chars"))


@query("""
WITH x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-7:' || doc_id), doc_id) AS turn FROM documents WHERE lang IS NOT NULL)
SELECT lang, doc_id, row_number() OVER (ORDER BY turn, sha256('seed-7:' || lang), lang) AS pick FROM x QUALIFY pick <= 20""")
def stratified_hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty documents by turns over the languages."""
    rows = table(spark, folder, "documents").where("lang is not null").select("lang", "doc_id")
    return L.round_robin(rows, ["lang"], "doc_id", 20, "seed-7:")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY sha256('h:' || o_orderkey), o_orderkey) <= greatest(2, round_even(0.2 * (SELECT count(*) FROM orders), 0)) AS held FROM orders""")
def holdout(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the orders, by digest."""
    return L.holdout(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.2, 2, "h:")


@query("""
WITH x AS (SELECT c_custkey AS id, c_mktsegment AS family, c_nationkey AS stratum, round(c_acctbal / 1000, 3) AS score, c_custkey % 9 = 0 AS multiple, sha256('s:' || c_custkey) AS rank FROM customer)
SELECT (SELECT count(DISTINCT family) FROM x)::BIGINT AS families, least(15, 3 * (SELECT count(DISTINCT family) FROM x))::BIGINT AS seats""")
def seats(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen seats under the ceiling of three a family (counted; each seat depends on those before)."""
    rows = table(spark, folder, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("family"), c("c_nationkey").alias("stratum"), F.round(c("c_acctbal") / 1000, 3).alias("score"), (c("c_custkey") % 9 == 0).alias("multiple"))
    out = L.seats(rows, "id", "family", "stratum", "score", "multiple", 15, "s:", 3)
    return out.agg(F.count_distinct("family").alias("families"), F.count_distinct("seat").alias("seats"))


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as receipts: some without reasoning counts, devices or a patient count."""
    e = table(spark, folder, "events")
    u = c("user_id")
    return e.select(
        "event_id", "event_type", u, (c("event_id") % 50 + 1).cast("double").alias("wall_seconds"), F.when(u % 3 != 0, u % 4 + 1).alias("gpus"), (c("event_id") % 100).alias("prompt_tokens"), F.when((c("event_type") != "error") | (u % 10 != 0), c("event_id") % 70).alias("completion_tokens"),
        (c("event_id") % 70 - F.when(c("event_type") == "view", 0).otherwise(c("event_id") % 70 % 5)).alias("reasoning_tokens"), (c("event_id") % 3).alias("model_calls"), (c("event_id") % 4 != 0).alias("has_prediction"), F.when(u % 7 != 0, c("event_id") % 2 == 0).alias("all_valid"), F.when(u % 6 != 0, c("event_id") % 3).alias("patients"),
        F.when(u % 11 != 0, F.when(u % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))).alias("errors"),
    )


_RECEIPTS = """r AS (SELECT event_id, event_type, user_id, (event_id % 50 + 1)::DOUBLE AS wall, CASE WHEN user_id % 3 <> 0 THEN user_id % 4 + 1 END AS gpus, event_id % 100 AS p, CASE WHEN event_type <> 'error' OR user_id % 10 <> 0 THEN event_id % 70 END AS o,
  event_id % 70 - CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 70 % 5 END AS g, event_id % 4 <> 0 AS has, CASE WHEN user_id % 7 <> 0 THEN event_id % 2 = 0 END AS valid, CASE WHEN user_id % 6 <> 0 THEN event_id % 3 END AS patients,
  CASE WHEN user_id % 11 <> 0 THEN CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END END AS errors FROM events)"""


@query(f"""
WITH {_RECEIPTS}, s AS (SELECT event_type, count(*) AS n, sum(wall) AS s, sum(wall * coalesce(gpus, 1)) AS gs, sum(p) AS p, count(o) = count(*) AS whole, sum(o) AS o, sum(g) AS g, bool_and(coalesce(g BETWEEN 0 AND o, false)) AS inside, count(*) FILTER (has) AS np, count(*) FILTER (has AND valid) AS nv, count(*) - count(o) AS missing FROM r GROUP BY event_type)
SELECT event_type, n AS documents, np AS prediction_documents, nv AS valid_documents, s AS seconds, gs AS gpu_seconds, CASE WHEN whole THEN o END::BIGINT AS completion_tokens, CASE WHEN whole AND inside THEN o - g END::BIGINT AS answer_tokens, missing AS missing_completion,
  round(CASE WHEN whole THEN o / s END, 9) AS output_per_second, round(n * 3600 / s, 9) AS documents_per_hour, round(np * 3600 / s, 9) AS predictions_per_hour, round(n * 3600 / gs, 9) AS documents_per_gpu_hour FROM s""")
def throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by kind from receipts with gaps."""
    out = P.throughput(_receipts(spark, folder), ["event_type"])
    return out.select("event_type", "documents", "prediction_documents", "valid_documents", "seconds", "gpu_seconds", "completion_tokens", "answer_tokens", "missing_completion", *(r9(c(x)).alias(x) for x in ("output_per_second", "documents_per_hour", "predictions_per_hour", "documents_per_gpu_hour")))


@query(f"""
WITH {_RECEIPTS} SELECT event_type, count(*) FILTER (has) AS prediction_artifacts, count(*) FILTER (has AND patients > 0) AS nonempty, count(*) FILTER (has AND patients = 0) AS empty_, count(*) FILTER (patients IS NULL) AS patients_unavailable, count(*) FILTER (valid) AS schema_valid,
  count(*) FILTER (has AND patients > 0 AND valid AND errors = 0) AS nonempty_valid, count(*) FILTER (errors IS NULL OR patients IS NULL) AS validity_unavailable FROM r GROUP BY event_type""")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """What receipts have, lack and fail."""
    return P.quality(_receipts(spark, folder), ["event_type"]).withColumnRenamed("empty", "empty_")


@query("""
WITH x AS (SELECT 'task' || (event_id % 3) AS task, event_id % 5 AS calls, CASE WHEN event_id % 3 <> 1 OR user_id % 50 <> 0 THEN event_id % 9 END AS tokens FROM events)
SELECT task, sum(calls)::BIGINT AS calls, CASE WHEN count(tokens) = count(*) THEN sum(tokens) END::BIGINT AS tokens FROM x GROUP BY task""")
def task_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage by task from a map column; a missing token count makes the task's total unknown."""
    e = table(spark, folder, "events")
    tokens = F.when((c("event_id") % 3 != 1) | (c("user_id") % 50 != 0), c("event_id") % 9)
    rows = e.select(F.create_map(F.concat(F.lit("task"), (c("event_id") % 3).cast("string")), F.struct((c("event_id") % 5).alias("calls"), tokens.alias("tokens"))).alias("usage"))
    return P.task_usage(rows, "usage", ["calls"], ["tokens"])


@query("""
WITH w AS (SELECT count(*) AS n, sum(s_acctbal)::DOUBLE AS s, sum(s_acctbal * CASE WHEN s_nationkey % 2 = 0 THEN 4 ELSE 1 END)::DOUBLE AS g FROM supplier WHERE s_acctbal > 0), d AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS v FROM orders)
SELECT w.n AS workers, 0 AS missing_receipts, round(s, 2) AS seconds, round(g, 2) AS gpu_seconds, d.n AS documents, round(d.n / s, 9) AS documents_per_second, round(p / s, 9) AS predictions_per_second, round(v / s, 9) AS valid_per_second, round(d.n * 3600 / g, 9) AS documents_per_gpu_hour FROM w CROSS JOIN d""")
def worker_goodput(spark: SparkSession, folder: str) -> DataFrame:
    """Completed work per worker time."""
    workers = table(spark, folder, "supplier").where("s_acctbal > 0").select(c("s_acctbal").alias("worker_seconds"), F.when(c("s_nationkey") % 2 == 0, 4).alias("gpus"))
    done = table(spark, folder, "orders").select((c("o_orderstatus") != "P").alias("has_prediction"), (c("o_orderstatus") == "F").alias("all_valid"))
    out = P.worker_goodput(done, workers)
    return out.select("workers", "missing_receipts", F.round("seconds", 2).alias("seconds"), F.round("gpu_seconds", 2).alias("gpu_seconds"), "documents", *(r9(c(x)).alias(x) for x in ("documents_per_second", "predictions_per_second", "valid_per_second", "documents_per_gpu_hour")))


@query("""
WITH x AS (SELECT user_id, event_id, value AS a, value * 2 - CASE WHEN event_id % 13 = 0 THEN value ELSE 0 END AS d, ts FROM events), y AS (SELECT *, row_number() OVER w AS k, d - lag(d) OVER w AS dd, a - lag(a) OVER w AS da FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, CASE WHEN dd >= 0 AND da >= 0 AND da <= dd THEN dd END AS dd, CASE WHEN dd >= 0 AND da >= 0 AND da <= dd THEN da END AS da FROM y WHERE k > 1)
SELECT user_id, count(dd) AS measured, count(*) AS expected, round(sum(dd), 6) AS drafted_known, round(CASE WHEN count(dd) = count(*) THEN sum(da) END, 6) AS accepted FROM s GROUP BY user_id""")
def counter_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Increases of two counters by user; steps after a fall are unavailable, and so are sums over them."""
    e = table(spark, folder, "events")
    rows = e.select("user_id", "ts", "event_id", (c("value") * 2 - F.when(c("event_id") % 13 == 0, c("value")).otherwise(0)).alias("drafted"), c("value").alias("accepted"))
    steps = P.counter_deltas(rows, ["user_id"], ["ts", "event_id"], "drafted", "accepted")
    known = steps.groupBy("user_id").agg(F.round(F.sum("drafted"), 6).alias("drafted_known"))
    return P.acceptance(steps, ["user_id"]).select("user_id", "measured", "expected", F.round("accepted", 6).alias("accepted")).join(known, "user_id")


@query("""
WITH x AS (SELECT user_id AS id, event_type AS arm, sum(value) AS s FROM events GROUP BY ALL), b AS (SELECT id, s FROM x WHERE arm = 'view')
SELECT arm, count(*) AS articles, round(sum(b.s), 6) AS baseline_seconds, round(sum(x.s), 6) AS candidate_seconds, round(CASE WHEN sum(x.s) > 0 THEN sum(b.s) / sum(x.s) END, 6) AS speedup FROM x JOIN b ON x.id = b.id WHERE arm <> 'view' GROUP BY arm""")
def paired_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Each kind of event against views, on the users that have both."""
    rows = table(spark, folder, "events").groupBy(c("user_id").alias("id"), c("event_type").alias("arm")).agg(F.sum("value").alias("s"))
    out = P.paired(rows, "arm", "id", "view", "s")
    return out.select("arm", "articles", *(F.round(x, 6).alias(x) for x in ("baseline_seconds", "candidate_seconds", "speedup")))


@query("""
SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS orders_, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS revenue, CASE WHEN grouping(c_mktsegment) = 1 AND grouping(c_nationkey) = 1 THEN 0 WHEN grouping(c_nationkey) = 1 THEN 1 WHEN grouping(c_mktsegment) = 1 THEN 2 ELSE 3 END AS level
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((), (c_mktsegment), (c_nationkey), (c_mktsegment, c_nationkey))""")
def cohort_report(spark: SparkSession, folder: str) -> DataFrame:
    """Global, split and id figures in one scan."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), c("o_custkey") == c("c_custkey")).select(c("c_mktsegment").alias("segment"), c("c_nationkey").alias("nation"), "c_custkey", "o_totalprice")
    return P.leveled(rows, [(), ("segment",), ("nation",), ("segment", "nation")], [F.count("*").alias("orders_"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("revenue")])


@query("""
SELECT o_orderpriority AS task, count(*) AS calls, count(*) FILTER (o_orderstatus = 'F') AS done, sum(CASE WHEN o_orderkey % 97 = 0 AND o_orderpriority LIKE '1%' THEN NULL ELSE o_orderkey % 10 END)::BIGINT AS known, count(*) FILTER (o_orderkey % 97 = 0 AND o_orderpriority LIKE '1%') = 0 AS whole FROM orders GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*) FILTER (o_orderstatus = 'F'), sum(CASE WHEN o_orderkey % 97 = 0 AND o_orderpriority LIKE '1%' THEN NULL ELSE o_orderkey % 10 END)::BIGINT, count(*) FILTER (o_orderkey % 97 = 0 AND o_orderpriority LIKE '1%') = 0 FROM orders""")
def call_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by task and of all, with their statuses and token sums that a gap makes unknown."""
    o = table(spark, folder, "orders")
    gap = (c("o_orderkey") % 97 == 0) & c("o_orderpriority").like("1%")
    rows = o.select(c("o_orderpriority").alias("task"), c("o_orderstatus").alias("status"), F.when(~gap, c("o_orderkey") % 10).alias("tokens"), F.coalesce(F.when(~gap, c("o_orderkey") % 10), F.lit(0)).alias("known"))
    out = P.ledger_metrics(rows, "task", "status", ["tokens", "known"])
    return out.select("task", "calls", F.coalesce(c("statuses")["F"], F.lit(0)).alias("done"), c("known").cast("bigint").alias("known"), c("tokens").isNotNull().alias("whole"))


@query("""
WITH x AS (SELECT user_id, arg_max({'s': CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END}, (ts, event_id)) AS l, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id)
SELECT count(*) AS ids, count(*) FILTER (done) AS done, count(*) FILTER (NOT done AND l.s = 'failed') AS failed, count(*) FILTER (NOT done AND l.s = 'running') AS running FROM x""")
def progress(spark: SparkSession, folder: str) -> DataFrame:
    """How far each user's attempts came."""
    status = F.when(c("event_type") == "purchase", "done").when(c("event_type") == "error", "failed").otherwise("running")
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", status.alias("status"), c("event_type").alias("error"))
    return P.progress(rows, "user_id", ["ts", "event_id"], "status", "error")


@query("""
WITH x AS (SELECT event_type AS task, user_id AS article, event_id % 17 = 0 AS f FROM events), g AS (SELECT 'task' AS kind, task AS name, f FROM x UNION ALL SELECT 'article', article::VARCHAR, f FROM x)
SELECT kind, name, count(*) FILTER (f) AS failed, count(*) AS total FROM g GROUP BY kind, name HAVING count(*) FILTER (f) > 0""")
def failure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by task and by article in one scan."""
    return P.failures(table(spark, folder, "events"), "user_id", "event_type", c("event_id") % 17 == 0)


@query("""
SELECT event_type AS a, cast(user_id % 4 AS bigint) AS b, count(*) AS n, (grouping(event_type) * 2 + grouping(user_id % 4))::INTEGER AS level FROM events GROUP BY CUBE (event_type, user_id % 4)""")
def cross_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by two columns, by each and of all."""
    return P.cross_counts(table(spark, folder, "events").select(c("event_type").alias("a"), (c("user_id") % 4).alias("b")), "a", "b")


@query("""
WITH f AS (SELECT unnest(['text', 'lang', 'source']) AS field), x AS (SELECT field, CASE field WHEN 'text' THEN text WHEN 'lang' THEN lang ELSE source END AS v FROM documents CROSS JOIN f)
SELECT field, count(*) FILTER (lower(trim(v, ' ')) NOT IN ('', 'unknown', 'not_documented', 'unspecified')) AS populated, count(*) FILTER (coalesce(lower(trim(v, ' ')) IN ('', 'unknown', 'not_documented', 'unspecified'), true)) AS empty_ FROM x GROUP BY field""")
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents tell something in each field."""
    return P.field_coverage(table(spark, folder, "documents"), ["text", "lang", "source"]).withColumnRenamed("empty", "empty_")


@query("""
WITH e AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(e.id, p.id) AS id, coalesce(n, 0) AS provided, CASE WHEN e.id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'once' END AS state FROM e FULL JOIN p ON e.id = p.id""")
def coverage_states(spark: SparkSession, folder: str) -> DataFrame:
    """Expected orders against the lines that name them."""
    expected = table(spark, folder, "orders").where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("id"))
    return P.coverage(expected, table(spark, folder, "lineitem").where("l_orderkey % 5 <> 0").select(c("l_orderkey").alias("id")), "id").drop("expected")


@query("""
WITH x AS (SELECT o_custkey AS patient, o_orderstatus AS section, count(*) AS n FROM orders GROUP BY ALL) SELECT section, sum(n)::BIGINT AS facts, count(*) AS patients FROM x GROUP BY section""")
def section_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each section, and patients that have any."""
    return P.section_counts(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus").select(c("o_orderstatus").alias("section"), "facts", "patients")


# ---- terms


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM w GROUP BY term""")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and documents of every term."""
    return V.vocabulary(table(spark, folder, "documents"), "doc_id", "text")


@query("""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), w AS (SELECT term, round(1000000 * ln(1 + (SELECT count(*) FROM documents) / (1 + df)))::BIGINT AS idf FROM f),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), s AS (SELECT item_id, doc_id, sum(idf)::BIGINT AS score, count(*) AS shared FROM b JOIN w USING (term) JOIN t USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score, shared, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS place FROM s QUALIFY place <= 5""")
def idf_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """For each benchmark item the five documents of highest weight of common words; every word counts."""
    return V.shortlist(table(spark, folder, "benchmark"), table(spark, folder, "documents"), "item_id", "doc_id", "text", 5)


# ---- timelines


@query("""
WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
x AS (SELECT a.user_id, a.p AS a, b.p AS b, 4 AS r, b.p AS turn FROM o a JOIN o b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 2
  UNION ALL SELECT user_id, p, lead(p) OVER (PARTITION BY user_id, event_type ORDER BY p), 2, lead(p) OVER (PARTITION BY user_id, event_type ORDER BY p) FROM o),
u AS (SELECT user_id, a, b, min((r, turn)) AS f, list_sort(list(DISTINCT r)) AS rs FROM x WHERE b IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, a, b) AS k FROM u)
SELECT k.user_id, l.event_id AS left_id, r.event_id AS right_id, list_aggregate(list_transform(rs, lambda v: CASE v WHEN 2 THEN 'shared_anchor' ELSE 'neighbour' END), 'string_agg', '+') AS reasons FROM k JOIN o l ON k.user_id = l.user_id AND k.a = l.p JOIN o r ON k.user_id = r.user_id AND k.b = r.p WHERE k <= 32 * l.n""")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the next two of its user and the next of its type, within 32 pairs an event."""
    e = table(spark, folder, "events")
    pairs = X.candidate_pairs(e, ["user_id"], "event_id", ["ts"], anchors=F.array("event_type"), neighbors=2)
    return pairs.select("user_id", c("left").alias("left_id"), c("right").alias("right_id"), F.array_join("reasons", "+").alias("reasons"))


@query("""
WITH o AS (SELECT user_id, event_id, event_type, cast(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT user_id, d, min(p) AS a FROM o GROUP BY ALL), x AS (SELECT a.user_id, a.p AS a, b.p AS b FROM o a JOIN o b ON a.user_id = b.user_id AND b.p - a.p = 1
  UNION SELECT user_id, least(a, lead(a) OVER w), greatest(a, lead(a) OVER w) FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d)),
m AS (SELECT user_id, count(*) AS c FROM x WHERE b IS NOT NULL AND a <> b GROUP BY user_id)
SELECT o.user_id, any_value(n) AS n_events, any_value(n * (n - 1) // 2) AS total_pairs, coalesce(any_value(c), 0) AS candidate_pairs, any_value(n * (n - 1) // 2) - coalesce(any_value(c), 0) AS unassessed_pairs FROM o LEFT JOIN m ON o.user_id = m.user_id GROUP BY o.user_id""")
def omitted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs of a user's events stay undecided when neighbours and dates alone propose."""
    e = table(spark, folder, "events").withColumn("day_", F.to_date("ts"))
    return X.omitted_pairs(e, X.candidate_pairs(e, ["user_id"], "event_id", ["ts"], date="day_", neighbors=1), ["user_id"])


@query("""
SELECT a.conv_id, a.turn AS before_turn, b.turn AS after_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def order_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Before-pairs of each conversation: all that the turns' successor edges reach."""
    from pyspark.sql import Window

    t = table(spark, folder, "conversations").select("conv_id", c("turn").alias("a"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return X.closure(t, ["conv_id"]).select("conv_id", c("a").alias("before_turn"), c("b").alias("after_turn"))


@query("""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
SELECT conv_id, turn, (k // 2)::INTEGER AS layer FROM t""")
def relative_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in pairs of the same time, one pair before the next: each pair's layer."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, folder, "conversations").select("conv_id", "turn", (c("conv_id") * 10_000 + c("turn")).alias("id"), (F.row_number().over(own) - 1).alias("k"))
    nxt = t.withColumn("b", F.lead("id").over(own)).where("b is not null")
    edges = nxt.select("conv_id", F.when(c("k") % 2 == 0, c("id")).otherwise(c("b")).alias("a"), F.when(c("k") % 2 == 0, c("b")).otherwise(c("id")).alias("b"), F.when(c("k") % 2 == 0, "same_time").otherwise("after").alias("relation"))
    events, _ = X.relative_order(t.select("conv_id", "id"), edges, ["conv_id"])
    return events.join(t.select("id", "turn"), "id").select("conv_id", "turn", "layer")


@query("""
WITH t AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, turn AS edge FROM t WHERE conv_id % 3 = 0 AND n > 1""")
def conflicting_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every third conversation's last turn is said to come before its first: all its edges conflict."""
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, folder, "conversations").select("conv_id", "turn", F.lead("turn").over(own).alias("b"), F.first("turn").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    edges = t.select("conv_id", c("turn").alias("edge"), c("turn").alias("a"), F.when(c("b").isNotNull(), c("b")).when(c("conv_id") % 3 == 0, c("first")).alias("b"), F.lit("before").alias("relation")).where("b is not null and a <> b")
    return X.conflicting_edges(edges, ["conv_id"])


@query("""
WITH d AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS d FROM events WHERE event_type = 'click'), s AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY user_id ORDER BY d) = 1 THEN 0 ELSE 1 END AS new FROM d), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY d) AS g FROM s)
SELECT user_id, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(*) AS days_ FROM g GROUP BY user_id, g""")
def integer_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of consecutive days with a click of a user."""
    rows = table(spark, folder, "events").where("event_type = 'click'").select("user_id", F.unix_date(F.to_date("ts")).alias("n"))
    day = lambda x: F.date_format(F.date_from_unix_date(x), "yyyy-MM-dd")
    return L.integer_runs(rows, ["user_id"], "n").select("user_id", day("first").alias("first_day"), day("last").alias("last_day"), c("length").alias("days_"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id""")
def latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each user, and their first purchase in time."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    first = L.first_done(e, "user_id", ["ts", "event_id"], c("event_type") == "purchase").select("user_id", c("event_id").alias("first_purchase"))
    return L.newest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id").join(first, "user_id", "left")


@query("""
WITH x AS (SELECT event_id, user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY f) AS k, event_id = f AS is_first FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events))
SELECT event_id, 'e' || k AS canonical, is_first FROM x""")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Events of equal content share the name of the first of their user."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return X.first_seen(e, ["event_type"], ["event_id"], ["user_id"]).select("event_id", "canonical", "is_first")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 = 0 THEN 'unknown_or_wrong_patient_fact' WHEN l_returnflag = 'R' THEN 'unresolved_or_other_subject_fact' WHEN l_tax = 0 THEN 'missing_fact_source_evidence' WHEN l_discount = 0 THEN 'invalid_fact_source_evidence' END AS reason FROM lineitem)
SELECT l_orderkey, l_linenumber, reason, CASE WHEN reason IS NULL THEN 'f' || row_number() OVER (PARTITION BY l_orderkey, reason IS NULL ORDER BY l_linenumber) END AS alias FROM f""")
def fact_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as facts: accepted ones get aliases, others their reason."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_tax", "l_discount")
    owner = F.when(c("l_suppkey") % 10 != 0, c("l_orderkey"))
    out = X.ledger(lines, "l_orderkey", "l_linenumber", owner, F.when(c("l_returnflag") == "R", "family").otherwise("index_patient"), F.when(c("l_tax") != 0, c("l_discount") != 0))
    return out.select("l_orderkey", "l_linenumber", "reason", "alias")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0), d AS (SELECT o_custkey, o_orderkey, o_totalprice > 100000 AS sound FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT *, bool_and(sound) OVER (PARTITION BY o_custkey) AS whole FROM d)
SELECT g.o_orderkey, CASE WHEN NOT whole THEN 'refused' WHEN s.o_orderkey IS NOT NULL THEN 'known' ELSE 'added' END AS status FROM g LEFT JOIN s ON g.o_custkey = s.o_custkey AND g.o_orderkey = s.o_orderkey""")
def ledger_delta(spark: SparkSession, folder: str) -> DataFrame:
    """A delta of orders to a ledger of them, whole or not at all for each customer."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    _, told = X.applied_delta(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderkey", c("o_totalprice") > 100000, False)
    return told.select("o_orderkey", "status")


@query("""
WITH x AS (SELECT o_custkey AS k, o_orderpriority AS name, o_orderstatus AS action, extract(year FROM o_orderdate)::BIGINT AS y FROM orders), g AS (SELECT k, name, min(action) <> max(action) OR min(y) <> max(y) AS d FROM x GROUP BY ALL) SELECT k, bool_or(d) AS distinct_ FROM g GROUP BY k""")
def distinct_administrations(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a customer has orders of one priority that differ in status or year."""
    rows = table(spark, folder, "orders").select(c("o_custkey").alias("k"), c("o_orderpriority").alias("name"), c("o_orderstatus").alias("action"), F.year("o_orderdate").alias("y"))
    return X.distinct_administrations(rows, ["k"], "name", ["action", "y"]).withColumnRenamed("distinct", "distinct_")


# ---- batches, windows, facets


@query("""
WITH RECURSIVE x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, l_quantity AS s, l_returnflag = 'R' AS f FROM lineitem),
b AS (SELECT k, p, s, f, 1 AS batch, 1 AS n, s AS t FROM x WHERE p = 1 UNION ALL SELECT x.k, x.p, x.s, x.f, CASE WHEN b.n >= CASE WHEN x.f THEN 2 ELSE 3 END OR b.t + x.s > 60 OR b.f <> x.f THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= CASE WHEN x.f THEN 2 ELSE 3 END OR b.t + x.s > 60 OR b.f <> x.f THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= CASE WHEN x.f THEN 2 ELSE 3 END OR b.t + x.s > 60 OR b.f <> x.f THEN x.s ELSE b.t + x.s END FROM b JOIN x ON x.k = b.k AND x.p = b.p + 1)
SELECT k AS l_orderkey, max(batch)::BIGINT AS batches, sum(batch * p)::BIGINT AS checksum FROM b GROUP BY k""")
def line_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring lines of an order in batches bounded by rows and by size, cut where the flag changes."""
    from pyspark.sql import Window

    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (c("l_returnflag") == "R").alias("f"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    out = X.batches(lines, ["l_orderkey"], order, "l_quantity", "f", 3, 2, 60)
    out = out.withColumn("p", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    return out.groupBy("l_orderkey").agg(F.max("batch").cast("bigint").alias("batches"), F.sum(c("batch") * c("p")).alias("checksum"))


@query("""
SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 12 AS chunk FROM documents""")
def chunked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a language by twelves."""
    return L.chunked(table(spark, folder, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 12).select("doc_id", c("chunk").cast("bigint").alias("chunk"))


@query("""
WITH x AS (SELECT conv_id, turn, role = 'assistant' AND turn % 4 = 1 AS hit FROM conversations), y AS (SELECT *, max(hit::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(hit::INT) OVER (PARTITION BY conv_id) AS any_ FROM x) SELECT conv_id, turn FROM y WHERE near = 1 OR any_ = 0""")
def around_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Turns that are hit, their neighbours, and conversations without any hit whole."""
    t = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return L.around(t, ["conv_id"], ["turn"], (c("role") == "assistant") & (c("turn") % 4 == 1)).select("conv_id", "turn")


@query("""
SELECT 'segment' AS facet, c_mktsegment AS value_, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' GROUP BY 2""")
def facets(spark: SparkSession, folder: str) -> DataFrame:
    """Facet counts under all filters but the facet's own, in one scan."""
    rows = table(spark, folder, "customer").where("c_acctbal > 0")
    return L.facet_counts(rows, {"segment": c("c_mktsegment") == "BUILDING", "nation": c("c_nationkey") < 10}, {"segment": c("c_mktsegment"), "nation": c("c_nationkey")}).withColumnRenamed("value", "value_")


@query("""
SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND contains(lower(c_name), '7')""")
def cohort_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of some segments, in funds, whose name has a term."""
    return L.matching(table(spark, folder, "customer"), {"segment": (c("c_mktsegment"), ("BUILDING", "MACHINERY"))}, c("c_acctbal") > 0, ("7",), F.array("c_name")).select("c_custkey")


@query("""
WITH x AS (SELECT o_custkey, o_orderkey, count(*) OVER w AS n, sum(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT o_custkey, o_orderkey FROM x WHERE n <= 4 AND s <= 500000""")
def capped_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer while their number and value stay within caps (a bounded acquisition)."""
    return L.running_cap(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 4, 500_000.0).select("o_custkey", "o_orderkey")


# ---- checks and nested values


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.08 THEN 'discount_high' END, CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 'early_return' END, CASE WHEN l_tax = 0 THEN 'tax_zero' END, CASE WHEN l_quantity >= 45 THEN 'heavy' END], lambda v: v IS NOT NULL) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(b, ',') AS broken, CASE WHEN len(b) = 0 THEN 'accept' WHEN list_contains(b, 'early_return') OR list_contains(b, 'heavy') THEN 'quarantine' ELSE 'review' END AS route FROM x""")
def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the constraints that they break, and where they go."""
    rules = {"discount_high": c("l_discount") > 0.08, "early_return": (c("l_returnflag") == "R") & (c("l_quantity") < 5), "tax_zero": c("l_tax") == 0, "heavy": c("l_quantity") >= 45}
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_quantity", "l_tax")
    return C.routed(rows, rules, ("early_return", "heavy")).select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("broken"), "route")


@query("""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day_, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '+') AS statuses FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1""")
def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders of one day whose statuses differ."""
    rows = table(spark, folder, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_"), "o_orderstatus")
    return C.conflicts(rows, ["o_custkey", "day_"], "o_orderstatus").select("o_custkey", "day_", F.array_join("values", "+").alias("statuses"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def missing_references(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose order isn't among the settled ones."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return C.missing_references(lines, ["l_orderkey"], table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("l_orderkey")))


@query("""
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), d AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT coalesce(a.user_id, d.user_id) AS user_id, coalesce(a.event_type, d.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS state FROM a FULL JOIN d ON a.user_id = d.user_id AND a.event_type = d.event_type WHERE a.user_id IS NULL OR n IS NULL OR n > 1""")
def exact_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that aren't decided exactly once."""
    e = table(spark, folder, "events")
    return C.exact_cover(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"])


@query("""
WITH q AS (SELECT d.doc_id, substr(d.text, 1 + (d.doc_id % 7)::INT, 30) AS quote, CASE WHEN d.doc_id % 3 = 0 THEN 'nowhere' ELSE 's' || (d.doc_id % 2) END AS seg, d.text FROM documents d WHERE length(d.text) > 40)
SELECT doc_id, CASE WHEN seg = 's0' THEN contains(text, quote) WHEN seg = 's1' THEN contains(upper(text), quote) ELSE contains(text, quote) OR contains(upper(text), quote) END AS literal FROM q""")
def literal_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document's quote stands in the segment it names: the text, or its capitals; any of both for a name that isn't there."""
    d = table(spark, folder, "documents").where("length(text) > 40").select("doc_id", "text")
    both = F.explode(F.array(F.struct(F.lit("s0").alias("segment"), c("text").alias("t")), F.struct(F.lit("s1").alias("segment"), F.upper("text").alias("t"))))
    segments = d.select("doc_id", both.alias("x")).select("doc_id", "x.segment", F.lit(None).cast("string").alias("heading"), c("x.t").alias("text"))
    quote = F.substr(c("text"), (c("doc_id") % 7 + 1).cast("int"), F.lit(30))
    facts = d.select("doc_id", F.lit(1).alias("fact"), F.array(F.struct(F.when(c("doc_id") % 3 == 0, "nowhere").otherwise(F.concat(F.lit("s"), (c("doc_id") % 2).cast("string"))).alias("segment"), quote.alias("quote"))).alias("evidence"))
    return C.literal_evidence(facts, segments, "doc_id", "fact", "evidence").select("doc_id", "literal")


@query("""
WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'non_clinical' WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN 'sampled' ELSE 'reviewed' END AS basis FROM lineitem), g AS (SELECT l_orderkey, bool_and(basis IS NOT NULL) AS whole, list(DISTINCT basis) AS b FROM f GROUP BY 1)
SELECT l_orderkey, CASE WHEN whole THEN array_to_string(list_filter(['reviewed', 'sampled', 'non_clinical'], lambda v: list_contains(b, v)), '+') END AS satisfied_by FROM g""")
def file_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The bases that satisfy an order's lines, in fixed order, if each has one."""
    basis = F.when(c("l_linenumber") == 1, "non_clinical").when(c("l_returnflag") == "A", "sampled").when(c("l_returnflag") == "N", "reviewed")
    return C.gate(table(spark, folder, "lineitem").select("l_orderkey", basis.alias("basis")), "l_orderkey", "basis", ["reviewed", "sampled", "non_clinical"])


@query("""
SELECT event_id, sha256('{"type":"' || event_type || '","user":' || user_id || '}') AS digest FROM events""")
def canonical_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that don't depend on the order of keys or blanks: of JSON written in another order, by the general function."""
    text = F.concat(F.lit('{ "user" : '), c("user_id").cast("string"), F.lit(', "type": "'), "event_type", F.lit('"}'))
    return table(spark, folder, "events").select("event_id", labels.json_digest(text).alias("digest"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, sha1(unhex('NAMESPACE') || encode('["line","' || l_orderkey || '","' || l_linenumber || '"]')) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + ('0x' || h[17:17])::INT % 4, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""".replace("NAMESPACE", labels.NAMESPACE.hex))
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Name-based ids of order lines."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", labels.stable_id(F.lit("line"), c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("id"))


@query("""
WITH x AS (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events)
SELECT event_id, '/' || k AS pointer, 'a' || row_number() OVER (PARTITION BY event_id ORDER BY k) AS attribute FROM x""")
def attribute_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar of the semi-structured column with its pointer and number."""
    return N.leaves(table(spark, folder, "events"), ["event_id"], "props").select("event_id", "pointer", "attribute")


@query("""
WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, l_quantity, l_tax, l_linenumber FROM lineitem)
SELECT l_orderkey, p::INTEGER AS pos, 'line ' || l_linenumber AS name, 1 AS column_, 'quantity' AS time, printf('%d', l_quantity::BIGINT) AS magnitude FROM h WHERE p > 1""")
def table_points(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines written as table rows between bars, read back as points of series; the first segment is the header."""
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.row_number().over(own).alias("pos"), "l_linenumber", "l_quantity", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    row = F.concat(F.lit("line "), c("l_linenumber").cast("string"), F.lit(" | "), F.format_string("%d", c("l_quantity").cast("bigint")), F.lit(" | see 1-9"))
    segments = lines.select(c("l_orderkey").alias("article"), F.lit("t").alias("table_id"), "pos", F.when(c("pos") == 1, F.lit("name | quantity | Reference range")).otherwise(row).alias("text"))
    points = N.grid_points(N.table_grid(segments), ["article", "table_id", "pos"])
    return points.select(c("article").alias("l_orderkey"), "pos", "name", c("column").alias("column_"), "time", c("parsed.measurement.magnitude").alias("magnitude"))


@query("""
WITH x AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN len(s) = 1 THEN s[1] END AS status_, CASE WHEN len(s) > 1 THEN 'o_orderstatus' ELSE '' END AS conflicts, len(p)::INTEGER AS n_priorities FROM x""")
def merged_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as parts of one section: a status that they disagree on is none."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.array("o_orderpriority").alias("priorities"))
    out = N.merged(rows, ["o_custkey"], ["o_orderstatus"], ["priorities"], ["o_orderkey"])
    return out.select("o_custkey", c("o_orderstatus").alias("status_"), F.array_join("conflicts", ",").alias("conflicts"), F.size("priorities").alias("n_priorities"))


# ---- records


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as facts of several tasks."""
    lines = table(spark, folder, "lineitem")
    k = c("l_linenumber") % 7
    null = F.lit(None).cast("string")
    task = F.when(k == 0, "conditions").when(k == 1, "medications").when(k == 2, "procedures_devices").when(k == 3, "observations").when(k == 4, "allergies").when(k == 5, "family_genetics").otherwise("care_plans")
    values = {
        "name": F.concat(F.lit("part "), c("l_partkey").cast("string")), "subject": F.when(c("l_suppkey") % 9 == 0, "relative").otherwise("index_patient"), "assertion": F.when(c("l_returnflag") == "R", "absent").when(c("l_quantity") > 45, "possible").otherwise("present"),
        "action": F.when(c("l_tax") > 0.04, "ordered").when(c("l_tax") > 0.02, "completed").otherwise("current"), "action_text": F.lit("do it"), "kind": F.when(k == 5, "family_condition").when(c("l_discount") == 0, "device"), "scope": F.lit("specific_substance"), "substance": F.when(k == 4, "nuts"), "relative": F.when(c("l_linestatus") == "F", "mother"),
        "unit": F.lit("mg"), "verification_status": F.when(c("l_quantity") > 48, "confirmed").otherwise("unknown"), "scoring": F.when(c("l_quantity") == 1, "review_only"),
    }
    return lines.select(c("l_orderkey").cast("string").alias("article"), F.lit("p").alias("patient"), task.alias("task"), F.lit("items").alias("collection"), c("l_linenumber").alias("pos"), *(values.get(f, null).alias(f) for f in R.FACT), c("l_quantity").alias("number"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber % 7 AS k, l_suppkey % 9 = 0 AS other, CASE WHEN l_returnflag = 'R' THEN 'absent' WHEN l_quantity > 45 THEN 'possible' ELSE 'present' END AS a, CASE WHEN l_tax > 0.04 THEN 'ordered' WHEN l_tax > 0.02 THEN 'completed' ELSE 'current' END AS act, l_discount = 0 AS dev, l_linestatus = 'F' AS rel, l_quantity AS q FROM lineitem),
m AS (SELECT *, CASE WHEN q = 1 THEN 'review_only_or_quarantined' WHEN other AND k <> 5 THEN 'subject_is_not_index_patient' WHEN k = 0 AND a = 'possible' AND q > 48 THEN 'contradictory_assertion_and_certainty' WHEN k = 0 THEN 'Condition' WHEN a <> 'present' THEN 'nonaffirmative_fact_requires_specialized_mapping'
  WHEN k = 1 AND act = 'ordered' THEN 'MedicationRequest' WHEN k = 1 THEN 'MedicationStatement' WHEN k = 2 AND dev THEN 'device_event_requires_device_lifecycle_mapping' WHEN k = 2 AND act = 'ordered' THEN 'ServiceRequest' WHEN k = 2 THEN 'Procedure' WHEN k = 3 THEN 'Observation' WHEN k = 4 THEN 'AllergyIntolerance' WHEN k = 5 AND NOT rel THEN 'family_relationship_unresolved' WHEN k = 5 THEN 'FamilyMemberHistory' ELSE 'CarePlan' END AS x FROM f)
SELECT x AS outcome, CASE WHEN x LIKE '%\\_%' ESCAPE '\\' THEN 'deferred' ELSE 'mapped' END AS status, count(*) AS n FROM m GROUP BY ALL""")
def resource_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Facts to resource types, or the reason why not."""
    out = R.mapped_facts(_facts(spark, folder))
    outcome = F.coalesce(c("reason"), F.get_json_object("resource", "$.resourceType"))
    return out.groupBy(outcome.alias("outcome"), "status").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey::VARCHAR AS article, count(*) FILTER (NOT (l_quantity = 1 OR (l_suppkey % 9 = 0 AND l_linenumber % 7 <> 5) OR (l_linenumber % 7 = 0 AND l_returnflag <> 'R' AND l_quantity > 48) OR (l_linenumber % 7 <> 0 AND (l_returnflag = 'R' OR l_quantity > 45)) OR (l_linenumber % 7 = 2 AND l_discount = 0) OR (l_linenumber % 7 = 5 AND l_linestatus <> 'F'))) AS mapped, count(*) AS facts FROM lineitem GROUP BY 1""")
def patient_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles of an order's resources: mapped ones are entries beside the patient's own."""
    facts = _facts(spark, folder)
    out = R.bundles(R.mapped_facts(facts), facts)
    return out.select("article", (F.size("entries") - 1).cast("bigint").alias("mapped"), (c("mapped") + c("deferred")).alias("facts"))


@query("""
SELECT o.o_orderkey, count(l.l_orderkey) AS lines_, coalesce(string_agg(l.l_linenumber::VARCHAR, ',' ORDER BY l.l_linenumber), '') AS numbers, c.c_custkey IS NOT NULL AS known_customer FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_orderkey, c.c_custkey""")
def assembled_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines nested in order, and whether their customer is known."""
    lines = N.series_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber"])
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    known = table(spark, folder, "customer").select(c("c_custkey").alias("o_custkey"), F.lit(True).alias("k"))
    out = orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").join(known, "o_custkey", "left")
    return out.select("o_orderkey", F.greatest(F.coalesce(F.size("points"), F.lit(0)), F.lit(0)).cast("bigint").alias("lines_"), F.coalesce(F.array_join(F.transform("points", lambda p: p["l_linenumber"].cast("string")), ","), F.lit("")).alias("numbers"), F.coalesce("k", F.lit(False)).alias("known_customer"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS article, l_suppkey AS figure, l_returnflag AS panel FROM lineitem), a AS (SELECT l_orderkey AS article, l_suppkey AS figure, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS panel, l_partkey AS patient FROM lineitem)
SELECT p.article, p.figure, p.panel, count(a.article) AS n FROM p LEFT JOIN a ON p.article = a.article AND p.figure = a.figure AND (a.panel IS NULL OR a.panel = p.panel) GROUP BY ALL""")
def panel_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Panels with the assignments that name them or the whole figure."""
    lines = table(spark, folder, "lineitem").select(c("l_orderkey").alias("article"), c("l_suppkey").alias("figure"), c("l_returnflag").alias("panel"), "l_linenumber", c("l_partkey").alias("patient"))
    assignments = lines.withColumn("panel", F.when(c("l_linenumber") % 2 == 0, c("panel"))).drop("l_linenumber")
    out = R.assignments_of(lines.select("article", "figure", "panel").distinct(), assignments)
    return out.select("article", "figure", "panel", F.size("assignments").cast("bigint").alias("n"))


# ---- scans


@query("""
SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://[^/:?#]+')), '://(.*)$', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, regexp_matches(html, '<script[ >]') AS scripted FROM pages""")
def page_features(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of addresses and simple markup features; paths keep their case."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "").alias("canonical"), F.regexp_count("html", F.lit("<p[ >]")).cast("bigint").alias("paragraphs"), c("html").rlike("<script[ >]").alias("scripted"))


@query("""
SELECT 'r-' || doc_id AS record_id, sha256(text) AS source_hash, 'unknown' AS source_kind, 'local-unversioned' AS dataset_revision, 'r-' || doc_id AS source_id, length(text) AS n FROM documents WHERE trim(text, ' ') <> '' AND regexp_matches(text, '\\S')""")
def canonical_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON lines, read as canonical case records."""
    d = table(spark, folder, "documents").where(c("text").rlike(r"\S"))
    lines = d.select(F.to_json(F.struct(F.concat(F.lit("r-"), c("doc_id").cast("string")).alias("_id"), c("text").alias("description"))).alias("value"))
    return readers.canonical_records(lines).select("record_id", "source_hash", "source_kind", "dataset_revision", "source_id", F.length("text").cast("bigint").alias("n"))


@query("""
WITH f AS (SELECT substr(p_name, 1, 4) AS node, p_partkey FROM part), p AS (SELECT DISTINCT substr(p_name, 1, k) AS prefix, k FROM part, (VALUES (1), (2), (3)) AS v(k) WHERE length(p_name) >= k), q AS (SELECT prefix FROM p WHERE k <> 2 OR prefix < 'm')
SELECT DISTINCT f.node, (SELECT max_by(prefix, length(prefix)) FROM q WHERE starts_with(f.node, prefix)) AS note FROM f""")
def inherited_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes with the note of their longest prefix that has one."""
    part = table(spark, folder, "part").select("p_name")
    nodes = part.select(F.substring("p_name", 1, 4).alias("node")).distinct()
    prefixes = part.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("p_name", 1, k).alias("prefix")) for k in (1, 2, 3)))).alias("x")).select("x.*").distinct().where("k <> 2 or prefix < 'm'")
    return readers.inherited(nodes, "node", prefixes.select("prefix", c("prefix").alias("note")), "prefix", "note", 4)


@query("""
SELECT doc_id, count(*) AS pieces, max(e - s) AS longest, sum(e - s)::BIGINT AS characters FROM (SELECT doc_id, 0 AS s, length(text) AS e FROM documents WHERE length(text) <= 600) GROUP BY doc_id""")
def short_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of up to 600 characters are one window each (longer ones are tested by force)."""
    d = table(spark, folder, "documents").where("length(text) <= 600").select("doc_id", "text")
    out = L.windows(d, "text", 600, 50)
    return out.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(c("end") - c("start")).cast("bigint").alias("longest"), F.sum(c("end") - c("start")).alias("characters"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


