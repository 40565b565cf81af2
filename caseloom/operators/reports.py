"""Reports over receipts, counters and records. A total is null when any part is null or there is none; rates are sums over sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def complete_sum(c: Column) -> Column:
    """Null if any value is null, or without values."""
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(c))


def rate(value: Column, over: Column) -> Column:
    return F.when(over > 0, value / over)


def nonempty_valid(has_prediction: Column, patients: Column, all_valid: Column, errors: Column) -> Column:
    """Predicted, with patients, all tasks valid, and errors (array) known to be none."""
    return F.coalesce(has_prediction & (patients > 0) & all_valid & errors.isNotNull() & (F.size(errors) == 0), F.lit(False))


def quality(receipts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Receipts (has_prediction, patients, all_valid, errors) -> seven counts of what is there, empty, valid or unknown."""
    has = F.coalesce("has_prediction", F.lit(False))
    return receipts.groupBy(*by).agg(
        F.count_if(has).alias("prediction_artifacts"),
        F.count_if(has & (F.coalesce("patients", F.lit(0)) > 0)).alias("nonempty"),
        F.count_if(has & (F.col("patients") == 0)).alias("empty"),
        F.count_if(F.expr("patients is null")).alias("patients_unavailable"),
        F.count_if(F.coalesce("all_valid", F.lit(False))).alias("schema_valid"),
        F.count_if(nonempty_valid(F.col("has_prediction"), F.col("patients"), F.col("all_valid"), F.col("errors"))).alias("nonempty_valid"),
        F.count_if(F.expr("errors is null or patients is null")).alias("validity_unavailable"),
    )


def empty_rosters(reference: DataFrame, predicted: DataFrame, id_: str, patients: str) -> DataFrame:
    """agrees, ids (sorted): predictions without patients whose reference has none, or some (agrees false)."""
    both = predicted.where(F.coalesce(F.col(patients), F.lit(0)) == 0).select(id_).join(reference.select(id_, F.coalesce(F.col(patients), F.lit(0)).alias("_r")), id_)
    return both.groupBy((F.col("_r") == 0).alias("agrees")).agg(F.sort_array(F.collect_list(id_)).alias("ids"))


def throughput(receipts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Receipts (wall_seconds, gpus, prompt_tokens, completion_tokens, reasoning_tokens, model_calls, has_prediction, all_valid) -> totals and rates.

    A missing number of devices counts as one. Answer tokens are known only if every reasoning count lies within its completion count.
    """
    n, seconds = F.count(F.lit(1)), F.coalesce(F.sum("wall_seconds"), F.lit(0.0))
    gpu = F.coalesce(F.sum(F.col("wall_seconds") * F.coalesce("gpus", F.lit(1))), F.lit(0.0))
    output, reasoning = complete_sum(F.col("completion_tokens")), complete_sum(F.col("reasoning_tokens"))
    answer = F.when(F.every(F.coalesce(F.col("reasoning_tokens").between(0, F.col("completion_tokens")), F.lit(False))), output - reasoning)
    has = F.coalesce("has_prediction", F.lit(False))
    predicted, valid = F.count_if(has), F.count_if(has & F.coalesce("all_valid", F.lit(False)))
    prompt = complete_sum(F.col("prompt_tokens"))
    return receipts.groupBy(*by).agg(
        n.alias("documents"), predicted.alias("prediction_documents"), valid.alias("valid_documents"), seconds.alias("seconds"), gpu.alias("gpu_seconds"),
        prompt.alias("prompt_tokens"), output.alias("completion_tokens"), reasoning.alias("reasoning_tokens"), answer.alias("answer_tokens"),
        (prompt / n).alias("mean_prompt_tokens"), (output / n).alias("mean_completion_tokens"), (complete_sum(F.col("model_calls")) / n).alias("mean_model_calls"),
        F.count_if(F.expr("prompt_tokens is null")).alias("missing_prompt"), F.count_if(F.expr("completion_tokens is null")).alias("missing_completion"), F.count_if(F.expr("reasoning_tokens is null")).alias("missing_reasoning"),
        rate(output, seconds).alias("output_per_second"), rate(answer, seconds).alias("answer_per_second"), rate(reasoning, seconds).alias("reasoning_per_second"), rate(output, gpu).alias("output_per_gpu_second"),
        rate(n * 3600, seconds).alias("documents_per_hour"), rate(predicted * 3600, seconds).alias("predictions_per_hour"), rate(valid * 3600, seconds).alias("valid_per_hour"), rate(n * 3600, gpu).alias("documents_per_gpu_hour"),
    )


def task_usage(receipts: DataFrame, usage: str, counts: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """usage: map<task, struct<counts..., tokens...>> -> task, sums; token sums are null if any part is, and all rows are gone if any receipt has no map."""
    known = receipts.agg(F.every(F.col(usage).isNotNull()).alias("_all"))
    rows = receipts.select(F.explode(usage).alias("task", "_u")).groupBy("task").agg(*(F.sum(f"_u.{c}").alias(c) for c in counts), *(complete_sum(F.col(f"_u.{c}")).alias(c) for c in tokens))
    return rows.crossJoin(F.broadcast(known)).where("_all").drop("_all")  # one row


def worker_goodput(completed: DataFrame, workers: DataFrame, missing_receipts: int = 0, default_gpus: int = 1) -> DataFrame:
    """One row: documents, worker seconds, and rates that exist only if every worker's receipt does."""
    work = workers.agg(F.count("*").alias("workers"), F.coalesce(F.sum("worker_seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum(F.col("worker_seconds") * F.coalesce("gpus", F.lit(default_gpus))), F.lit(0.0)).alias("gpu_seconds"))
    has = F.coalesce("has_prediction", F.lit(False))
    done = completed.agg(F.count("*").alias("documents"), F.count_if(has).alias("predictions"), F.count_if(has & F.coalesce("all_valid", F.lit(False))).alias("valid"))
    there = (F.col("workers") > 0) & F.lit(missing_receipts == 0) & (F.col("seconds") > 0)
    per = lambda c: F.when(there, F.col(c) / F.col("seconds"))
    return work.crossJoin(done).select("workers", F.lit(missing_receipts).alias("missing_receipts"), "seconds", "gpu_seconds", "documents", per("documents").alias("documents_per_second"), per("predictions").alias("predictions_per_second"), per("valid").alias("valid_per_second"), F.when(there & (F.col("gpu_seconds") > 0), F.col("documents") * 3600 / F.col("gpu_seconds")).alias("documents_per_gpu_hour"))


def counter_deltas(samples: DataFrame, by: Sequence[str], order: Sequence[str], drafted: str, accepted: str) -> DataFrame:
    """Each sample against the one before: available, drafted, accepted, fraction. A counter that is missing or fell makes the step unavailable, and so does more accepted than drafted."""
    own = Window.partitionBy(*by).orderBy(*order)
    step = {c: F.when(F.col(c) >= F.lag(c).over(own), F.col(c) - F.lag(c).over(own)) for c in (drafted, accepted)}
    rows = samples.withColumn("_n", F.row_number().over(own)).withColumn("_d", step[drafted]).withColumn("_a", step[accepted]).where("_n > 1")
    there = F.coalesce((F.col("_a") <= F.col("_d")), F.lit(False))
    return rows.select(*by, *order, there.alias("available"), F.when(there, F.col("_d")).alias("drafted"), F.when(there, F.col("_a")).alias("accepted"), F.when(there & (F.col("_d") > 0), F.col("_a") / F.col("_d")).alias("fraction"))


def acceptance(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """counter_deltas() -> measured, expected, drafted, accepted, fraction; sums only if every step is available."""
    whole = F.count_if("available") == F.count(F.lit(1))
    drafted, accepted = F.when(whole, F.sum("drafted")), F.when(whole, F.sum("accepted"))
    return steps.groupBy(*by).agg(F.count_if("available").alias("measured"), F.count(F.lit(1)).alias("expected"), drafted.alias("drafted"), accepted.alias("accepted"), F.when(drafted > 0, accepted / drafted).alias("fraction"))


def metric_sums(lines: DataFrame, line: str, names: Sequence[str]) -> DataFrame:
    """Text lines 'name{labels} value [time]' -> name, value: summed over labels; negative or not finite values fail the query."""
    shape = rf"^({'|'.join(n.replace('.', chr(92) + '.') for n in names)})(?:\{{[^\n]*\}})?\s+(\S+)(?:\s+\d+)?$"
    value = F.regexp_extract(line, shape, 2).try_cast("double")
    rows = lines.where(F.col(line).rlike(shape)).select(F.regexp_extract(line, shape, 1).alias("name"), value.alias("value"))
    sound = F.col("value").isNotNull() & (F.col("value") >= 0) & (F.col("value") < float("inf"))
    return rows.select("name", F.when(sound, F.col("value")).otherwise(F.raise_error(F.lit("a counter is negative or no number"))).alias("value")).groupBy("name").agg(F.sum("value").alias("value"))


def stats(c: str) -> list[Column]:
    """n, mean, median, p95 (nearest rank), most, total of a column, nulls left out. Exact percentiles keep one entry a distinct value."""
    x = F.col(c)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})").alias("p95"), F.max(x).alias("most"), F.sum(x).alias("total")]


def linear_stats(c: str) -> list[Column]:
    """n, mean, median, p95 by linear interpolation, least, most."""
    x = F.col(c)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.min(x).alias("least"), F.max(x).alias("most")]


def ledger_metrics(calls: DataFrame, task: str, status: str, tokens: Sequence[str]) -> DataFrame:
    """Calls -> one row a task and one of all (task null): calls, statuses (map), token sums (null if any call's is)."""
    counts = calls.groupBy(task, status).agg(F.count("*").alias("n"), *(F.count(t).alias(f"{t}_n") for t in tokens), *(F.sum(t).alias(t) for t in tokens))
    merged = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status), F.lit("unknown")).alias("status"), "n"))))
    total = lambda t: F.when(F.sum(f"{t}_n") == F.sum("n"), F.sum(t)).alias(t)
    by_task = counts.groupBy(task).agg(F.sum("n").alias("calls"), merged.alias("statuses"), *(total(t) for t in tokens))
    both = counts.groupBy(status).agg(F.sum("n").alias("n"), *(F.sum(f"{t}_n").alias(f"{t}_n") for t in tokens), *(F.sum(t).alias(t) for t in tokens))
    every = both.agg(F.sum("n").alias("calls"), merged.alias("statuses"), *(total(t) for t in tokens))
    return by_task.unionByName(every.withColumn(task, F.lit(None).cast(calls.schema[task].dataType)))


def progress(attempts: DataFrame, id_: str, order: Sequence[str], status: str, error: str) -> DataFrame:
    """Attempts -> one row: ids, done, failed (last attempt failed), running, and the latest error of ids that aren't done (map)."""
    last = attempts.groupBy(id_).agg(F.max_by(F.struct(status, error), F.struct(*order)).alias("_x"), F.bool_or(F.col(status) == "done").alias("done"))
    state = F.col(f"_x.{status}")
    return last.agg(F.count("*").alias("ids"), F.count_if("done").alias("done"), F.count_if(~F.col("done") & (state == "failed")).alias("failed"), F.count_if(~F.col("done") & (state == "running")).alias("running"))


def leveled(rows: DataFrame, levels: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """One scan, one row a group of each level (a set of columns); columns that a level lacks are null, `level` numbers the sets."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    out = rows.groupingSets([[F.col(c) for c in level] for level in levels], *names).agg(F.grouping_id().alias("_g"), *measures)
    of = {sum((c not in level) << (len(names) - 1 - k) for k, c in enumerate(names)): n for n, level in enumerate(levels)}
    return out.withColumn("level", F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("_g").cast("int"))).drop("_g")


def slowest(rows: DataFrame, id_: str, seconds: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.col(seconds).desc_nulls_last(), id_).limit(n)


def paired(receipts: DataFrame, arm: str, id_: str, baseline: str, seconds: str, stages: Sequence[str] = ()) -> DataFrame:
    """Each other arm against the baseline on ids that both completed: articles, seconds of both, speedup; of stages only if every id has them on both sides."""
    cols = [seconds, *stages]
    base = receipts.where(F.col(arm) == baseline).select(id_, *(F.col(c).alias(f"b_{c}") for c in cols))
    both = receipts.where(F.col(arm) != baseline).select(arm, id_, *cols).join(base, id_)
    told = [F.count("*").alias("articles"), F.sum(f"b_{seconds}").alias("baseline_seconds"), F.sum(seconds).alias("candidate_seconds"), rate(F.sum(f"b_{seconds}"), F.sum(seconds)).alias("speedup")]
    told += [rate(complete_sum(F.when(F.col(s).isNotNull(), F.col(f"b_{s}"))), complete_sum(F.when(F.col(f"b_{s}").isNotNull(), F.col(s)))).alias(f"{s}_speedup") for s in stages]
    return both.groupBy(arm).agg(*told)


def matched_arms(rows: DataFrame, arm: str, id_: str, arms: int) -> DataFrame:
    """Rows of ids that all arms have."""
    whole = rows.groupBy(id_).agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == arms).select(id_)
    return rows.join(whole, id_, "left_semi")


def failures(tasks: DataFrame, article: str, task: str, failed: Column) -> DataFrame:
    """kind (task or article), name, failed, total: one scan, both groupings; names without a failure stay out."""
    told = F.explode(F.array(F.struct(F.lit("task").alias("kind"), F.col(task).cast("string").alias("name")), F.struct(F.lit("article").alias("kind"), F.col(article).cast("string").alias("name"))))
    return tasks.select(F.coalesce(failed, F.lit(False)).alias("_f"), told.alias("x")).groupBy("x.kind", "x.name").agg(F.count_if("_f").alias("failed"), F.count("*").alias("total")).where("failed > 0")


def coverage(expected: DataFrame, provided: DataFrame, id_: str) -> DataFrame:
    """id, expected, provided (times), state: once, missing, repeated or unexpected."""
    both = expected.select(id_).distinct().withColumn("expected", F.lit(True)).join(provided.groupBy(id_).agg(F.count("*").alias("provided")), id_, "full")
    both = both.na.fill(0, ["provided"]).na.fill(False, ["expected"])
    state = F.when(~F.col("expected"), "unexpected").when(F.col("provided") == 0, "missing").when(F.col("provided") > 1, "repeated").otherwise("once")
    return both.withColumn("state", state)


def field_coverage(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, populated, empty: how many rows tell something in each field."""
    from caseloom.functions.text import informative

    told = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), informative(F.col(f).cast("string")).alias("has")) for f in fields)))
    return rows.select(told.alias("x")).groupBy("x.field").agg(F.count_if(F.expr("x.has")).alias("populated"), F.count_if(F.expr("not x.has")).alias("empty"))


def cross_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both columns, by each and of all: grouping sets of one scan; `level` 0 both, 1 the first, 2 the second, 3 all."""
    return rows.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def section_counts(facts: DataFrame, patient: Sequence[str], section: str) -> DataFrame:
    """section, facts, patients that have any."""
    return facts.groupBy(*patient, section).agg(F.count("*").alias("_n")).groupBy(section).agg(F.sum("_n").alias("facts"), F.count("*").alias("patients"))


def patient_summary(facts: DataFrame, by: Sequence[str], kind: str, name: str, order: Sequence[str]) -> DataFrame:
    """Facts (kind, name, present) -> by..., sex (first), conditions and medications (sorted, each once), facts."""
    names = lambda k: F.array_sort(F.collect_set(F.when((F.col(kind) == k) & F.col("present"), F.trim(name))))
    return facts.groupBy(*by).agg(F.min_by(F.when(F.col(kind) == "sex", F.col(name)), F.when(F.col(kind) == "sex", F.struct(*order))).alias("sex"), names("condition").alias("conditions"), names("medication").alias("medications"), F.count("*").alias("facts"))


def linked_calls(facts: DataFrame, calls: DataFrame, keys: Sequence[str], seq: str, call: str) -> DataFrame:
    """Facts with `calls`: the calls of their record and task in order of their number; an empty array without any."""
    own = calls.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, call))), lambda x: x[call]).alias("calls"))
    return facts.join(own, [*keys], "left").withColumn("calls", F.coalesce("calls", F.array().cast(dict(own.dtypes)["calls"])))


def themes(title: Column, lanes: Sequence[tuple[str, str]], default: str) -> Column:
    """struct<tags, lane>: all lanes whose pattern the title has, in their order, and the first; the default without any."""
    tags = F.filter(F.array(*(F.when(F.coalesce(title.rlike(f"(?i){p}"), F.lit(False)), F.lit(n)) for n, p in lanes)), lambda x: x.isNotNull())
    return F.struct(tags.alias("tags"), F.coalesce(F.get(tags, F.lit(0)), F.lit(default)).alias("lane"))


def change_counts(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows after rules (name -> (column, new value), in order) and rule, changed: how many rows each changed."""
    out = rows
    for name, (c, value) in rules.items():
        out = out.withColumn(f"_was_{name}", F.col(c)).withColumn(c, value).withColumn(f"_new_{name}", ~F.col(c).eqNullSafe(F.col(f"_was_{name}"))).drop(f"_was_{name}")
    marks = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_new_{n}").alias("changed")) for n in rules)))
    counts = out.select(marks.alias("x")).groupBy("x.rule").agg(F.count_if(F.expr("x.changed")).alias("changed"))
    return out.drop(*(f"_new_{n}" for n in rules)), counts


def budget_audit(entries: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, limit: Column) -> DataFrame:
    """Entries with `spent` (up to and with each) and `within`."""
    spent = F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return entries.withColumn("spent", spent).withColumn("within", F.col("spent") <= limit)
