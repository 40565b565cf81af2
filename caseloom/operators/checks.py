"""Row rules: named predicates to arrays of violations, literal quotes, references, covers, and routes for what fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions import text as T, times as I


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (their predicates are true), in their order; null predicates break nothing."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def routed(rows: DataFrame, rules: dict[str, Column], blocking: Sequence[str] = ()) -> DataFrame:
    """Rows with `violations` and `route`: accept without any, quarantine with a blocking one, else review."""
    v = broken(rules)
    hard = F.size(F.array_intersect("violations", F.array(*map(F.lit, blocking)))) > 0 if blocking else F.lit(False)
    return rows.withColumn("violations", v).withColumn("route", F.when(F.size("violations") == 0, "accept").when(hard, "quarantine").otherwise("review"))


def violation_rows(rows: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """keys..., rule: one row a violation."""
    return rows.select(*keys, F.explode(broken(rules)).alias("rule"))


# ---- sets of rules over columns of facts


def documentation_rules(status: Column, n_facts: Column) -> dict[str, Column]:
    """Documented sections have facts, others none."""
    return {"documented_without_facts": (status == "documented") & (F.coalesce(n_facts, F.lit(0)) == 0), "facts_without_documentation": (status != "documented") & (n_facts > 0)}


def fact_rules(assertion: Column, verification: Column, number: Column, text: Column, absent_reason: Column, unit: Column, age: Column, scope: Column, category: Column) -> dict[str, Column]:
    """Refuted means absent; a value excludes an absent reason, and one of both is due; ages are not negative and have a known unit; a scoped allergy has a category."""
    has = number.isNotNull() | T.informative(text)
    return {
        "refuted_but_not_absent": (verification == "refuted") & (assertion != "absent"),
        "value_and_absent_reason": has & T.informative(absent_reason),
        "neither_value_nor_absent_reason": ~has & ~T.informative(absent_reason),
        "negative_age": age < 0,
        "unknown_age_unit": age.isNotNull() & ~F.coalesce(F.lower(unit).isin(*I.AGE_UNITS), F.lit(False)),
        "scope_without_category": T.informative(scope) & (scope != "specific_substance") & ~T.informative(category),
    }


def death_conflict(outcome: Column, assertion: Column, state: Column) -> Column:
    """A present death while the subject is alive, or a dead subject whose death is denied."""
    return F.coalesce((outcome == "death") & (((assertion == "present") & (state == "alive")) | ((assertion == "absent") & (state == "deceased"))), F.lit(False))


def coverage_unit_error(disposition: Column, n_facts: Column) -> Column:
    """A unit is extracted exactly if it has facts."""
    return (disposition == "extracted") != (F.coalesce(n_facts, F.lit(0)) > 0)


def label_error(label: Column, title: Column) -> Column:
    """A patient label that is the title, or a long part of it."""
    a, b = T.key(label), T.key(title)
    return F.when((a != "") & ((a == b) | ((F.length(a) >= 30) & F.contains(b, a))), F.lit("label_repeats_title"))


def panel_label_issue(label: Column) -> Column:
    """positional ('left', 'upper right panel'), patient_name ('patient 2', 'case 3') or null."""
    plain = T.key(label)
    return F.when(plain.rlike(r"^(?:(?:upper|lower|left|right|top|bottom|middle|center|centre|first|second|third|last|panel|image|row|column) ?)+$"), "positional").when(plain.rlike(r"^(?:patient|case|subject) ?\w{1,4}$"), "patient_name")


def question_outside_quotes(text: Column) -> Column:
    return F.contains(T.without_quoted(F.coalesce(text, F.lit(""))), F.lit("?"))


def upper_bound_printed(value: Column, quotes: Column) -> Column:
    """Whether every place where the value is printed (array of quotes) follows a cue for an upper bound; false if it is printed nowhere."""
    v = F.regexp_replace(value.cast("string"), r"([\\.+*?^$(){}|\[\]])", r"\\$1")
    count = lambda pattern: F.aggregate(quotes, F.lit(0), lambda n, q: n + F.regexp_count(q, pattern))
    printed = count(F.concat(F.lit(r"(?<![\d.])"), v, F.lit(r"(?![\d.]*\d)")))
    bounded = count(F.concat(F.lit(r"(?i)(?:<|≤|up to|less than|below|under|at most|maximum of)\s*"), v, F.lit(r"(?![\d.]*\d)")))
    return (printed > 0) & (bounded >= printed)


def borrowed_time(time: Column, quotes: Column, labels: Column) -> Column:
    """With two quotes or more (array), a time that stands only in quotes which share no content word with the fact's labels (array of stems)."""
    holds = F.filter(quotes, lambda q: F.contains(q, time))
    apart = F.forall(holds, lambda q: ~F.contains(q, F.lit("|")) & (F.size(F.array_intersect(stems(q), labels)) == 0))
    return F.coalesce((F.size(quotes) > 1) & T.informative(time) & (F.size(holds) > 0) & apart, F.lit(False))


def stems(text: Column, length: int = 5) -> Column:
    """First letters of the words of four letters and more, in lower case; built in throughout, so it stands in lambdas."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 3), lambda w: F.substr(w, F.lit(1), F.lit(length))))


def time_in_other_sentence(time: Column, quote: Column, labels: Column) -> Column:
    """A time whose sentence in the quote shares no content word with the labels, while another sentence does."""
    own = T.sentences(quote)
    with_time = F.filter(own, lambda s: F.contains(s, time))
    told = lambda s: F.size(F.array_intersect(stems(s), labels)) > 0
    return F.coalesce((F.size(own) > 1) & (F.size(with_time) > 0) & ~F.exists(with_time, told) & F.exists(own, told), F.lit(False))


def time_only(errors: Column) -> Column:
    """Whether there are errors and all of them are about times."""
    return (F.size(errors) > 0) & F.forall(errors, lambda e: e.rlike("(?i)time|date"))


# ---- literal evidence


def span_sound(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a text holds the quote exactly from start to end."""
    return F.coalesce((start >= 0) & (end >= start) & (F.substr(text, start + 1, end - start) == quote), F.lit(False))


def literal_evidence(facts: DataFrame, segments: DataFrame, article: str, fact: str, evidence: str) -> DataFrame:
    """Facts with `literal`: every quote (array<struct<segment, quote>>) stands in its named segment or heading, or, if that isn't there, in any of the article; false without quotes.

    Segments (article, segment, heading, text). Quotes are joined to the segments of their article only.
    """
    asked = facts.select(article, fact, F.posexplode_outer(evidence).alias("_k", "_e")).select(article, fact, "_k", F.col("_e.segment").alias("_s"), F.col("_e.quote").alias("_q"))
    place = segments.select(article, F.col("segment").alias("_segment"), F.col("heading").alias("_heading"), F.col("text").alias("_text"))
    named = F.coalesce((F.col("_segment") == F.col("_s")) | ((F.col("_heading") == F.col("_s")) & (F.col("_s") != "")), F.lit(False))
    holds = F.coalesce(F.contains("_text", F.col("_q")), F.lit(False))
    met = asked.join(place, article, "left").groupBy(article, fact, "_k").agg(F.bool_or(named).alias("_n"), F.bool_or(named & holds).alias("_nh"), F.bool_or(holds).alias("_h"), F.first(F.coalesce("_q", F.lit("")) != "").alias("_some"))
    told = met.groupBy(article, fact).agg(F.bool_and(F.col("_some") & F.when(F.coalesce("_n", F.lit(False)), F.col("_nh")).otherwise(F.coalesce("_h", F.lit(False)))).alias("literal"))
    return facts.join(told, [article, fact], "left").na.fill(False, ["literal"])


def resolved_quotes(quotes: DataFrame, segments: DataFrame, article: str, squeeze: bool = False) -> DataFrame:
    """Quotes (article, quote, id, segment or null) with `found_segment`, `start`: the one place where they stand; null if there is none or more than one. squeeze: white space counts as one blank on both sides, and start is null."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) if squeeze else c
    place = segments.select(article, F.col("segment").alias("_segment"), flat(F.col("text")).alias("_text"))
    met = quotes.withColumn("_q", flat(F.col("quote"))).join(place, article).where(F.contains("_text", F.col("_q")) & (F.col("_q") != "") & (F.col("segment").isNull() | (F.col("segment") == F.col("_segment"))))
    places = met.select(article, "id", "_segment", T.all_places(F.col("_text"), F.col("_q")).alias("_at"))
    once = places.groupBy(article, "id").agg(F.sum(F.size("_at")).alias("_n"), F.first("_segment").alias("found_segment"), F.first(F.get("_at", F.lit(0))).alias("start")).where("_n = 1")
    if squeeze:
        once = once.withColumn("start", F.lit(None).cast("int"))
    return quotes.join(once.drop("_n"), [article, "id"], "left")


def quote_errors(quotes: DataFrame, segments: DataFrame, article: str) -> DataFrame:
    """Quotes (article, id, segment, quote) with `error`: unknown_segment, empty_quote, not_literal or null."""
    own = segments.select(article, "segment", F.col("text").alias("_text"))
    told = F.when(F.col("_text").isNull(), "unknown_segment").when(F.coalesce("quote", F.lit("")) == "", "empty_quote").when(~F.contains("_text", F.col("quote")), "not_literal")
    return quotes.join(own, [article, "segment"], "left").withColumn("error", told).drop("_text")


def field_support(fields: Column, quotes: Column) -> Column:
    """map<field, value> -> map<field, boolean>: whether some quote holds the value, whatever its case."""
    low = F.transform(quotes, lambda q: F.lower(q))
    return F.transform_values(fields, lambda k, v: F.exists(low, lambda q: F.contains(q, F.lower(v))))


# ---- references and covers


def missing_references(rows: DataFrame, key: Sequence[str], targets: DataFrame) -> DataFrame:
    """Rows whose key (all columns known) the targets lack."""
    known = " and ".join(f"{k} is not null" for k in key)
    return rows.where(known).join(targets.select(*key).distinct(), [*key], "left_anti")


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """key..., n of keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(rows: DataFrame, by: Sequence[str], number: str, first_place: str) -> DataFrame:
    """Rows whose number isn't their rank by first place."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(first_place).asc_nulls_last(), number))).where(F.col(number) != F.col("_rank")).drop("_rank")


def conflicts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by..., values (sorted) of groups whose rows differ in a known value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values")).where("size(values) > 1")


def exact_cover(asked: DataFrame, decided: DataFrame, key: Sequence[str]) -> DataFrame:
    """key..., state of keys that aren't decided exactly once: missing, repeated or unknown."""
    n = decided.groupBy(*key).agg(F.count("*").alias("_n"))
    both = asked.select(*key).distinct().withColumn("_asked", F.lit(True)).join(n, [*key], "full")
    state = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.withColumn("state", state).where("state is not null").select(*key, "state")


def allowed_choice(choice: Column, candidates: Column) -> Column:
    """Whether a choice is none (null) or one of the candidates."""
    return choice.isNull() | F.array_contains(candidates, choice)


def gate(files: DataFrame, by: str, basis: str, order: Sequence[str]) -> DataFrame:
    """by, satisfied_by: the bases of a group's files joined by + in fixed order, if every file has one; else null."""
    own = F.collect_set(basis)
    joined = F.array_join(F.filter(F.array(*map(F.lit, order)), lambda b: F.array_contains(F.col("_own"), b)), "+")
    return files.groupBy(by).agg(own.alias("_own"), F.every(F.col(basis).isNotNull()).alias("_all")).select(by, F.when(F.col("_all"), joined).alias("satisfied_by"))


def ladder(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first case that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for holds, name in cases:
        out = out.when(F.coalesce(holds, F.lit(False)), name)
    return out.otherwise(otherwise)


def completed(rows: DataFrame, by: Sequence[str], gates: Sequence[str]) -> DataFrame:
    """by..., each gate (true if all its rows are) and completed: all gates; a null gate is open. A repeated key fails the query."""
    out = rows.groupBy(*by).agg(*(F.every(F.coalesce(F.col(g), F.lit(False))).alias(g) for g in gates), F.count("*").alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a key has more than one row")).cast("boolean")).otherwise(F.lit(True))
    every = F.lit(True)
    for g in gates:
        every = every & F.col(g)
    return out.withColumn("completed", every & once).drop("_n")


def placeholder_name(reviewer: Column) -> Column:
    """Whether a reviewer's name is none or a stand-in."""
    return F.coalesce(F.trim(reviewer), F.lit("")).rlike(r"(?i)^(|todo|tbd|name|your name|reviewer|agent|unknown|placeholder|n/?a|x+|<.*>)$")
