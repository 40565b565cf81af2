"""Pieces around extraction: views, packets, model outputs, cells against items, drafts, routes and receipts. Frames in, frames or column expressions out."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from caseloom.functions import measurements as M, text as T
from caseloom.functions.labels import canonical
from caseloom.functions.lets import let

# Kinds of a panel's image with their categories, those that go into a record, and the order of gate states.
PATHOLOGY, PHOTOS = ("microscopy", "specimen_photograph"), ("clinical_photograph", "operative_photograph")
INCLUDABLE = ("pathology", "clinical_imaging", "clinical_photo", "waveform", "clinical_chart_of_patient_data")
CALENDAR_UNITS = ("month", "year")


# ---- sources and views


def view_sound(article_sha: Column, bound_sha: Column, text: Column, text_sha: Column) -> Column:
    """Whether a view is bound to its article and its text has the hash it names."""
    return F.coalesce((article_sha == bound_sha) & (F.sha2(text, 256) == text_sha), F.lit(False))


def with_view(articles: DataFrame, views: DataFrame, key: str, kind: str) -> DataFrame:
    """Articles with `view`: theirs of one kind (struct of its other columns), or null."""
    rest = [c for c in views.columns if c not in (key, "kind")]
    own = views.where(F.col("kind") == kind).groupBy(key).agg(F.min(F.struct(*rest)).alias("view"))
    return articles.join(own, key, "left")


def markup_fields(xml: Column) -> Column:
    """struct<journal, keywords, affiliations> of raw markup, tags taken out."""
    all_of = lambda tag: F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")))
    return F.struct(F.get(all_of("journal-title"), F.lit(0)).alias("journal"), all_of("kwd").alias("keywords"), all_of("aff").alias("affiliations"))


def packets(segments: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Segments (segment, heading, text) -> by..., packet (their texts with headings, in order), spans (where each text lies in it), packet_sha256."""
    head = F.concat(F.lit("["), F.col("segment"), F.lit("] "), F.coalesce("heading", F.lit("Article")), F.lit("\n"))
    whole = F.concat(head, F.col("text"), F.lit("\n\n"))
    before = F.coalesce(F.sum(F.length(whole)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = segments.withColumn("_start", (before + F.length(head)).cast("int")).withColumn("_whole", whole)
    told = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_start", "segment", (F.col("_start") + F.length("text")).alias("_end"), "_whole"))).alias("_s"))
    packet = F.array_join(F.transform("_s", lambda s: s["_whole"]), "")
    spans = F.transform("_s", lambda s: F.struct(s["segment"].alias("segment"), s["_start"].alias("start"), s["_end"].alias("end")))
    return told.select(*by, packet.alias("packet"), spans.alias("spans"), F.sha2(packet, 256).alias("packet_sha256"))


def patient_view(segments: DataFrame, assigned: DataFrame, article: str, patient: str) -> DataFrame:
    """Segments of each patient: those assigned to them or to nobody (assigned: article, segment, patient or null), identity segments, abstracts, introductions, and all tables and captions."""
    people = assigned.where(F.col(patient).isNotNull()).select(article, patient).distinct()
    always = F.col("kind").rlike("^(abstract|table|figure|caption)") | F.lower(F.coalesce("heading", F.lit(""))).rlike("^(abstract|introduction)")
    shared = segments.where(always).join(people, article)
    loose = segments.join(assigned.where(F.col(patient).isNull()).select(article, "segment").distinct(), [article, "segment"], "left_semi").join(people, article)
    own = segments.join(assigned.where(F.col(patient).isNotNull()).select(article, "segment", patient).distinct(), [article, "segment"])
    return own.unionByName(shared.select(*own.columns)).unionByName(loose.select(*own.columns)).distinct()


def merged_identities(windows: DataFrame, mapping: DataFrame, by: Sequence[str], local: str, final: str, order: Sequence[str]) -> DataFrame:
    """Window-local people (by..., local, label, evidence array) under their declared groups (by..., local, final): label of the first, all evidence, each once. People without a group keep their local id."""
    both = windows.join(mapping.select(*by, local, final), [*by, local], "left").withColumn(final, F.coalesce(final, local))
    from .nested import unique

    out = both.groupBy(*by, final).agg(F.min_by("label", F.struct(*order)).alias("label"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "evidence"))), lambda x: x["evidence"])).alias("evidence"), F.count("*").alias("members"))
    return out.withColumn("evidence", unique(F.col("evidence")))


def receipts_agree(frames: Sequence[DataFrame], keys: Sequence[str], hashes: Sequence[str]) -> DataFrame:
    """keys of rows that every frame has with equal hashes."""
    out = frames[0].select(*keys, *hashes)
    for f in frames[1:]:
        out = out.join(f.select(*keys, *hashes).distinct(), [*keys, *hashes], "left_semi")
    return out.select(*keys).distinct()


def coverage_units(segments: DataFrame, supplements: DataFrame, article: str) -> DataFrame:
    """article, unit, kind, disposition: every segment and supplement, undecided."""
    row = lambda df, c, kind: df.select(article, F.concat_ws(":", F.lit(kind), F.col(c)).alias("unit"), F.lit(kind).alias("kind"), F.lit("undecided").alias("disposition"))
    return row(segments, "segment", "segment").unionByName(row(supplements, "supplement", "supplement"))


# ---- model outputs


def parsed_object(text: str | None) -> tuple[str | None, str | None, str | None]:
    """Canonical JSON of the one object that a text holds, how it was found, and why not.

    Strict JSON first; else all balanced objects in prose or fences, as JSON or as a Python literal; two different ones are ambiguous.
    """

    def strict(s: str) -> object:
        def once(pairs: list) -> dict:
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("a key repeats")
            return dict(pairs)

        return json.loads(s, object_pairs_hook=once, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))

    if text is None:
        return None, None, "missing"
    whole = text.strip().lstrip("﻿")
    try:
        value = strict(whole)
        return (canonical(value), "json", None) if isinstance(value, dict) else (None, None, "not_an_object")
    except json.JSONDecodeError:
        pass
    except ValueError:
        return None, None, "repeated_key_or_number"
    found: dict[str, str] = {}
    at = 0
    while (at := whole.find("{", at)) >= 0:
        depth, quote, skip, end = 0, "", False, -1
        for k in range(at, len(whole)):
            ch = whole[k]
            if skip:
                skip = False
            elif quote:
                skip, quote = ch == "\\", "" if ch == quote else quote
            elif ch in "\"'" and (ch == '"' or whole[k - 1] in "{[,: "):
                quote = ch
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    end = k + 1
                    break
        if end < 0:
            break
        for how, read in (("embedded_json", strict), ("literal_object", ast.literal_eval)):
            try:
                value = read(whole[at:end])
            except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
                continue
            if isinstance(value, dict):
                found.setdefault(canonical(value), how)
                break
        at = end
    if len(found) == 1:
        ((value, how),) = found.items()
        return value, how, None
    return None, None, "ambiguous" if found else "no_object"


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("value", "method", "error")]))
def model_output(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """struct<value, method, error> of texts that should hold one JSON object."""
    for b in batches:
        yield pd.DataFrame([parsed_object(x) for x in b], columns=["value", "method", "error"])


@F.pandas_udf(BooleanType())
def contains_coding(value: pd.Series, coding: pd.Series) -> pd.Series:
    """Whether a JSON value holds a `coding` equal to another JSON value, at any depth."""

    def has(v: object, want: object) -> bool:
        if isinstance(v, dict):
            return v.get("coding") == want or any(has(x, want) for x in v.values())
        return isinstance(v, list) and any(has(x, want) for x in v)

    def told(a: str | None, b: str | None) -> bool:
        try:
            return a is not None and b is not None and has(json.loads(a), json.loads(b))
        except ValueError:
            return False

    return pd.Series([told(a, b) for a, b in zip(value, coding, strict=True)])


def split_sound(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others, which stay for audit; null is unsound."""
    ok = F.coalesce(sound, F.lit(False))
    return rows.where(ok), rows.where(~ok)


# ---- cells, items, times


def written_measurement(number: Column, comparator: Column, unit: Column) -> Column:
    """The scalar that an item's fields write, as parsed_measurement(); null without a number or with an unknown comparator."""
    sign = F.when(comparator.isin("<", "<=", ">", ">="), comparator).otherwise("")
    shown = F.regexp_replace(number.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    whole = F.when(F.contains(number.cast("decimal(38,12)").cast("string"), F.lit(".")), shown).otherwise(number.cast("string"))
    return F.when(number.isNotNull() & ~F.coalesce(comparator == "unknown", F.lit(False)), M.parsed_measurement(F.concat(sign, whole, F.coalesce(F.concat(F.lit(" "), unit), F.lit("")))))


def _same_amount(a: Column, b: Column) -> Column:
    return F.coalesce((a["magnitude"].try_cast("decimal(38,15)") == b["magnitude"].try_cast("decimal(38,15)")) & (a["comparator"] == b["comparator"]), F.lit(False))


def cell_matches(raw: Column, number: Column, text: Column, comparator: Column, unit: Column) -> Column:
    """struct<holds, reason>: whether an item's number or text is what its cell says; nothing is converted or guessed."""

    def judge(v: Column) -> Column:
        cell, said, own = v["cell"], v["said"], v["own"]
        m = cell["measurement"]
        bare = number.isNull()
        answer = lambda holds, why: F.struct(F.lit(holds).alias("holds"), F.lit(why).alias("reason"))
        literal = F.coalesce((text == raw) & bare, F.lit(False))
        units = F.coalesce(m["unit"] != own["unit"], F.lit(False)) & unit.isNotNull()
        text_wrong = text.isNotNull() & ~_same_amount(said, m)
        number_wrong = number.isNotNull() & ~_same_amount(own, m)
        return (
            F.when(cell["status"] == "missing_cell", answer(False, "missing_cell_has_no_extractable_result_value"))
            .when(m.isNull() & literal, answer(True, "exact_literal_nonscalar_result"))
            .when(m.isNull(), answer(False, "nonscalar_cell_requires_exact_text_without_numeric_guess"))
            .when(~comparator.eqNullSafe(m["comparator"]), answer(False, "cell_and_observation_comparator_disagree"))
            .when(units, answer(False, "cell_and_observation_unit_disagree"))
            .when(text_wrong, answer(False, "cell_and_text_value_disagree_or_are_ambiguous"))
            .when(number_wrong, answer(False, "cell_and_numeric_value_comparator_or_unit_disagree"))
            .when(text.isNull() & bare, answer(False, "cell_value_not_represented_in_observation"))
            .otherwise(answer(True, "scalar_result_corresponds_without_unit_conversion"))
        )

    parts = F.struct(M.parsed_cell(raw).alias("cell"), M.parsed_measurement(text).alias("said"), written_measurement(number, comparator, unit).alias("own"))
    return let(parts, judge)


def legend_error(status: Column, raw: Column, legend: Column, words: str) -> Column:
    """Why a cell's documented status isn't borne out by its legend: no_legend, token_not_named, status_not_stated, or null. words: a pattern that states it."""
    cut = M.without_markers(raw)
    quoted = lambda x: F.regexp_replace(x, r"([\\.+*?^$(){}|\[\]])", r"\\$1")
    token = (cut["core"] != "") & ~cut["core"].rlike(r"^[\d.\s]+$") & F.regexp_like(legend, F.concat(F.lit(r"(?<!\w)"), quoted(cut["core"]), F.lit(r"(?!\w)")))
    marker = F.exists(cut["markers"], lambda m: F.regexp_like(legend, F.concat(F.lit(r"(?:\^\(?|\(|^|\s)"), quoted(m), F.lit(r"(?:\)|\s|[:.=,])"))))
    return F.when(status.isNull(), None).when(legend.isNull(), "no_legend").when(~(token | marker), "token_not_named").when(~legend.rlike(f"(?i){words}"), "status_not_stated")


def own_mention(number: Column, quotes: Column) -> Column:
    """How often a number is printed in a fact's own quotes; one mention binds it, more are ambiguous."""
    return F.aggregate(quotes, F.lit(0), lambda n, q: n + F.size(F.filter(T.numbers(q), lambda x: T.num_equal(number, x))))


def spans_overlap(a_source: Column, a_start: Column, a_end: Column, b_source: Column, b_start: Column, b_end: Column) -> Column:
    return F.coalesce((a_source == b_source) & (a_start < b_end) & (b_start < a_end), F.lit(False))


def offset_error(lower: Column, upper: Column, unit: Column, precision: Column) -> Column:
    """What is wrong with a bounded offset, or null: unbounded, reversed, unequal_exact, unknown_unit."""
    known = unit.isin("second", "minute", "hour", "day", "week", *CALENDAR_UNITS)
    return F.when(lower.isNull() & upper.isNull(), "unbounded").when(lower > upper, "reversed").when((precision == "exact") & ~lower.eqNullSafe(upper), "unequal_exact").when(~F.coalesce(known, F.lit(False)), "unknown_unit")


def offset_seconds(value: Column, unit: Column) -> Column:
    """Seconds of a value; null for months and years, which have no fixed length."""
    per = F.try_element_at(F.create_map(*(F.lit(x) for pair in {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}.items() for x in pair)), unit)
    return value * per


def calendar_precision(value: Column) -> Column:
    """day, month or year of a calendar value; null for anything else."""
    from caseloom.functions.times import valid_date

    return F.when(valid_date(value), "day").when(value.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "month").when(value.rlike(r"^\d{4}$"), "year")


# ---- drafts and ladders


def panel_default(kind: Column, modalities: Column, charts: Column, owners: Column, scopes: Column) -> Column:
    """struct<category, includable, rule> that a reviewed panel suggests: its image kind decides, and for graphs and tables whose data they show. charts: array<struct<type, scope, clinical>>."""
    local = F.exists(scopes, lambda s: s.isin("individual", "shared")) & (F.size(owners) > 0)
    patient_data = local & ((kind == "table") | F.exists(charts, lambda c: F.coalesce(c["clinical"], F.lit(False)))) & F.forall(charts, lambda c: c["scope"].isin("individual", "multiple_individuals"))
    drawn = kind.isin("graph", "table")
    pair = lambda category, rule: F.struct(F.lit(category).alias("category"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))
    found = (
        F.when((kind == "microscopy") | F.array_contains(modalities, "microscopy"), pair("pathology", "microscopy"))
        .when(kind == "specimen_photograph", pair("pathology", "specimen_photograph"))
        .when(kind == "medical_imaging", pair("clinical_imaging", "medical_imaging"))
        .when(kind.isin(*PHOTOS), pair("clinical_photo", kind))
        .when(drawn & F.exists(charts, lambda c: c["type"] == "waveform"), pair("waveform", "waveform_chart"))
        .when(drawn & patient_data, pair("clinical_chart_of_patient_data", F.concat(kind, F.lit("_of_attributed_patient_data"))))
        .when(drawn & (~local | F.exists(charts, lambda c: c["scope"].isin("aggregate", "background"))), pair("literature_or_aggregate", F.concat(kind, F.lit("_aggregate_or_unattributed"))))
        .when(drawn, pair("other", F.concat(kind, F.lit("_unclassified"))))
        .when(kind.isin("diagram", "timeline"), pair("diagram_or_schematic", kind))
        .otherwise(pair("other", F.concat(F.lit("image_kind_"), kind)))
    )
    return let(found, lambda f: F.struct(f["category"].alias("category"), (f["category"].isin(*INCLUDABLE) & local).alias("includable"), F.concat(f["rule"], F.when(f["category"].isin(*INCLUDABLE) & ~local, "+not_attributed_to_local_patient").otherwise("")).alias("rule")))


def privacy_hints(texts: Column, photo: Column) -> Column:
    """struct<burned_in, face, sensitive> that reviewers' sentences (array) hint at; negated sentences hint at nothing."""
    plain = F.filter(texts, lambda s: ~s.rlike(r"(?i)\b(?:no|not|without|absent|none|cropped|masked)\b"))
    said = lambda p: F.exists(plain, lambda s: s.rlike(f"(?i){p}"))
    direct, device = said(r"\b(?:patient name|date of birth|medical record number|identifier)\b"), said(r"\b(?:burned[- ]in|overlay|annotation|timestamp|time stamp|device text)\b")
    return F.struct(F.when(direct, "direct_identifiers").when(device, "timestamps_or_device_text").otherwise("none").alias("burned_in"), (said(r"\b(?:face|facial|eyes)\b") & photo).alias("face"), (said(r"\b(?:genital|breast|perineum|perianal|nude)") & photo).alias("sensitive"))


def suggested_class(kind: Column, description: Column) -> Column:
    """A supplementary file's likely class from its detected type and description."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(low.rlike(r"\b(?:checklist|consent|reporting guideline|reviewer)"), "non_clinical").when(kind.isin("mp4", "mov", "avi", "webm", "matroska"), "video").when(kind.isin("png", "jpeg", "gif", "tiff", "dicom"), "image").when(kind.isin("xlsx", "xls", "csv", "tsv"), "table").when(kind.isin("pdf", "docx", "doc", "txt"), "document").otherwise("unknown")


def file_states(files: DataFrame, by: str) -> DataFrame:
    """Files (class, download_status) -> by, non_clinical (all are), any_unavailable."""
    return files.groupBy(by).agg(F.every(F.coalesce(F.col("class") == "non_clinical", F.lit(False))).alias("non_clinical"), F.bool_or(F.coalesce(F.col("download_status").isin("unavailable", "external_unavailable"), F.lit(False))).alias("any_unavailable"))


def coding_requests(facts: DataFrame, systems: DataFrame, key: str = "fact_key") -> DataFrame:
    """Facts × the systems of their task (task, system), each fact's content once a system."""
    return facts.join(systems, "task").dropDuplicates([key, "system"])


def pooled_requests(predicted: DataFrame, reference: DataFrame, by: Sequence[str], p: str, r: str, n: int = 12) -> DataFrame:
    """by..., p, batch, references: each prediction against all references of its pool, n at a time; an empty batch where the pool has none."""
    own = predicted.select(*by, p)
    numbered = reference.select(*by, F.col(r).alias("_r")).withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("_r")) - 1) / n).cast("int"))
    lots = numbered.groupBy(*by, "batch").agg(F.array_sort(F.collect_list("_r")).alias("references"))
    return own.join(lots, [*by], "left").withColumn("batch", F.coalesce("batch", F.lit(0))).withColumn("references", F.coalesce("references", F.array().cast(dict(lots.dtypes)["references"])))


def evidence_rows(facts: DataFrame, keys: Sequence[str], evidence: str, segments: DataFrame, article: str) -> DataFrame:
    """keys..., pos, segment, quote, start: each quote of a fact with its place in the segment that it names (null if it isn't there)."""
    asked = facts.select(*keys, F.posexplode(evidence).alias("pos", "_e")).select(*keys, "pos", F.col("_e.segment").alias("segment"), F.col("_e.quote").alias("quote"))
    place = segments.select(article, "segment", F.col("text").alias("_text"))
    start = F.when(F.contains("_text", F.col("quote")), F.expr("locate(quote, _text) - 1"))
    return asked.join(place, [article, "segment"], "left").select(*keys, "pos", "segment", "quote", start.alias("start"))


def source_ordered(facts: DataFrame, spans: DataFrame, by: Sequence[str], fact: str) -> DataFrame:
    """Facts with `place`, their rank by the first of their spans (segment_pos, start); ties by id, facts without spans last."""
    first = spans.groupBy(*by, fact).agg(F.min(F.struct("segment_pos", "start")).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.col("_first").asc_nulls_last(), fact)
    return facts.join(first, [*by, fact], "left").withColumn("place", F.row_number().over(order)).drop("_first")


def ledger_timeline(events: DataFrame, links: DataFrame, by: Sequence[str], event: str, fact: str) -> DataFrame:
    """Events with `facts`: the facts linked to each, in order of their links (seq), each once."""
    own = links.groupBy(*by, event, fact).agg(F.min("seq").alias("_s")).groupBy(*by, event).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", fact))), lambda x: x[fact]).alias("facts"))
    return events.join(own, [*by, event], "left").withColumn("facts", F.coalesce("facts", F.array().cast(dict(own.dtypes)["facts"])))


def valid_part(events: DataFrame, edges: DataFrame, by: Sequence[str], sound: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sound events, edges between them, and by..., kind, id, reason of what was left out."""
    ok = F.coalesce(sound, F.lit(False))
    kept = events.where(ok)
    ids = kept.select(*by, "id")
    whole = edges.join(ids.withColumnRenamed("id", "a"), [*by, "a"], "left_semi").join(ids.withColumnRenamed("id", "b"), [*by, "b"], "left_semi")
    lost = edges.join(whole.select(*by, "edge"), [*by, "edge"], "left_anti")
    audit = events.where(~ok).select(*by, F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("unsound").alias("reason")).unionByName(lost.select(*by, F.lit("edge").alias("kind"), F.col("edge").cast("string").alias("id"), F.lit("missing_event").alias("reason")))
    return kept, whole, audit


def age_text(text: Column, quotes: Column) -> Column:
    """An age phrase as its quote prints it, where the item has none: the first '13-year-old', '5 months old' or 'aged 70 years'."""
    found = F.transform(quotes, lambda q: F.regexp_extract(q, r"(?i)\b(?:\d+(?:\.\d+)?[- ](?:year|month|week|day)s?[- ]old|aged \d+ years?)\b", 0))
    return F.coalesce(F.when(T.informative(text), text), F.get(F.filter(found, lambda x: x != ""), F.lit(0)))


def unprinted_labels(panels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Panels (label, caption) whose label the caption doesn't print, or with a question mark outside quotes: keys..., issue. Nothing is rewritten."""
    from .checks import question_outside_quotes

    issues = F.filter(F.array(F.when(F.coalesce("label", F.lit("")) != "", F.when(~F.contains(F.lower("caption"), F.lower("label")), "label_not_in_caption")), F.when(question_outside_quotes(F.col("label")), "question_mark")), lambda x: x.isNotNull())
    return panels.select(*keys, F.explode(issues).alias("issue"))


def demoted(decisions: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions (disposition) whose check (holds, reason) fails become unresolved, with the reason."""
    out = decisions.join(checks.select(*keys, F.col("holds").alias("_h"), F.col("reason").alias("audit")), [*keys], "left")
    bad = (F.col("disposition") == "extracted") & ~F.coalesce("_h", F.lit(True))
    return out.withColumns({"disposition": F.when(bad, "unresolved").otherwise(F.col("disposition")), "audit": F.when(bad, F.col("audit"))}).drop("_h")


def feature_counts(items: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """by..., one count a kind, all of them, and distinct names of those with a number."""
    return items.groupBy(*by).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count("*").alias("items"), F.count_distinct(F.when(F.col("number").isNotNull(), F.lower("name"))).alias("numeric_names"))
