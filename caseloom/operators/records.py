"""Nested article records and FHIR resources from flat frames: joins, groups and rule ladders; nothing is made up.

Facts have article, patient, task, collection, pos and the columns of FACT (all strings but number); unknown values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.labels import stable_id

from .nested import owners, term

FACT = ("name", "substance", "attribute", "action_text", "event", "text_value", "subject", "assertion", "action", "status", "clinical_status", "verification_status", "kind", "scope", "category", "reaction_type", "relative", "body_site", "unit", "comparator", "scoring")
#: Systems and statuses of the target format.
CLINICAL, CERTAINTY = "http://terminology.hl7.org/CodeSystem/condition-clinical", "http://terminology.hl7.org/CodeSystem/condition-ver-status"
OBSERVED = ("observations", "symptoms_function", "demographics", "social_exposures", "reproductive_perinatal", "outcomes")


def assignments_of(panels: DataFrame, assignments: DataFrame) -> DataFrame:
    """Panels (article, figure, panel) with `assignments` (array of the other columns): those of the panel, and those without a panel, which hold for every panel of the figure."""
    rest = [c for c in assignments.columns if c not in ("article", "figure", "panel")]
    own = assignments.where("panel is not null").join(panels.select("article", "figure", "panel"), ["article", "figure", "panel"])
    every = assignments.where("panel is null").drop("panel").join(panels.select("article", "figure", "panel"), ["article", "figure"])
    both = own.unionByName(every.select(*own.columns)).groupBy("article", "figure", "panel").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("assignments"))
    # null panels are whole figures and equal to each other
    whole = panels.join(both.withColumnsRenamed({"article": "_a", "figure": "_f", "panel": "_p"}), F.col("article").eqNullSafe(F.col("_a")) & F.col("figure").eqNullSafe(F.col("_f")) & F.col("panel").eqNullSafe(F.col("_p")), "left")
    alone = assignments.where("panel is null").groupBy("article", "figure").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_whole"))
    return whole.drop("_a", "_f", "_p").join(alone, ["article", "figure"], "left").withColumn("assignments", F.coalesce("assignments", "_whole", F.array().cast(dict(both.dtypes)["assignments"]))).drop("_whole")


def figures(figures_: DataFrame, panels: DataFrame, assignments: DataFrame, labels: DataFrame, flags: DataFrame) -> DataFrame:
    """One row a figure with `panels`: each with its key, owners, label and flags (the last one of a panel counts; null panels meet null panels) and their statuses."""
    key = lambda df: df.withColumn("_p", F.coalesce("panel", F.lit("_whole"))).drop("panel")
    last = lambda df, name: key(df).groupBy("article", "figure", "_p").agg(F.max_by(F.struct(*(c for c in df.columns if c not in ("article", "figure", "panel"))), F.col("pos")).alias(name))
    p = assignments_of(panels, assignments).withColumn("_p", F.coalesce("panel", F.lit("_whole")))
    p = p.join(last(labels, "label"), ["article", "figure", "_p"], "left").join(last(flags, "flags"), ["article", "figure", "_p"], "left")
    state = lambda c, name: F.when(F.col(c).isNotNull(), "reviewed").otherwise(f"panel_missing_from_{name}")
    entry = F.struct(F.concat_ws("/", "figure", "_p").alias("panel_key"), "panel", owners(F.transform("assignments", lambda a: a["patients"])).alias("patients"), "label", state("label", "labels").alias("label_status"), "flags", state("flags", "flags").alias("flags_status"))
    nested = p.groupBy("article", "figure").agg(F.sort_array(F.collect_list(entry)).alias("panels"))
    return figures_.join(nested, ["article", "figure"], "left")


def supplements(declared: DataFrame, files: DataFrame, reviews: DataFrame) -> DataFrame:
    """Declared supplements (article, supplement) with `files` (array), `reviewed` and `media_available` (null without files, false if all are unavailable)."""
    own = files.groupBy("article", "supplement").agg(F.sort_array(F.collect_list(F.struct(*(c for c in files.columns if c not in ("article", "supplement"))))).alias("files"), (~F.every(F.col("download_status").isin("unavailable", "external_unavailable"))).alias("media_available"))
    return declared.join(own, ["article", "supplement"], "left").join(reviews.select("article", "supplement").distinct().withColumn("reviewed", F.lit(True)), ["article", "supplement"], "left").na.fill(False, ["reviewed"])


def unavailable_media(figures_: DataFrame, supplements_: DataFrame) -> DataFrame:
    """article, kind, id, reason of media that can't be had."""
    row = lambda df, kind, reason: df.where("media_available = false").select("article", F.lit(kind).alias("kind"), F.col(kind).alias("id"), F.lit(reason).alias("reason"))
    return row(figures_, "figure", "no_declared_asset").unionByName(row(supplements_, "supplement", "external_link_no_declared_asset"))


def unified(articles: DataFrame, patients: DataFrame, facts: DataFrame, events: DataFrame) -> DataFrame:
    """Articles with `patients`: an array of structs with sections (map of task to ordered facts) and ordered events. Articles without patients have none."""
    own = lambda df, drop: [c for c in df.columns if c not in drop]
    sections = facts.groupBy("article", "patient", "task").agg(F.array_sort(F.collect_list(F.struct("pos", *own(facts, ("article", "patient", "task", "pos"))))).alias("items"))
    sections = sections.groupBy("article", "patient").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "items")))).alias("sections"))
    line = events.groupBy("article", "patient").agg(F.array_sort(F.collect_list(F.struct("pos", *own(events, ("article", "patient", "pos"))))).alias("events"))
    p = patients.join(sections, ["article", "patient"], "left").join(line, ["article", "patient"], "left")
    nested = p.groupBy("article").agg(F.sort_array(F.collect_list(F.struct("patient", F.to_json(F.struct(*own(p, ("article", "patient")))).alias("record")))).alias("patients"))
    return articles.join(nested, "article", "left").withColumn("patients", F.coalesce("patients", F.array().cast("array<struct<patient:string,record:string>>")))


def export_gate(candidates: DataFrame, split: str = "split") -> DataFrame:
    """Rows that are completed, placed by their split."""
    return candidates.where("completed").repartition(split)


def fact_key(article: Column, patient: Column, task: Column, collection: Column, fields: Sequence[str]) -> Column:
    """A digest of a fact's place and content, whatever its position."""
    own = {"article": article, "patient": patient, "task": task, "collection": collection} | {f: F.col(f) for f in fields}
    return F.sha2(F.to_json(F.struct(*(own[k].alias(k) for k in sorted(own)))), 256)


def fact_entries(facts: DataFrame) -> DataFrame:
    """Facts with `fact_key`, `pointer` and `duplicate` (all but the first of equal content)."""
    keyed = facts.withColumn("fact_key", fact_key(F.col("article"), F.col("patient"), F.col("task"), F.col("collection"), [*FACT, "number"])).withColumn("pointer", F.concat_ws("/", F.lit(""), F.lit("sections"), "task", "collection", "pos"))
    return keyed.withColumn("duplicate", F.row_number().over(Window.partitionBy("article", "patient", "fact_key").orderBy("pos")) > 1)


def _coded(system: str, value: Column) -> Column:
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), value.alias("code"))).alias("coding"))


def resource_kind(r: str = "") -> Column:
    """struct<resource, status, intent, reason> of a fact: the target type, or why it is deferred. An ordered ladder; nothing negated becomes something done."""
    c = lambda n: F.col(f"{r}{n}")
    task, action, assertion = c("task"), F.coalesce(c("action"), F.lit("")), c("assertion")
    family = (task == "family_genetics") & (c("kind") == "family_condition")
    asked = action.isin("ordered", "planned")
    intent = F.when(action == "ordered", "order").otherwise("plan")
    made = lambda kind, status=F.lit(None).cast("string"), intent=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("resource"), status.alias("status"), intent.alias("intent"), F.lit(None).cast("string").alias("reason"))
    put_off = lambda why: F.struct(F.lit(None).cast("string").alias("resource"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("intent"), F.lit(why).alias("reason"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    told = lambda m, x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in m.items() for v in pair)), x), F.lit("unknown"))
    observed = task.isin(*OBSERVED) | ((task == "oncology") & (c("collection") == "biomarkers"))
    test = yes((task == "observations") & c("status").isin("ordered", "planned"))
    rules = [
        (yes(c("scoring") == "review_only"), put_off("review_only_or_quarantined")),
        (~yes(c("subject") == "index_patient") & ~yes(family), put_off("subject_is_not_index_patient")),
        (yes(assertion.isin("conditional", "unknown")), put_off("conditional_or_unknown_assertion")),
        (yes((task == "conditions") & (assertion == "possible") & c("verification_status").isin("confirmed", "refuted")), put_off("contradictory_assertion_and_certainty")),
        (yes(task == "conditions"), made("Condition")),
        (~yes(assertion == "present"), put_off("nonaffirmative_fact_requires_specialized_mapping")),
        (yes((task == "medications") & asked), made("MedicationRequest", F.lit("unknown"), intent)),
        (yes(task == "medications"), made("MedicationStatement", told({"current": "active", "held": "on-hold", "stopped": "stopped", "declined": "not-taken"}, action))),
        (yes((task == "procedures_devices") & (c("kind") == "device")), put_off("device_event_requires_device_lifecycle_mapping")),
        (yes((task == "procedures_devices") & asked), made("ServiceRequest", F.lit("unknown"), intent)),
        (yes(task == "procedures_devices"), made("Procedure", told({"completed": "completed", "declined": "not-done", "cancelled": "not-done"}, action))),
        (test, made("ServiceRequest", F.lit("unknown"), F.when(c("status") == "ordered", "order").otherwise("plan"))),
        (yes(observed), made("Observation", F.lit("unknown"))),
        (yes((task == "allergies") & (~yes(c("scope") == "specific_substance") | yes(c("reaction_type") == "adverse_effect"))), put_off("scoped_allergy_or_adverse_effect_requires_review")),
        (yes(task == "allergies"), made("AllergyIntolerance")),
        (yes(family & c("relative").isNull()), put_off("family_relationship_unresolved")),
        (yes(family), made("FamilyMemberHistory", F.lit("partial"))),
        (yes(task == "care_plans"), made("CarePlan", F.when(action == "completed", "completed").otherwise("unknown"), F.when(action == "recommended", "proposal").otherwise("plan"))),
    ]
    out = F.when(F.lit(False), put_off(""))
    for holds, entry in rules:
        out = out.when(holds, entry)
    return out.otherwise(put_off("specialized_mapping_not_implemented"))


def mapped_facts(facts: DataFrame, literal: Column | None = None) -> DataFrame:
    """Facts -> article, patient, fact_key, pointer, task, status (mapped or deferred), reason, id (name-based), resource (JSON).

    Copies and facts without literal evidence are deferred first. A resource holds the fact's own words and values, its subject and nothing else.
    """
    e = fact_entries(facts).withColumn("_m", resource_kind())
    sound = F.lit(True) if literal is None else F.coalesce(literal, F.lit(False))
    reason = F.when(F.col("duplicate"), "exact_duplicate").when(~sound, "missing_or_nonliteral_evidence").otherwise(F.col("_m.reason"))
    own = {n: F.col(n) for n in ("name", "substance", "attribute", "action_text", "event", "text_value")}
    text = F.struct(term(own, F.col("task")).alias("text"))
    subject = F.struct(F.concat(F.lit("urn:uuid:"), stable_id(F.col("article"), F.col("patient"), F.lit("Patient"))).alias("reference"))
    kind = F.col("_m.resource")
    only = lambda kinds, x: F.when(kind.isin(*kinds), x)
    certainty = F.when(F.col("assertion") == "absent", "refuted").when((F.col("assertion") == "possible") & (F.coalesce("verification_status", F.lit("unknown")) == "unknown"), "unconfirmed").when(F.col("verification_status") != "unknown", F.col("verification_status"))
    number = F.col("number").isNotNull() & (F.coalesce("comparator", F.lit("=")) != "unknown")
    resource = F.to_json(F.struct(
        kind.alias("resourceType"),
        F.when(~kind.isin("AllergyIntolerance", "FamilyMemberHistory"), subject).alias("subject"),
        only(("AllergyIntolerance", "FamilyMemberHistory"), subject).alias("patient"),
        F.col("_m.status").alias("status"), F.col("_m.intent").alias("intent"),
        only(("Condition", "Procedure", "ServiceRequest", "Observation", "AllergyIntolerance"), text).alias("code"),
        only(("MedicationRequest", "MedicationStatement"), text).alias("medicationCodeableConcept"),
        only(("CarePlan",), F.col("action_text")).alias("description"),
        only(("FamilyMemberHistory",), F.struct(F.col("relative").alias("text"))).alias("relationship"),
        only(("FamilyMemberHistory",), F.array(F.struct(text.alias("code")))).alias("condition"),
        F.when((kind == "Condition") & certainty.isNotNull(), _coded(CERTAINTY, certainty)).alias("verificationStatus"),
        F.when((kind == "Condition") & (F.col("assertion") == "present") & (F.col("clinical_status") != "unknown"), _coded(CLINICAL, F.col("clinical_status"))).alias("clinicalStatus"),
        F.when((kind == "Observation") & number, F.struct(F.col("number").alias("value"), F.col("unit"), F.when(F.col("comparator").isin("<", "<=", ">", ">="), F.col("comparator")).alias("comparator"))).alias("valueQuantity"),
        F.when((kind == "Observation") & ~number, F.col("text_value")).alias("valueString"),
        F.when((kind == "Observation") & F.col("body_site").isNotNull(), F.struct(F.col("body_site").alias("text"))).alias("bodySite"),
    ))
    rows = e.withColumn("_why", reason)
    done = F.col("_why").isNull()
    return rows.select("article", "patient", "fact_key", "pointer", "task", F.when(done, "mapped").otherwise("deferred").alias("status"), F.col("_why").alias("reason"), F.when(done, stable_id(F.col("article"), F.col("patient"), kind, F.col("fact_key"))).alias("id"), F.when(done, resource).alias("resource"))


def bundles(mapped: DataFrame, patients: DataFrame) -> DataFrame:
    """One row a patient: id, entries (sorted ids and resources, its own Patient first), mapped, deferred; patients without facts have their own entry alone."""
    own = mapped.groupBy("article", "patient").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "mapped", F.struct("id", "resource")))).alias("_e"), F.count_if(F.expr("status = 'mapped'")).alias("mapped"), F.count_if(F.expr("status = 'deferred'")).alias("deferred"))
    who = stable_id(F.col("article"), F.col("patient"), F.lit("Patient"))
    first = F.struct(who.alias("id"), F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.array(F.struct(who.alias("value"))).alias("identifier"))).alias("resource"))
    out = patients.select("article", "patient").distinct().join(own, ["article", "patient"], "left")
    return out.select("article", "patient", stable_id(F.col("article"), F.col("patient"), F.lit("bundle")).alias("id"), F.concat(F.array(first), F.coalesce("_e", F.array().cast("array<struct<id:string,resource:string>>"))).alias("entries"), F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("deferred", F.lit(0)).alias("deferred"))


def bundle_errors(entries: DataFrame, references: DataFrame) -> DataFrame:
    """Frames (bundle, id, kind) and (bundle, target) -> bundle, error: repeated_id, patient_count or dangling_reference."""
    same = entries.groupBy("bundle", "id").agg(F.count("*").alias("n")).where("n > 1").select("bundle", F.lit("repeated_id").alias("error"))
    alone = entries.groupBy("bundle").agg(F.count_if(F.expr("kind = 'Patient'")).alias("n")).where("n <> 1").select("bundle", F.lit("patient_count").alias("error"))
    loose = references.join(entries.select("bundle", F.concat(F.lit("urn:uuid:"), "id").alias("target")), ["bundle", "target"], "left_anti").select("bundle", F.lit("dangling_reference").alias("error"))
    return same.unionByName(alone).unionByName(loose).distinct()


def quantity_value(magnitude: Column) -> Column:
    """A magnitude as a double if it stands for the same decimal number, else null: nothing is rounded silently."""
    d = magnitude.try_cast("double")
    plain = magnitude.try_cast("decimal(38,18)")
    return F.when(plain.isNotNull() & (d.cast("string").try_cast("decimal(38,18)") == plain), d)


def approved_codings(requests: DataFrame, receipts: DataFrame, allow_unreviewed: bool = False) -> DataFrame:
    """Requests (request, candidates array) with the coding of their latest receipt (request, seq, choice, equivalence, approved) if it is a candidate, equivalent and approved."""
    last = receipts.groupBy("request").agg(F.max_by(F.struct("choice", "equivalence", "approved"), "seq").alias("_r"))
    good = F.array_contains("candidates", F.col("_r.choice")) & (F.col("_r.equivalence") == "equivalent") & (F.lit(allow_unreviewed) | F.coalesce("_r.approved", F.lit(False)))
    return requests.join(last, "request", "left").select(*requests.columns, F.when(good, F.col("_r.choice")).alias("coding"))
