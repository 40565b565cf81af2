"""What a release needs: manifests and series checked, statuses by patient, drafts, owners, flat rows, selections with their reasons, arms compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.measurements import parsed_cell

from . import checks as C, nested as N, reports as P, scoring as S
from .extraction import panel_default, privacy_hints, suggested_class

# Where a sidecar may stand, weakest first.
STATES = ("not_started", "drafted", "agent_reviewed", "agent_and_parent_reviewed")


# ---- checks over joins


def manifest_errors(declared: DataFrame, manifest: DataFrame, keys: Sequence[str], domains: dict[str, Sequence[str]]) -> DataFrame:
    """keys..., error: declared files without a row, rows of no declared file, repeated ones, and values outside their domain."""
    cover = C.exact_cover(declared, manifest, keys).select(*keys, F.concat(F.col("state"), F.lit("_file")).alias("error"))
    wrong = {f"{c}_not_allowed": ~F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in domains.items()}
    return cover.unionByName(C.violation_rows(manifest, keys, wrong).select(*keys, F.col("rule").alias("error")))


def series_errors(points: DataFrame, cells: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., error of points (cell, status, magnitude, patient): unknown_cell, parse_differs from what the cell's text gives again, unknown_owner."""
    own = cells.select(F.col("cell").alias("cell"), F.col("raw").alias("_raw"))
    joined = points.join(own, "cell", "left").join(owners.select(F.col("patient"), F.lit(True).alias("_known")).distinct(), "patient", "left").withColumn("_p", parsed_cell(F.col("_raw")))
    differs = ~(F.col("_p.status").eqNullSafe(F.col("status")) & F.col("_p.measurement.magnitude").eqNullSafe(F.col("magnitude")))
    rules = {"unknown_cell": F.col("_raw").isNull(), "parse_differs": F.col("_raw").isNotNull() & differs, "unknown_owner": F.col("patient").isNotNull() & F.col("_known").isNull()}
    return C.violation_rows(joined, keys, rules).select(*keys, F.col("rule").alias("error"))


def chunk_errors(chunks: DataFrame, propositions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., segment, error: segments of a chunk that no proposition cites, cited ones that it lacks, and quotes that their segment doesn't hold."""
    own = chunks.select(*by, "segment", F.col("text").alias("_text"))
    cited = propositions.join(own, [*by, "segment"], "left")
    unheld = cited.where(F.col("_text").isNull() | ~F.contains("_text", F.col("quote"))).select(*by, "segment", F.when(F.col("_text").isNull(), "unknown_segment").otherwise("quote_not_literal").alias("error"))
    uncited = own.join(propositions.select(*by, "segment").distinct(), [*by, "segment"], "left_anti").select(*by, "segment", F.lit("uncited_segment").alias("error"))
    return unheld.unionByName(uncited)


def frozen_errors(frozen: DataFrame, articles: DataFrame, key: str, sha: str) -> DataFrame:
    """key, error: articles without a frozen row, frozen rows of no article, repeated ones, and other hashes."""
    cover = C.exact_cover(articles, frozen, [key]).select(key, F.col("state").alias("error"))
    both = frozen.select(key, F.col(sha).alias("_f")).join(articles.select(key, F.col(sha).alias("_a")), key)
    return cover.unionByName(both.where(~F.col("_f").eqNullSafe(F.col("_a"))).select(key, F.lit("other_hash").alias("error")))


def unprotected(before: DataFrame, after: DataFrame, challenges: DataFrame, key: str) -> DataFrame:
    """key, error: facts (key, value as JSON) that are gone, or changed outside the pointers they were challenged on (key, pointer)."""
    allowed = challenges.groupBy(key).agg(F.collect_set("pointer").alias("_allowed"))
    both = before.select(key, F.col("value").alias("_b")).join(after.select(key, F.col("value").alias("_a")), key, "left").join(allowed, key, "left")
    changed = N.protected_changes(F.col("_b"), F.col("_a"), F.coalesce("_allowed", F.array().cast("array<string>")))
    told = both.withColumn("_changed", changed)
    return told.select(key, F.when(F.col("_a").isNull(), "gone").when(F.size("_changed") > 0, "changed").alias("error")).where("error is not null")


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    """Violations (of equal columns) of several checkers as one frame, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# ---- statuses and owners


def weakest_state(state: Column) -> Column:
    """Of a group's states the one that came least far; an unknown state is not_started."""
    place = F.greatest(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(1))
    return F.get(F.array(*map(F.lit, STATES)), (F.min(place) - 1).cast("int"))


def sidecar_status(sidecars: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], state: str) -> DataFrame:
    """by..., one column a kind of sidecar: the weakest state of its rows, not_started without any."""
    each = sidecars.groupBy(*by, kind).agg(weakest_state(F.col(state)).alias("_s"))
    return each.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col(kind) == k, F.col("_s"))), F.lit(STATES[0])).alias(k) for k in kinds))


def patient_status(panels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Panels (owners array, includable, state) -> by..., patient, panels, includable, state (the weakest)."""
    own = panels.select(*by, F.explode("owners").alias("patient"), "includable", "state")
    return own.groupBy(*by, "patient").agg(F.count("*").alias("panels"), F.count_if("includable").alias("includable"), weakest_state(F.col("state")).alias("state"))


def owned_facts(records: DataFrame, patients: DataFrame, article: str) -> DataFrame:
    """Facts (patient_ids array) once for each owner that the article has; facts without owners stay out."""
    return records.withColumn("patient", F.explode("patient_ids")).join(patients.select(article, "patient").distinct(), [article, "patient"], "left_semi")


def patient_media(figures: DataFrame, reviews: DataFrame, article: str) -> DataFrame:
    """Figures with each patient that a review gives them, and `status`: attributed, shared (several patients) or unreviewed (no review; patient is null)."""
    n = reviews.groupBy(article, "figure").agg(F.count_distinct("patient").alias("_n"))
    out = figures.join(reviews.select(article, "figure", "patient").distinct(), [article, "figure"], "left").join(n, [article, "figure"], "left")
    return out.withColumn("status", F.when(F.col("patient").isNull(), "unreviewed").when(F.col("_n") > 1, "shared").otherwise("attributed")).drop("_n")


def bundles_of(bundles: DataFrame, articles: DataFrame, id_: str, article: str) -> DataFrame:
    """Bundles whose id begins with 'article:', with that article, by an equi-join on the part before the first colon."""
    return bundles.withColumn(article, F.substring_index(id_, ":", 1)).where(F.contains(id_, F.lit(":"))).join(articles.select(article), article, "left_semi")


def authors(sources: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """key, attribution: the source's own authors, else the metadata's, else its journal, else 'unknown'."""
    both = sources.select(key, F.col("authors").alias("_own")).join(metadata.select(key, "authors", "journal"), key, "left")
    named = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(c, "; "))
    return both.select(key, F.coalesce(named(F.col("_own")), named(F.col("authors")), F.nullif("journal", F.lit("")), F.lit("unknown")).alias("attribution"))


# ---- drafts and flat rows


def draft_labels(panels: DataFrame) -> DataFrame:
    """Panels (kind, modalities, charts, owners, scopes, texts) with the label that they suggest and flags that their texts hint at."""
    own = panels.withColumn("default", panel_default(*(F.col(c) for c in ("kind", "modalities", "charts", "owners", "scopes"))))
    return own.withColumn("flags", privacy_hints(F.col("texts"), F.col("kind").isin("clinical_photograph", "operative_photograph")))


def draft_manifest(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., suggested class, includable and review (nothing decided) of acquired files (type, description); of one key the first by type."""
    first = files.groupBy(*keys).agg(F.min(F.struct("type", "description")).alias("_f"))
    return first.select(*keys, suggested_class(F.col("_f.type"), F.col("_f.description")).alias("suggested_class"), F.lit(None).cast("boolean").alias("includable"), F.lit("unreviewed").alias("review"))


def panel_rows(figures: DataFrame, article: str) -> DataFrame:
    """Figures with nested panels (records.figures()) as one flat row a panel."""
    return figures.select(article, "figure", F.explode("panels").alias("p")).select(article, "figure", "p.*")


def flag_map(flags: DataFrame, by: Sequence[str], panel: str, value: str) -> DataFrame:
    """by..., flags: map of panel to value, the last by value where a panel repeats; null panels are _whole."""
    own = flags.groupBy(*by, F.coalesce(F.col(panel), F.lit("_whole")).alias("_p")).agg(F.max(value).alias("_v"))
    return own.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "_v")))).alias("flags"))


def document_vocabulary(rows: DataFrame, id_: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """id, words: map of each document's words to their counts."""
    words = rows.select(F.col(id_), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))).alias("w"))
    return words.groupBy(id_, "w").agg(F.count("*").alias("n")).groupBy(id_).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("words"))


# ---- selections and arms


def selection(candidates: DataFrame, rules: dict[str, Column], id_: str, choose) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen rows (choose(eligible) has `seat`), excluded ids with their reasons, and eligible ids that weren't chosen."""
    judged = candidates.withColumn("reasons", C.broken(rules))
    eligible = judged.where(F.size("reasons") == 0).drop("reasons")
    chosen = choose(eligible)
    return chosen, judged.where(F.size("reasons") > 0).select(id_, "reasons"), eligible.select(id_).join(chosen.select(id_), id_, "left_anti")


def matched_twice(pairs: DataFrame, by: Sequence[str], left: str, right: str, weight: str, later: Column) -> DataFrame:
    """Best one-to-one matching of the pairs that aren't `later`, then of the later ones among what that left."""
    tagged = pairs.withColumn("_later", F.coalesce(later, F.lit(False)))
    main = S.assigned(tagged.where("not _later"), by, left, right, weight)
    rest = tagged.where("_later").join(main.select(*by, left), [*by, left], "left_anti").join(main.select(*by, right), [*by, right], "left_anti")
    return main.withColumn("phase", F.lit(1)).unionByName(S.assigned(rest, by, left, right, weight).withColumn("phase", F.lit(2)))


def grounded(tp: Column, fp: Column, fn: Column, critical: Column) -> Column:
    """Scores in which a match with a critical error is both wrong and missed."""
    return S.prf(tp - critical, fp + critical, fn + critical)


def search_reward(fbeta: Column, grounded_fbeta: Column, precision: Column, control_precision: Column, floor: float, most_drop: float, regressed: Column, kept: Column, valid: Column) -> Column:
    """A dense signal, at least -2: the mean of both F, less twice the precision's deficit, the share of regressions and the share of invalid runs."""
    deficit = F.greatest(F.lit(0.0), F.greatest(F.lit(floor), control_precision - most_drop) - precision)
    return F.greatest(F.lit(-2.0), 0.5 * (fbeta + grounded_fbeta) - 2 * deficit - regressed / F.greatest(F.lit(1), kept) - (1 - valid))


def arm_report(rows: DataFrame, arm: str, split: str, id_: str, measures: Sequence[Column], arms: int) -> DataFrame:
    """Measures of each arm, of all splits (split null) and by split, on all ids and on those that every arm has (matched)."""
    every = P.leveled(rows, [(arm,), (arm, split)], measures).withColumn("matched", F.lit(False))
    same = P.leveled(P.matched_arms(rows, arm, id_, arms), [(arm,), (arm, split)], measures).withColumn("matched", F.lit(True))
    return every.unionByName(same)
