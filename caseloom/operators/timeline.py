"""Events in time: sparse candidate pairs, order constraints, their closure, layers and conflicts, ids and ledgers.

Frames have one row an event or edge, with the columns that group them (one record, patient or conversation). Windows are partitioned by
those, so a group is one task's; proposals for pairs grow with events, never with their square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components, cut

# Kinds of events that bridge others, reasons of a pair in the order in which they are proposed.
CORE_KINDS = ("presentation", "diagnosis", "treatment", "adverse_event", "outcome", "follow_up")
REASONS = ("relative_phrase", "neighbouring_date", "shared_anchor", "clinical_anchor", "neighbour")


def candidate_pairs(events: DataFrame, by: Sequence[str], id_: str, order: Sequence[Column | str], anchors: Column | None = None, date: str | None = None, kind: str | None = None, phrases: DataFrame | None = None, neighbors: int = 16, per_event: int = 32, bridge_matches: int = 4) -> DataFrame:
    """by..., left, right (in source order), reasons: pairs of a group's events worth comparing, at most per_event times its events.

    Proposals, in this order: events that a relative phrase names (phrases: by..., id, words; the nearest bridge_matches whose words hold
    them), first events of neighbouring dates, neighbours that share an anchor (array), the nearest event of each core kind on both sides,
    and the `neighbors` events before. A pair keeps all its reasons; the budget goes to the earlier proposals. See omitted_pairs().
    """
    at = Window.partitionBy(*by).orderBy(*order, id_)
    extra = [F.coalesce(anchors, F.array()).alias("_anchors")] if anchors is not None else []
    e = events.select(*by, F.col(id_).alias("_id"), F.row_number().over(at).alias("_pos"), *extra, *([F.col(date).alias("_date")] if date else []), *([F.col(kind).alias("_kind")] if kind else []), *([F.col("words").alias("_words")] if phrases is not None else []))
    e = cut(e)
    proposals = []

    def propose(df: DataFrame, reason: str, a: str = "a", b: str = "b") -> None:
        proposals.append(df.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(REASONS.index(reason)).alias("reason"), F.greatest(a, b).alias("turn")))

    if phrases is not None:
        named = phrases.select(*by, F.col("id").alias("_from"), F.col("words").alias("_wanted")).join(e.select(*by, F.col("_id").alias("_from"), F.col("_pos").alias("a")), [*by, "_from"])
        # the rarest way in: the phrase's first word; the others are checked on the found rows
        found = named.withColumn("_word", F.get("_wanted", F.lit(0))).join(e.select(*by, F.col("_pos").alias("b"), F.explode(F.array_distinct("_words")).alias("_word"), "_words"), [*by, "_word"])
        found = found.where((F.col("a") != F.col("b")) & (F.size(F.array_except("_wanted", "_words")) == 0))
        near = Window.partitionBy(*by, "a", "_wanted").orderBy(F.abs(F.col("a") - F.col("b")), "b")
        propose(found.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= bridge_matches), "relative_phrase")
    if date:
        first = e.where("_date is not null").groupBy(*by, "_date").agg(F.min("_pos").alias("a"))
        propose(first.withColumn("b", F.lead("a").over(Window.partitionBy(*by).orderBy("_date"))), "neighbouring_date")
    if anchors is not None:
        shared = e.select(*by, F.col("_pos").alias("a"), F.explode(F.array_distinct("_anchors")).alias("_anchor"))
        propose(shared.withColumn("b", F.lead("a").over(Window.partitionBy(*by, "_anchor").orderBy("a"))), "shared_anchor")
    if kind:
        own = F.col("_pos")
        near = []
        for k in CORE_KINDS:
            here = F.when(F.col("_kind") == k, own)
            near += [F.last(here, True).over(Window.partitionBy(*by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.first(here, True).over(Window.partitionBy(*by).orderBy("_pos").rowsBetween(1, Window.unboundedFollowing))]
        propose(e.select(*by, own.alias("a"), F.array(*near).alias("_near")).select(*by, "a", F.explode("_near").alias("b")), "clinical_anchor")
    if neighbors:
        back = F.sequence(F.greatest(F.col("_pos") - neighbors, F.lit(1)), F.col("_pos") - 1)
        propose(e.where("_pos > 1").select(*by, F.col("_pos").alias("a"), F.explode(back).alias("b")), "neighbour")
    every = proposals[0]
    for p in proposals[1:]:
        every = every.unionByName(p)
    pairs = every.groupBy(*by, "a", "b").agg(F.min(F.struct("reason", "turn")).alias("first"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    sizes = e.groupBy(*by).agg((F.count("*") * per_event).alias("_budget"))
    rank = Window.partitionBy(*by).orderBy("first", "a", "b")
    kept = pairs.withColumn("_k", F.row_number().over(rank)).join(sizes, [*by]).where("_k <= _budget")
    name = lambda side: e.select(*by, F.col("_pos").alias("a" if side == "left" else "b"), F.col("_id").alias(side))
    labels = F.array(*map(F.lit, REASONS))
    return kept.join(name("left"), [*by, "a"]).join(name("right"), [*by, "b"]).select(*by, "left", "right", F.transform("reasons", lambda r: F.get(labels, r)).alias("reasons"))


def omitted_pairs(events: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., n_events, total_pairs, candidate_pairs, unassessed_pairs: what candidate_pairs() leaves undecided, counted."""
    n = events.groupBy(*by).agg(F.count("*").alias("n_events")).withColumn("total_pairs", F.expr("n_events * (n_events - 1) div 2"))
    out = n.join(pairs.groupBy(*by).agg(F.count("*").alias("candidate_pairs")), [*by], "left").na.fill(0, ["candidate_pairs"])
    return out.withColumn("unassessed_pairs", F.col("total_pairs") - F.col("candidate_pairs"))


def in_scope(edges: DataFrame, allowed: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """Edges whose unordered pair is allowed, and the others."""
    key = [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]
    pairs = allowed.select(*by, *key).distinct()
    keyed = edges.select("*", *key)
    drop = lambda df: df.drop("_x", "_y")
    return drop(keyed.join(pairs, [*by, "_x", "_y"], "left_semi")), drop(keyed.join(pairs, [*by, "_x", "_y"], "left_anti"))


def closure(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., a, b of all pairs that a path of edges joins: path lengths double each round until nothing is new, lineage cut."""
    seen = cut(edges.select(*by, "a", "b").where("a is not null and b is not null").distinct())
    n = seen.count()
    while True:
        onward = seen.select(*by, F.col("a").alias("b"), F.col("b").alias("c"))
        seen = cut(seen.join(onward, [*by, "b"]).select(*by, "a", F.col("c").alias("b")).unionByName(seen).distinct())
        before, n = n, seen.count()
        if n == before:
            return seen


def same_time_groups(events: DataFrame, edges: DataFrame, id_: str = "id") -> DataFrame:
    """id, group (the least id) of events that edges of same_time join; ids are unique in the whole frame."""
    met = components(edges.where("relation = 'same_time'").select("a", "b"))
    return events.select(F.col(id_).alias("id")).join(met.select(F.col("node").alias("id"), F.col("component").alias("group")), "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def relative_order(events: DataFrame, edges: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Frames (by..., id) and (by..., a, b, relation: before, after or same_time) -> events with group and layer, and pairs (by..., a, b).

    A layer is one more than the highest of the groups before it (null in a cycle). Pairs hold all that comes before something.
    """
    groups = cut(same_time_groups(events, edges))
    named = lambda c: groups.select(F.col("id").alias(c), F.col("group").alias(f"g{c}"))
    arcs = edges.where("relation in ('before', 'after')").select(*by, F.when(F.col("relation") == "after", F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("relation") == "after", F.col("a")).otherwise(F.col("b")).alias("b"))
    arcs = cut(arcs.join(named("a"), "a").join(named("b"), "b").select(*by, F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
    reach = closure(arcs, by)
    cyclic = reach.where("a = b").select(F.col("a").alias("group")).withColumn("cyclic", F.lit(True))
    # longest paths: a group's layer is lifted until no arc lifts one; cycles are left out
    sound = cut(arcs.join(cyclic.select(F.col("group").alias("a")), "a", "left_anti").join(cyclic.select(F.col("group").alias("b")), "b", "left_anti"))
    layer = cut(groups.select("group").distinct().withColumn("layer", F.lit(0)))
    while True:
        lifted = sound.join(layer.select(F.col("group").alias("a"), "layer"), "a").groupBy(F.col("b").alias("group")).agg((F.max("layer") + 1).alias("least"))
        after = cut(layer.join(lifted, "group", "left").select("group", F.greatest("layer", F.coalesce("least", F.lit(0))).alias("layer"), (F.coalesce("least", F.lit(0)) > F.col("layer")).alias("moved")))
        if after.where("moved").isEmpty():
            break
        layer = after.drop("moved")
    placed = events.select(*by, "id").join(groups, "id").join(layer, "group").join(cyclic, "group", "left")
    out = placed.select(*by, "id", "group", F.when(F.col("cyclic").isNull(), F.col("layer")).alias("layer"))
    member = lambda c: groups.select(F.col("group").alias(f"g{c}"), F.col("id").alias(c))
    pairs = reach.select(*by, F.col("a").alias("ga"), F.col("b").alias("gb")).join(member("a"), "ga").join(member("b"), "gb").select(*by, "a", "b")
    return out, pairs


def incomparable_pairs(events: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., n_pairs, n_ordered, n_incomparable: pairs are counted, not listed, as they grow with the square of a group. Events of one group count as ordered."""
    n = events.groupBy(*by).agg(F.count("*").alias("n")).withColumn("n_pairs", F.expr("n * (n - 1) div 2"))
    tied = events.groupBy(*by, "group").agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum(F.expr("k * (k - 1) div 2")).alias("n_tied"))
    ordered = pairs.where("a <> b").select(*by, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().groupBy(*by).agg(F.count("*").alias("n_before"))
    out = n.join(tied, [*by]).join(ordered, [*by], "left").na.fill(0, ["n_before"])
    return out.select(*by, "n_pairs", (F.col("n_before") + F.col("n_tied")).alias("n_ordered"), (F.col("n_pairs") - F.col("n_before") - F.col("n_tied")).alias("n_incomparable"))


def conflicting_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges (by..., edge, a, b, relation) that lie in a strict cycle: both ends reach each other over before, after and same_time, and a strict edge does so too."""
    turned = edges.where("relation in ('before', 'after', 'same_time')").select(*by, "edge", "relation", F.when(F.col("relation") == "after", F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("relation") == "after", F.col("a")).otherwise(F.col("b")).alias("b"))
    both = turned.unionByName(turned.where("relation = 'same_time'").select(*by, "edge", "relation", F.col("b").alias("a"), F.col("a").alias("b")))
    reach = cut(closure(both, by))
    back = reach.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    mutual = reach.join(back, [*by, "a", "b"], "left_semi")
    strict = turned.where("relation <> 'same_time'").join(mutual, [*by, "a", "b"], "left_semi").select(*by, "a").distinct()
    # all that a member of a strict cycle reaches and is reached by
    inside = mutual.join(strict, [*by, "a"]).select(*by, F.col("b").alias("node")).unionByName(strict.select(*by, F.col("a").alias("node"))).distinct()
    return turned.join(mutual, [*by, "a", "b"], "left_semi").join(inside.select(*by, F.col("node").alias("a")), [*by, "a"], "left_semi").select(*by, "edge").distinct()


def renumbered(events: DataFrame, edges: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """Events (by..., id) as e1, e2, ... in order, and edges (by..., edge, a, b) as edge1, ... with their ends renamed."""
    named = events.withColumn("_new", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(*by).orderBy(*order, "id"))))
    end = lambda c: named.select(*by, F.col("id").alias(c), F.col("_new").alias(f"_{c}"))
    moved = edges.join(end("a"), [*by, "a"]).join(end("b"), [*by, "b"]).withColumn("_edge", F.concat(F.lit("edge"), F.row_number().over(Window.partitionBy(*by).orderBy("edge"))))
    rest = [c for c in edges.columns if c not in (*by, "edge", "a", "b")]
    return named.withColumn("id", F.col("_new")).drop("_new"), moved.select(*by, F.col("_edge").alias("edge"), F.col("_a").alias("a"), F.col("_b").alias("b"), *rest)


def first_seen(rows: DataFrame, content: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with `canonical` (e1, e2, ... by the first place of equal content, nulls alike) and `is_first`."""
    key = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("_key", key).withColumn("_place", F.struct(*order))
    firsts = keyed.groupBy(*by, "_key").agg(F.min("_place").alias("_first"))
    firsts = firsts.withColumn("canonical", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(*by).orderBy("_first"))))
    return keyed.join(firsts, [*by, "_key"]).withColumn("is_first", F.col("_place") == F.col("_first")).drop("_key", "_place", "_first")


# ---- ledgers of facts and events


def fact_conflict(assertion: Column, task: Column, temporality: Column, action: Column, occurrence: Column) -> Column:
    """Whether a fact can't belong to an event that occurred: a negated intervention, a condition, the future, or a mere plan."""
    negated = (assertion == "absent") & task.isin("medications", "oncology", "procedures_devices")
    return F.coalesce((occurrence == "occurred") & (F.coalesce(negated, F.lit(False)) | F.coalesce(assertion == "conditional", F.lit(False)) | F.coalesce(temporality == "future", F.lit(False)) | F.coalesce(action.isin("planned", "ordered", "declined", "cancelled"), F.lit(False))), F.lit(False))


def distinct_administrations(facts: DataFrame, by: Sequence[str], name: str, fields: Sequence[str]) -> DataFrame:
    """by..., distinct: whether two facts of one name differ in a field that both state (nulls differ from nothing)."""
    differ = F.lit(False)
    for f in fields:
        differ = differ | (F.min(f) != F.max(f))
    return facts.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(*by, name).agg(F.coalesce(differ, F.lit(False)).alias("d")).groupBy(*by).agg(F.bool_or("d").alias("distinct"))


def ledger(facts: DataFrame, record: str, fact: str, owner: Column, subject: Column, evidence_ok: Column) -> DataFrame:
    """Facts with `reason` (null if accepted) and `alias`: accepted ones are f1, f2, ... of their record in the order of their ids."""
    reason = F.when(~owner.eqNullSafe(F.col(record)), "unknown_or_wrong_patient_fact").when(subject.isNotNull() & (subject != "index_patient"), "unresolved_or_other_subject_fact").when(evidence_ok.isNull(), "missing_fact_source_evidence").when(~evidence_ok, "invalid_fact_source_evidence")
    own = Window.partitionBy(record, F.col("reason").isNull()).orderBy(fact)
    return facts.withColumn("reason", reason).withColumn("alias", F.when(F.col("reason").isNull(), F.concat(F.lit("f"), F.row_number().over(own))))


def ledger_summary(rows: DataFrame, record: str) -> DataFrame:
    """ledger() -> record, input_facts, accepted_facts, quarantined_facts, reasons (map)."""
    counts = rows.groupBy(record, "reason").agg(F.count("*").alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return counts.groupBy(record).agg(F.sum("n").alias("input_facts"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted_facts"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("quarantined_facts"), reasons.alias("reasons"))


def applied_delta(state: DataFrame, delta: DataFrame, by: str, id_: str, sound: Column, partial: bool) -> tuple[DataFrame, DataFrame]:
    """State with a delta's new rows, and the delta with `status`: added, known (same id: kept as it is) or refused.

    Not partial: one refused row of a group refuses all rows of that group. Rows of the state are never changed.
    """
    known = state.select(by, id_).distinct().withColumn("_known", F.lit(True))
    once = Window.partitionBy(by, id_).orderBy(*sorted(c for c in delta.columns if c not in (by, id_)))
    told = delta.withColumn("_sound", F.coalesce(sound, F.lit(False))).withColumn("_k", F.row_number().over(once)).join(known, [by, id_], "left")
    group = F.lit(True) if partial else F.bool_and("_sound").over(Window.partitionBy(by))
    status = F.when(~F.col("_sound") | ~group, "refused").when(F.col("_known") | (F.col("_k") > 1), "known").otherwise("added")
    told = told.withColumn("status", status)
    return state.unionByName(told.where("status = 'added'").select(*state.columns)), told.select(*delta.columns, "status")


def batches(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, apart: str | None = None, most_rows: int = 6, most_rows_apart: int = 4, most_size: int = 10_000) -> DataFrame:
    """Rows with `batch` (from 1): neighbours of a group together, up to most_rows (of rows with `apart`: most_rows_apart) and most_size; a change of `apart` begins anew.

    Each cut depends on the one before, so a group is read in order by one task, in batches of Arrow rows.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", batch int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, total, was = None, 0, 0, 0, None
        for part in parts:
            out = []
            flags = part[apart].fillna(False).tolist() if apart else [False] * len(part)
            for k, s, flag in zip(part[[*by]].itertuples(index=False, name=None), part[size], flags, strict=True):
                if k != key:
                    key, batch, n, total, was = k, 0, 0, 0, None
                if was is None or n >= (most_rows_apart if flag else most_rows) or total + s > most_size or was != flag:
                    batch, n, total = batch + 1, 0, 0
                n, total, was = n + 1, total + s, flag
                out.append(batch)
            yield part.assign(batch=out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, kinds)
