"""Manifests, statuses, owners, drafts, selections and arms on small frames."""

import json

import pytest
from caseloom.operators import release as R, selection as L
from pyspark.sql import functions as F


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_manifest_series_and_chunk_errors(spark):
    declared = spark.createDataFrame([("s", "u1"), ("s", "u2")], "supplement string, url string")
    manifest = spark.createDataFrame([("s", "u1", "table"), ("s", "u1", "odd"), ("s", "u9", None)], "supplement string, url string, kind string")
    assert rows(R.manifest_errors(declared, manifest, ["supplement", "url"], {"kind": ["table"]}), "url", "error") == {("u1", "repeated_file"), ("u2", "missing_file"), ("u9", "unknown_file"), ("u1", "kind_not_allowed"), ("u9", "kind_not_allowed")}
    points = spark.createDataFrame([(1, "c1", "parsed", "5", "p"), (2, "c1", "parsed", "6", "p"), (3, "c9", "parsed", "5", None), (4, "c2", "missing_cell", None, "q")], "id int, cell string, status string, magnitude string, patient string")
    cells = spark.createDataFrame([("c1", "5 mg"), ("c2", "n/a")], "cell string, raw string")
    assert rows(R.series_errors(points, cells, spark.createDataFrame([("p",)], "patient string"), ["id"]), "id", "error") == {(2, "parse_differs"), (3, "unknown_cell"), (4, "unknown_owner")}
    chunks = spark.createDataFrame([("c", "s1", "one"), ("c", "s2", "two")], "chunk string, segment string, text string")
    told = spark.createDataFrame([("c", "s1", "on"), ("c", "s1", "x"), ("c", "s7", "y")], "chunk string, segment string, quote string")
    assert rows(R.chunk_errors(chunks, told, ["chunk"]), "segment", "error") == {("s1", "quote_not_literal"), ("s7", "unknown_segment"), ("s2", "uncited_segment")}


def test_frozen_and_protected(spark):
    hashed = lambda *r: spark.createDataFrame(r, "article string, sha string")
    assert rows(R.frozen_errors(hashed(("a", "1"), ("b", "2"), ("z", "3")), hashed(("a", "1"), ("b", "9"), ("c", "4")), "article", "sha"), "article", "error") == {("b", "other_hash"), ("z", "unknown"), ("c", "missing")}
    fact = lambda **v: json.dumps(v)
    before = spark.createDataFrame([(1, fact(a=1, b=2)), (2, fact(a=1)), (3, fact(a=1)), (4, fact(a=1))], "id int, value string")
    after = spark.createDataFrame([(1, fact(a=1, b=3)), (2, fact(a=2)), (4, fact(a=1))], "id int, value string")
    assert rows(R.unprotected(before, after, spark.createDataFrame([(1, "/b")], "id int, pointer string"), "id"), "id", "error") == {(2, "changed"), (3, "gone")}
    same = spark.createDataFrame([(1, "x")], "id int, error string")
    assert R.all_violations([same, same]).count() == 1


def test_statuses_and_owners(spark):
    sidecars = spark.createDataFrame([("a", "labels", "agent_reviewed"), ("a", "labels", "drafted"), ("a", "flags", "odd"), ("b", "labels", "agent_and_parent_reviewed")], "article string, kind string, state string")
    assert rows(R.sidecar_status(sidecars, ["article"], "kind", ["labels", "flags"], "state"), "article", "labels", "flags") == {("a", "drafted", "not_started"), ("b", "agent_and_parent_reviewed", "not_started")}
    panels = spark.createDataFrame([("a", ["p", "q"], True, "drafted"), ("a", ["p"], False, "agent_reviewed")], "article string, owners array<string>, includable boolean, state string")
    assert rows(R.patient_status(panels, ["article"]), "patient", "panels", "includable", "state") == {("p", 2, 1, "drafted"), ("q", 1, 1, "drafted")}
    facts = spark.createDataFrame([("a", 1, ["p", "x"]), ("a", 2, [])], "article string, fact int, patient_ids array<string>")
    people = spark.createDataFrame([("a", "p")], "article string, patient string")
    assert rows(R.owned_facts(facts, people, "article"), "fact", "patient") == {(1, "p")}
    figures = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("a", "f3")], "article string, figure string")
    reviews = spark.createDataFrame([("a", "f1", "p"), ("a", "f2", "p"), ("a", "f2", "q")], "article string, figure string, patient string")
    assert rows(R.patient_media(figures, reviews, "article"), "figure", "patient", "status") == {("f1", "p", "attributed"), ("f2", "p", "shared"), ("f2", "q", "shared"), ("f3", None, "unreviewed")}
    bundles = spark.createDataFrame([("a:1",), ("b:1",), ("a",)], "id string")
    assert rows(R.bundles_of(bundles, spark.createDataFrame([("a",)], "article string"), "id", "article"), "id") == {"a:1"}
    sources = spark.createDataFrame([("a", ["X", "Y"]), ("b", []), ("c", None), ("d", None)], "article string, authors array<string>")
    metadata = spark.createDataFrame([("b", ["Z"], "J"), ("c", None, "J")], "article string, authors array<string>, journal string")
    assert rows(R.authors(sources, metadata, "article"), "article", "attribution") == {("a", "X; Y"), ("b", "Z"), ("c", "J"), ("d", "unknown")}


def test_drafts_and_flat_rows(spark):
    panels = spark.createDataFrame([("a", "microscopy", [], [], ["p"], ["individual"], ["plain"])], "article string, kind string, modalities array<string>, charts array<struct<type:string,scope:string,clinical:boolean>>, owners array<string>, scopes array<string>, texts array<string>")
    r = R.draft_labels(panels).first()
    assert r.default.category == "pathology" and r.default.includable and r.flags.burned_in == "none"
    files = spark.createDataFrame([("s", "u", "xlsx", None), ("s", "v", None, "consent form")], "supplement string, url string, type string, description string")
    assert rows(R.draft_manifest(files, ["supplement", "url"]), "url", "suggested_class", "review") == {("u", "table", "unreviewed"), ("v", "non_clinical", "unreviewed")}
    nested = spark.createDataFrame([("a", "f", [("A", 1), ("B", 2)])], "article string, figure string, panels array<struct<panel:string,n:int>>")
    assert rows(R.panel_rows(nested, "article"), "panel", "n") == {("A", 1), ("B", 2)}
    flags = spark.createDataFrame([("a", "A", "x"), ("a", "A", "y"), ("a", None, "z")], "article string, panel string, flag string")
    assert R.flag_map(flags, ["article"], "panel", "flag").first().flags == {"A": "y", "_whole": "z"}
    assert R.document_vocabulary(spark.createDataFrame([(1, "B b a"), (2, None)], "id int, text string"), "id", "text").first().words == {"a": 1, "b": 2}


def test_selection_matching_and_arms(spark):
    candidates = spark.createDataFrame([(k, k % 3, float(k)) for k in range(9)], "id int, split int, score double")
    chosen, excluded, left = R.selection(candidates, {"held_out": F.col("split") == 2, "low": F.col("score") < 2}, "id", lambda e: L.sample(e, "id", 2, "s:").withColumn("seat", F.lit(1)))
    assert rows(excluded.withColumn("r", F.array_join("reasons", "+")), "id", "r") == {(0, "low"), (1, "low"), (2, "held_out"), (5, "held_out"), (8, "held_out")} and chosen.count() == 2 and left.count() == 2
    pairs = spark.createDataFrame([("g", "r1", "p1", 1.0, False), ("g", "r2", "p1", 5.0, True), ("g", "r2", "p2", 0.5, True)], "g string, r string, p string, w double, review boolean")
    assert rows(R.matched_twice(pairs, ["g"], "r", "p", "w", F.col("review")), "r", "p", "phase") == {("r1", "p1", 1), ("r2", "p2", 2)}
    arms = spark.createDataFrame([("x", "train", 1, 2.0), ("x", "test", 2, 4.0), ("y", "train", 1, 6.0)], "arm string, split string, id int, v double")
    assert rows(R.arm_report(arms, "arm", "split", "id", [F.sum("v").alias("v")], 2), "arm", "split", "v", "matched") == {("x", None, 6.0, False), ("x", "train", 2.0, False), ("x", "test", 4.0, False), ("y", None, 6.0, False), ("y", "train", 6.0, False), ("x", None, 2.0, True), ("x", "train", 2.0, True), ("y", None, 6.0, True), ("y", "train", 6.0, True)}
    r = spark.range(1).select(R.grounded(F.lit(5), F.lit(1), F.lit(2), F.lit(2)).alias("g"), R.search_reward(F.lit(0.8), F.lit(0.6), F.lit(0.5), F.lit(0.7), 0.5, 0.1, F.lit(1), F.lit(4), F.lit(1.0)).alias("w")).first()
    assert (r.g.tp, r.g.fp, r.g.fn) == (3, 3, 4) and r.w == pytest.approx(0.7 - 2 * 0.1 - 0.25)
