"""Views, packets, routes, drafts and receipts on small frames."""

import hashlib

from caseloom.operators import extraction as E
from pyspark.sql import functions as F


def test_views_and_packets(spark):
    articles = spark.createDataFrame([("a",), ("b",)], "article string")
    views = spark.createDataFrame([("a", "pdf", "t"), ("a", "xml", "x")], "article string, kind string, text string")
    assert {r.article: r.view.text if r.view else None for r in E.with_view(articles, views, "article", "pdf").collect()} == {"a": "t", "b": None}
    sha = hashlib.sha256(b"t").hexdigest()
    assert [r[0] for r in spark.range(2).select(E.view_sound(F.lit("s"), F.lit("s"), F.lit("t"), F.when(F.col("id") == 0, sha))).collect()] == [True, False]
    segments = spark.createDataFrame([("a", 1, "s1", None, "one"), ("a", 2, "s2", "Case", "two")], "article string, pos int, segment string, heading string, text string")
    (r,) = E.packets(segments, ["article"], ["pos"]).collect()
    assert r.packet == "[s1] Article\none\n\n[s2] Case\ntwo\n\n" and [r.packet[s.start : s.end] for s in r.spans] == ["one", "two"] and r.packet_sha256 == hashlib.sha256(r.packet.encode()).hexdigest()


def test_patient_views(spark):
    segments = spark.createDataFrame([("a", "s1", "paragraph", "Case 1"), ("a", "s2", "paragraph", "Case 2"), ("a", "s3", "table_row", None), ("a", "s4", "paragraph", "Introduction"), ("a", "s5", "paragraph", "Other"), ("a", "s6", "paragraph", "Unseen")], "article string, segment string, kind string, heading string")
    assigned = spark.createDataFrame([("a", "s1", "p1"), ("a", "s2", "p2"), ("a", "s5", None)], "article string, segment string, patient string")
    views: dict = {}
    for r in E.patient_view(segments, assigned, "article", "patient").collect():
        views.setdefault(r.patient, set()).add(r.segment)
    assert views == {"p1": {"s1", "s3", "s4", "s5"}, "p2": {"s2", "s3", "s4", "s5"}}


def test_identities_receipts_and_units(spark):
    schema = "article string, window int, local string, label string, evidence array<string>"
    windows = spark.createDataFrame([("a", 1, "w1", "boy", ["x"]), ("a", 2, "w2", "the boy", ["y", "x"]), ("a", 2, "w3", "girl", ["z"])], schema)
    out = {r.final: (r.label, r.evidence, r.members) for r in E.merged_identities(windows, spark.createDataFrame([("a", "w1", "p1"), ("a", "w2", "p1")], "article string, local string, final string"), ["article"], "local", "final", ["window"]).collect()}
    assert out == {"p1": ("boy", ["x", "y"], 2), "w3": ("girl", ["z"], 1)}
    frame = lambda *rows: spark.createDataFrame(rows, "id string, sha string")
    assert [r.id for r in E.receipts_agree([frame(("a", "1"), ("b", "1")), frame(("a", "1"), ("b", "2")), frame(("a", "1"))], ["id"], ["sha"]).collect()] == ["a"]
    units = E.coverage_units(windows.withColumnRenamed("local", "segment"), windows.where("window = 1").withColumnRenamed("local", "supplement"), "article")
    assert sorted(r.unit for r in units.collect()) == ["segment:w1", "segment:w2", "segment:w3", "supplement:w1"]


def test_routes_and_audits(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, None)], "k string, id int, ok boolean")
    good, bad = E.split_sound(df, F.col("ok"))
    assert good.count() == 1 and bad.count() == 2
    edges = spark.createDataFrame([("a", "e1", 1, 1), ("a", "e2", 1, 2)], "k string, edge string, a int, b int")
    kept, whole, audit = E.valid_part(df, edges, ["k"], F.col("ok"))
    assert kept.count() == 1 and [r.edge for r in whole.collect()] == ["e1"] and {(r.kind, r.id, r.reason) for r in audit.collect()} == {("event", "2", "unsound"), ("event", "3", "unsound"), ("edge", "e2", "missing_event")}
    decisions = spark.createDataFrame([(1, "extracted"), (2, "extracted"), (3, "absent")], "cell int, disposition string")
    checks = spark.createDataFrame([(1, True, "fine"), (2, False, "unit"), (3, False, "x")], "cell int, holds boolean, reason string")
    assert {r.cell: (r.disposition, r.audit) for r in E.demoted(decisions, checks, ["cell"]).collect()} == {1: ("extracted", None), 2: ("unresolved", "unit"), 3: ("absent", None)}
    panels = spark.createDataFrame([(1, "A", "(A) scan"), (2, "left?", "nothing"), (3, None, "x"), (4, 'says "why?"', 'it says "why?" here')], "id int, label string, caption string")
    assert {(r.id, r.issue) for r in E.unprinted_labels(panels, ["id"]).collect()} == {(2, "label_not_in_caption"), (2, "question_mark")}


def test_requests_rows_and_counts(spark):
    facts = spark.createDataFrame([("k1", "conditions"), ("k1", "conditions"), ("k2", "medications")], "fact_key string, task string")
    systems = spark.createDataFrame([("conditions", "icd"), ("conditions", "snomed"), ("medications", "rx")], "task string, system string")
    assert E.coding_requests(facts, systems).count() == 3
    ids = lambda *rows: spark.createDataFrame(rows, "pool string, id string")
    out = {(r.p, r.batch): r.references for r in E.pooled_requests(ids(("x", "p1"), ("y", "p2")).withColumnRenamed("id", "p"), ids(*[("x", f"r{k}") for k in range(5)]).withColumnRenamed("id", "r"), ["pool"], "p", "r", 2).collect()}
    assert out == {("p1", 0): ["r0", "r1"], ("p1", 1): ["r2", "r3"], ("p1", 2): ["r4"], ("p2", 0): []}
    quoted = spark.createDataFrame([("a", "f", [("s1", "two"), ("s1", "no"), ("s9", "x")])], "article string, fact string, evidence array<struct<segment:string,quote:string>>")
    rows = E.evidence_rows(quoted, ["article", "fact"], "evidence", spark.createDataFrame([("a", "s1", "one two")], "article string, segment string, text string"), "article")
    assert {(r.pos, r.start) for r in rows.collect()} == {(0, 4), (1, None), (2, None)}
    spans = spark.createDataFrame([("a", "f2", 1, 5), ("a", "f1", 2, 0), ("a", "f1", 1, 9)], "article string, fact string, segment_pos int, start int")
    assert {r.fact: r.place for r in E.source_ordered(spark.createDataFrame([("a", "f0"), ("a", "f1"), ("a", "f2")], "article string, fact string"), spans, ["article"], "fact").collect()} == {"f2": 1, "f1": 2, "f0": 3}
    links = spark.createDataFrame([("a", "e", "f2", 1), ("a", "e", "f1", 2), ("a", "e", "f2", 3)], "article string, event string, fact string, seq int")
    assert {r.event: r.facts for r in E.ledger_timeline(spark.createDataFrame([("a", "e"), ("a", "g")], "article string, event string"), links, ["article"], "event", "fact").collect()} == {"e": ["f2", "f1"], "g": []}
    files = spark.createDataFrame([("s", "non_clinical", "ok"), ("s", None, "unavailable"), ("t", "non_clinical", "ok")], "supplement string, class string, download_status string")
    assert {r.supplement: (r.non_clinical, r.any_unavailable) for r in E.file_states(files, "supplement").collect()} == {"s": (False, True), "t": (True, False)}
    items = spark.createDataFrame([("a", "lab", "Na", 1.0), ("a", "lab", "na", 2.0), ("a", "drug", "x", None)], "article string, kind string, name string, number double")
    r = E.feature_counts(items, ["article"], "kind", ["lab", "drug", "sign"]).first()
    assert (r.lab, r.drug, r.sign, r["items"], r.numeric_names) == (2, 1, 0, 3, 1)
    assert [x[0] for x in spark.createDataFrame([(0, 5, 3, 9), (0, 5, 5, 9)], "a int, b int, c int, d int").select(E.spans_overlap(F.lit("s"), F.col("a"), F.col("b"), F.lit("s"), F.col("c"), F.col("d"))).collect()] == [True, False]
