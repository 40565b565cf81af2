import difflib
import hashlib
import itertools
import json
import random
import unicodedata
import uuid
from decimal import Decimal

import pytest
from caseloom.functions import text as T
from caseloom.functions.labels import NAMESPACE, canonical, flat_digest, json_digest, stable_id
from caseloom.functions.measurements import parsed_measurement
from caseloom.operators import custom
from caseloom.operators.intervals import feasible
from caseloom.operators.matching import best_matching, matched
from caseloom.streaming import catalog as stream
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"

EDGES = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(1, 9).map(float)), max_size=12)


def weight_by_force(edges):
    best: dict = {}
    for u, v, w in edges:
        best[u, v] = max(w, best.get((u, v), 0))
    pairs = [(u, v, w) for (u, v), w in best.items()]
    return max(sum(w for *_, w in chosen) for n in range(6) for chosen in itertools.combinations(pairs, n) if len({u for u, *_ in chosen}) == n == len({v for _, v, _ in chosen}))


@given(EDGES)
def test_matching_is_best(edges):
    found = best_matching(edges)
    assert len({u for u, *_ in found}) == len(found) == len({v for _, v, _ in found})
    assert sum(w for *_, w in found) == weight_by_force(edges)


def test_matched_frame(spark):
    rows = [(1, 1, 5.0), (1, 2, 4.0), (2, 1, 4.0), (7, 9, 1.0), (7, 9, 2.0), (None, 3, 1.0), (8, 8, 0.0)]
    out = matched(spark.createDataFrame(rows, "item bigint, doc bigint, w double"), "item", "doc", "w")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 4.0), (2, 1, 4.0), (7, 9, 2.0)]
    assert matched(spark.createDataFrame([], "item bigint, doc bigint, w double"), "item", "doc", "w").collect() == []


def test_assigned_items_use_each_side_once(spark):
    rows = custom.assigned_items(spark, FOLDER).collect()
    assert rows and len({r.item_id for r in rows}) == len(rows) == len({r.doc_id for r in rows})


@pytest.mark.parametrize("constraints, holds", [([], True), ([(1, 2, 5.0), (2, 1, -5.0)], True), ([(1, 2, 5.0), (2, 1, -6.0)], False), ([(1, 2, 1.0), (2, 3, 1.0), (3, 1, -3.0)], False), ([(1, 2, 1.0), (2, 3, 1.0), (3, 1, -2.0)], True)])
def test_feasible(constraints, holds):
    assert feasible(constraints) is holds


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(-4, 4).map(float)), max_size=8))
def test_feasible_by_force(constraints):
    """No simple cycle of negative sum."""
    low = {}
    for u, v, d in constraints:
        low[u, v] = min(d, low.get((u, v), d))
    cycles = [list(zip(c, (*c[1:], c[0]), strict=True)) for n in range(1, 5) for c in itertools.permutations(range(4), n)]
    assert feasible(constraints) == all(sum(low[e] for e in steps) >= 0 for steps in cycles if all(e in low for e in steps))


def by_hand(a, b):
    """The similarity of two labels, in plain Python."""
    light = set(T.LIGHT_WORDS)
    fold = lambda x: unicodedata.normalize("NFKC", x or "").casefold()
    key = lambda x: " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in fold(x).replace("μ", "u")).split())
    ka, kb = key(a), key(b)
    if not ka or not kb:
        bare = lambda x: "".join("-" if ch in T.HYPHENS else ch for ch in fold(x) if not ch.isspace())
        return float(bare(a) != "" and bare(a) == bare(b))
    if ka == kb:
        return 1.0
    single = lambda k: {w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in k.split()}
    wa, wb = (single(k) - light or single(k) for k in (ka, kb))
    both = len(wa & wb)
    return max(2 * both / (len(wa) + len(wb)), 0.75 * both / min(len(wa), len(wb)), difflib.SequenceMatcher(None, ka, kb, autojunk=False).ratio())


def test_similarity(spark):
    words = ["", "the", "heart", "hearts", "Rate", "rates", "of", "−", "+", "µg", "stress", "haemoglobin", "hemoglobin", "é", "ﬁb", "5"]
    r = random.Random(7)
    pairs = [(" ".join(r.choices(words, k=r.randint(0, 4))), " ".join(r.choices(words, k=r.randint(0, 4)))) for _ in range(400)] + [(None, None), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert row.s == pytest.approx(by_hand(row.a, row.b)), (row.a, row.b)


def test_label_neighbours(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    assert {r.p_partkey: r.alike for r in custom.label_neighbours(spark, FOLDER).collect()} == {k: round(by_hand(n, names.get(k + 1)), 9) for k, n in names.items()}


def test_digests_and_ids(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": "ä", "c": null}}',), ('{"a":{"c":null,"d":"ä"},"b":1}',), (None,)], "j string")
    a, b, c = (r[0] for r in df.select(json_digest(F.col("j"))).collect())
    assert a == b == hashlib.sha256('{"a":{"c":null,"d":"ä"},"b":1}'.encode()).hexdigest() and c is None
    assert canonical({"b": 1, "a": [2]}, compact=False) == '{"a": [2], "b": 1}'
    assert df.select(json_digest(F.lit("{broken")).alias("d")).first().d is None
    flat = spark.range(1).select(flat_digest({"b": F.lit(1), "a": F.lit("ä"), "c": F.lit(None).cast("string")}).alias("d")).first().d
    assert flat == hashlib.sha256('{"a":"ä","b":1,"c":null}'.encode()).hexdigest()
    ids = spark.createDataFrame([("x", 'q"ü'), ("", "7")], "a string, b string").select("a", "b", stable_id(F.col("a"), F.col("b")).alias("i")).collect()
    assert [r.i for r in ids] == [str(uuid.uuid5(NAMESPACE, json.dumps([r.a, r.b], ensure_ascii=False, separators=(",", ":")))) for r in ids]


def test_measurements_round_trip(spark):
    """Numbers written in many ways come back with their exact value; with a stray part they are no scalars."""
    r = random.Random(11)
    rows = []
    for _ in range(500):
        n, places, power = r.randint(0, 10**7), r.randint(0, 4), r.randint(-9, 9)
        number = Decimal(n).scaleb(-places)
        shown = f"{number:,f}" if r.random() < 0.5 else f"{number:f}"
        form = r.choice(["", "e{}", " × 10^{}", "x10^({})", "*10 ^ {}", "×10" + "".join("⁰¹²³⁴⁵⁶⁷⁸⁹"[int(d)] if d.isdigit() else "⁻" for d in str(power))])
        unit, spelled = r.choice([("", None), (" mmol/L", "mmol/L"), ("ug", "µg"), (" U/l/hr", "U/L/h"), ("/mm3", "/mm3")])
        than, sign = r.choice([("", "="), ("≤ ", "<="), (">", ">")])
        rows.append((than + shown + form.format(power) + unit, str(number.scaleb(power) if form else number), spelled, sign, True))
        rows.append((r.choice([f"{shown}-{shown}", f"{shown} x {shown} cm", f"{shown} furlongs", f"about {shown}", f"{shown}/80 mmHg", f"{shown} 5", f"{shown}e77", f"({shown}"]), None, None, None, False))
    out = spark.createDataFrame(rows, "t string, value string, unit string, sign string, sound boolean").select("*", parsed_measurement(F.col("t")).alias("m")).collect()
    for x in out:
        if x.sound:
            assert x.m and (Decimal(x.m.magnitude), x.m.unit, x.m.comparator) == (Decimal(x.value), x.unit, x.sign), x
        else:
            assert x.m is None, x


def test_bootstrap(spark):
    a = custom.paired_bootstrap(spark, FOLDER).collect()
    assert a == custom.paired_bootstrap(spark, FOLDER).collect() and a[0].low < a[0].mean < a[0].high
    df = spark.range(400).select("id", (F.col("id") % 2).alias("x"))
    (r,) = custom.bootstrap_mean(df, F.col("id"), F.col("x")).collect()
    assert r.mean == 0.5 and abs(r.high - 0.55) < 0.015 and abs(r.low - 0.45) < 0.015 and r.n == 400
    (r,) = custom.bootstrap_mean(df.where("id < 0"), F.col("id"), F.col("x")).collect()
    assert (r.mean, r.low, r.high, r.n) == (None, None, None, 0)


def test_time_constraints(spark):
    rows = custom.time_constraints(spark, FOLDER).collect()
    assert rows and len({(r.user_id, r.day_) for r in rows}) == len(rows)


def test_catalog_follows_files(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "k string, at bigint, text string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    go = lambda: stream.follow(spark, source, schema, target, state, "k", "at").awaitTermination(120)
    put(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"))
    assert go()
    put(("a", 3, "y"), ("b", 0, "old"), ("c", 1, "w"))
    assert go()
    rows = {r.k: (r["at"], r.text, r.changed_in) for r in stream.catalog(spark, target).collect()}
    assert rows == {"a": (3, "y", 0), "b": (1, "z", 0), "c": (1, "w", 1)}
    assert go() and stream.version(spark, target, 99) == 1
