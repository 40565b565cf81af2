"""Queries that once read a part of their tables: every line counts, whatever its order's key, and copies of a line are lines of their own."""

import datetime
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from caseloom.functions import text as T
from caseloom.operators import scoring as S
from caseloom.plans import library

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Keys of all remainders, copies of a line with other and with equal values, a null order and lines without a number."""
    day = lambda k: datetime.datetime(2001, 1, 1 + k % 28)
    lines = [(o, 1 + (o * 5 + n) % 36, 7, n, float(o + n), "ANR"[n % 3], day(n)) for o in range(1, 24) for n in range(1, 8)]
    lines += [(9, 3, 7, 1, q, f, day(d)) for q, f, d in ((5.0, "A", 3), (6.0, "A", 3), (6.0, "A", 3), (5.0, "R", 3), (5.0, "A", 4))]
    lines += [(None, 4, 7, 2, 1.0, "N", day(1)), (None, 6, 7, 3, 2.0, "N", day(2)), (11, 8, 7, None, 3.0, "R", day(5)), (16, 9, None, 2, 3.0, "R", day(5))]
    out = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(lines, LINES).write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(k, ["old widget", "new plate", "Blue ring"][k % 3]) for k in range(1, 37)], "p_partkey bigint, p_name string").write.parquet(f"{out}/part.parquet")
    return str(out)


def matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = library.queries()[name](spark, folder)
    cur = con.execute(library.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(([r[names.index(c)] for c in df.columns] for r in cur.fetchall()), key=repr)
    got = [list(r) for r in df.collect()]
    assert sorted(got, key=repr) == want
    return [dict(zip(df.columns, r, strict=True)) for r in got]


def test_attribute_scores_of_every_line(spark, folder):
    rows = {(r["grp"], r["field"]): r for r in matches_sql(spark, folder, "attribute_scores")}
    # 23 orders of 7 lines, 5 copies and 4 odd ones, less sixth lines, one without a number and parts that are missed
    kept = sum((1 + (o * 5 + n) % 36) % 5 != 0 for o in range(1, 24) for n in (1, 2, 3, 4, 5, 7))
    assert rows["value", "value"]["total"] == rows["value", "value"]["correct"] == rows["category", "flag"]["correct"] == kept + 5 + 3


def test_ratios_left_out_are_under_the_least(spark):
    """The bound holds for texts of all lengths and signs, and what is left out is never needed."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab1 é" if k % 9 == 0 else "abc12 ") for _ in range(draw.choice((1, 5, 20, 63, 64, 65, 90)))) for k in range(400)]
    pairs = [(a, draw.choice((a[:-1] + "c", draw.choice(texts)))) for a in texts]
    ratios = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    short = [(a.encode(), b.encode(), r * (len(a) + len(b)) / 2) for (a, b), r in zip(pairs, ratios, strict=True) if a.isascii() and b.isascii() and 0 < len(a) <= 64 and 0 < len(b) <= 64]
    assert all(m >= r - 1e-9 for m, (_, _, r) in zip(T.most_common([a for a, _, _ in short], [b for _, b, _ in short]).tolist(), short, strict=True))
    got = [r.x for r in spark.createDataFrame([(k, a, b, 0.8) for k, (a, b) in enumerate(pairs)], "k int, a string, b string, w double").coalesce(1).select("k", T._ratio_from("a", "b", "w").alias("x")).orderBy("k").collect()]
    assert all(g == r if g is not None else r < 0.8 for g, r in zip(got, ratios, strict=True)) and sum(g is None for g in got) > 100


def test_item_scores_of_every_line(spark, folder):
    rows = {r["task"]: r for r in matches_sql(spark, folder, "item_scores")}
    # 23 orders of 7 lines, 5 copies and 4 odd ones, less sixth lines and one without a number
    assert rows[None]["tp"] + rows[None]["fn"] == 23 * 6 + 5 + 3 and rows[None]["fp"] == 0


def test_unmatched_copies_are_counted(spark):
    """Of three equal items two are predicted, and one of two equal procedures whose evidence an observation has."""
    names = [f.split(" ")[0] for f in S.ITEM.split(", ")]
    base = {"article": "a", "patient": "p", "task": "conditions", "collection": "items", "label": "old widget", "item": "x", "evidence": [("s", "an old widget")], "assertion": "present", "imaging": False}
    ct = {"task": "procedures_devices", "item": "y", "label": "chest scan", "evidence": [("t", "chest scan showed a mass")], "imaging": True}
    seen = {"task": "observations", "item": "z", "label": "mass", "evidence": [("t", "chest scan showed a mass")]}
    frame = lambda *rows: spark.createDataFrame([[(base | r).get(n) for n in names] for r in rows], S.ITEM)
    reference, predicted = frame({}, {}, {}, ct, ct, seen), frame({}, {}, ct, seen)
    rows = {r.task: r for r in S.item_counts(reference, predicted, S.matched_items(reference, predicted)).collect()}
    assert (rows["conditions"].tp, rows["conditions"].fn, rows["conditions"].fp) == (2, 1, 0)
    assert (rows["procedures_devices"].tp, rows["procedures_devices"].redundant, rows["procedures_devices"].fn) == (1, 1, 0)
