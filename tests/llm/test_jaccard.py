import itertools
import random
import re

from caseloom.llm import graph, jaccard


def brute(rows, percent=75):
    sets = {}
    for doc, text, *_ in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.setdefault(doc, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = {d: d for d in sets if d is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    flat = [(d, s) for d, ss in sets.items() if d is not None for s in ss if s]
    for (a, x), (b, y) in itertools.combinations(flat, 2):
        if a != b and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((root(a), root(b)))
            comp[q] = p
    return sorted((str(d), len(s), str(None if d is None else root(d))) for d, ss in sets.items() for s in ss)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.components(df).collect())


def test_cases(docs, clashing, none, rows):
    assert result(docs) == brute(rows)
    assert result(clashing) == brute(rows)
    assert jaccard.components(none).count() == 0


def test_near_copies_of_many_degrees(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(14):
        base = r.choices(vocabulary, k=r.randint(6, 120))
        for _ in range(r.randint(1, 25)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(w[: len(w) - r.randint(0, len(w) // 6)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(df) == brute(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "COUNTED", 300)
    assert result(df) == brute(rows)


def test_stars_of_a_forest():
    assert sorted(jaccard.stars_of([(9, 5), (7, 9), (3, 7), (5, 1), (20, 30)])) == [(1, 3), (1, 5), (1, 7), (1, 9), (20, 30)]


def test_components(spark):
    edges = [(k + 1, k) for k in range(100, 160)] + [(5, 900), (900, 7), (3, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, 900: 5, 7: 5}
