import hashlib
import random

import numpy as np
from caseloom.llm import anchors, suffix_dedup


def brute(rows, length=50):
    least = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                least[s] = min(doc, least.get(s, doc))
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if doc is not None:
            for i in range(len(data) - length + 1):
                if least[data[i : i + length]] < doc:
                    gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((str(doc), len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect())


def test_cases(docs, clashing, none, rows):
    assert result(docs) == brute(rows)
    assert result(clashing) == brute(rows)
    assert suffix_dedup.dedup(none).count() == 0


def test_random_overlaps(spark, monkeypatch):
    r = random.Random(1)
    pool = ["".join(r.choices("ab ", k=400)), "".join(r.choices("abcdefgh ", k=900)), "ab" * 150, "z" * 200]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts.append(p[a : a + r.randint(10, 140)])
            parts.append("".join(r.choices("xyzé", k=r.randint(0, 30))))
        rows.append((r.randrange(60), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(df) == brute(rows)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 300)
    assert result(df) == brute(rows)


def test_anchors_depend_on_content_alone():
    r = random.Random(3)
    parts = [bytes(r.choices(b"abc", k=n)) for n in (0, 49, 50, 51, 200, 1000)]
    doc, h, at, first, last = anchors.runs(parts, 50, 20)
    assert sum(last - first + 1) == sum(max(0, len(p) - 49) for p in parts)
    for d, x, a, f, z in zip(doc, h, at, first, last, strict=True):
        for s in range(f, z + 1):
            alone = anchors.runs([parts[d][s : s + 50]], 50, 20)
            assert len(alone[0]) == 1 and alone[1][0] == x and alone[2][0] == a - s
