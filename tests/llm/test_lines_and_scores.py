import math
import random
import re
from collections import Counter

from caseloom.llm import backoff, line_dedup
from pyspark.sql import functions as F


SPACE = r"[\x20\x09-\x0D]"


def brute_pieces(text, window):
    """(start, size, words) of the pieces of a text, and its words."""
    found = [*re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [m[0] for m in found]
    cuts = {0} | {k for k in range(1, len(words)) if "\n" in text[found[k - 1].end() : found[k].start()]}
    for i in range(len(words) - window + 1):
        cuts.add(min(range(i, i + window), key=lambda k: (words[k].encode()[:8].ljust(8, b"\0"), -k)))
    if not words:
        return [], words
    cuts = sorted(cuts)
    return [(a, tuple(words[a:b])) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)], words


def brute_lines(rows, window=16, min_words=20):
    docs = sorted({(r[0], line_dedup.short_digest(r[1] or ""), r[1] or "") for r in rows if r[0] is not None})
    own = {(d, h): brute_pieces(t, window) for d, h, t in docs}
    first = {}
    for d, h, _ in docs:
        for (s, x), (_, y) in zip(own[d, h][0], own[d, h][0][1:], strict=False):
            first.setdefault((x, y), (d, h, s))
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = []
    for r in rows:
        text = r[1] or ""
        me = (r[0], line_dedup.short_digest(text))
        pieces, words = brute_pieces(text, window)
        runs = []
        for (s, x), (_, y) in zip(pieces, pieces[1:], strict=False):
            at = first[x, y] if r[0] is not None else (*me, s)
            if at != (*me, s):
                e = s + len(x) + len(y)
                if runs and s <= runs[-1][1]:
                    runs[-1][1:] = [e, runs[-1][2], (at, len(x) + len(y))]
                else:
                    runs.append([s, e, at, (at, len(x) + len(y))])
        gone = set()
        for a, e, left, (right, n) in runs:
            if e - a >= min_words:
                lw, rw = own[left[:2]][1], own[right[:2]][1]
                a2 = a - same(words[max(0, a - window) : a][::-1], lw[max(0, left[2] - window) : left[2]][::-1])
                gone |= set(range(a2, e + same(words[e : e + window], rw[right[2] + n : right[2] + n + window])))
        tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        kept = re.match(f"{SPACE}*", text)[0] + "".join(t for k, t in enumerate(tokens) if k not in gone)
        out.append((str(r[0]), kept, len(words), len(gone), sum(k - 1 not in gone for k in gone)))
    return sorted(out)


def found_lines(df, **how):
    return sorted((str(r.doc_id), r.text or "", r.n_words, r.n_removed, r.n_runs) for r in line_dedup.dedup(df, **how).collect())


def line_rows():
    r = random.Random(2)
    pool = [f"line number {k} of the pool {'x' * (k % 9)} y{k % 5} z{k % 7}" for k in range(25)] + ["", "  ", "}"]
    rows = [(k, "\n".join(r.choices(pool, k=r.randint(0, 14)))) for k in range(120)]
    return [*rows, rows[3], rows[4], (None, rows[5][1]), (200, rows[6][1]), (201, "\n".join(pool[:9] * 40)), (4, rows[7][1])]


def test_lines(spark, docs, clashing, none, rows):
    want = brute_lines(rows)
    assert found_lines(docs) == want == found_lines(clashing)
    assert line_dedup.dedup(none).count() == 0
    many = line_rows()
    df = spark.createDataFrame(many, "doc_id bigint, text string").repartition(4)
    assert found_lines(df) == brute_lines(many)
    assert found_lines(df, window=4, min_words=6) == brute_lines(many, 4, 6)


def test_passages_inside_lines_go_whole(spark):
    """A passage of 51 words and more repeats in one line, from the middle of lines, and across lines; its copies go, words around it stay."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(1, 9)))
    rows, passages = [], []
    for k in range(40):
        passage = [word() for _ in range(r.randint(51, 90))]
        if k % 3 == 0:
            passage[r.randrange(len(passage))] += "\n" + word()
        passages.append(" ".join(passage))
        for c in range(2):
            rows.append((10 * k + c, " ".join(["Head", *(word() for _ in range(r.randint(0, 30))), f"q{k}{c}", passages[-1], f"r{k}{c}", *(word() for _ in range(r.randint(0, 30)))])))
    out = {x.doc_id: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, text in rows:
        passage = passages[d // 10].split()
        assert out[d].n_removed == (len(passage) if d % 10 else 0)
        assert out[d].text.split() == (text.split() if d % 10 == 0 else [w for w in " ".join(text.split()).replace(" ".join(passage), "").split()])


def test_stage_keeps_columns(spark, clashing, none):
    names = ("_kept", "_old", "row", "n_removed", "d", "_bit", "marks")
    more = clashing.select("*", *(F.lit("x").alias(c) for c in names))
    out = line_dedup.applied(more)
    assert out.columns == more.columns and {r._kept for r in out.collect()} == {"x"}
    assert out.where("doc_id = 12").first().text is None
    assert line_dedup.applied(none).count() == 0 and line_dedup.applied(none).schema == none.schema


def brute_scores(rows, alpha=0.4, least=2):
    text = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(r[0], text(r[1])) for r in rows]
    one = Counter(w for _, ws in docs for w in ws)
    two = Counter(p for _, ws in docs for p in zip(ws, ws[1:], strict=False))
    log = lambda x: round(math.log(x) * 1e6)
    out = []
    for doc, ws in docs:
        score = alone = 0
        for k, w in enumerate(ws):
            if k and two[ws[k - 1], w] >= least:
                score += log(two[ws[k - 1], w]) - log(one[ws[k - 1]])
            else:
                score, alone = score + log(one[w]) - log(sum(one.values())) + (log(alpha) if k else 0), alone + 1
        out.append((str(doc), len(ws), alone, score))
    return sorted(out)


def test_scores(docs, clashing, none, rows, monkeypatch):
    got = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_backoffs, r.score) for r in backoff.scores(df).collect())
    assert got(docs) == brute_scores(rows) == got(clashing)
    assert got(none) == []
    assert {s for *_, s in got(docs.where("text is null or text = ''"))} == {0}
    monkeypatch.setattr(backoff, "BLOCK", 200)
    assert got(docs) == brute_scores(rows)
