import random
import re
from collections import defaultdict

import pytest
from caseloom.llm import line_dedup, pipeline_stages as stages, toxicity

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):
    r = random.Random(8)
    rows = []
    for k in range(160):
        text = "\n".join(prose(r.randrange(10**6), 25) for _ in range(r.randint(1, 4)))
        rows.append((k, text + (f"\nyou vermin {prose(k, 5)} wretch" if k % 6 == 0 else "")))
    shared = "\n".join(prose(77 + k, 20) for k in range(3))
    rows += [(200 + k, prose(300 + k, 30) + "\n" + shared) for k in range(3)]
    rows += [(300 + k, rows[1][1] + f" end{k}") for k in range(3)] + [(400, rows[5][1]), (401, None), (402, "")]
    out = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(d, t, "en", f"s{d % 3}" if d % 9 else None, len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(160)], "doc_id bigint, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_and_run(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    clean = stages.without_toxic(spark, docs, folder).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    assert set(before) - {r.doc_id for r in clean.collect()} == {k for k in range(160) if k % 6 == 0}

    lines = stages.without_repeated_lines(spark, clean, folder).cache()
    cut = {r.doc_id: r for r in line_dedup.dedup(clean).collect()}
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == {d for d, r in cut.items() if not r.n_removed or r.n_removed < r.n_words} and lines.columns == docs.columns
    assert all(r.text == cut[d].text and r.n_chars == len(r.text or "") for d, r in after.items()) and after[401].text is None

    kept = stages.without_near_copies(spark, lines, folder).cache()
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()) for d, r in after.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items() if w}
    comp = {d: d for d in after}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.doc_id for r in kept.collect()} == {d for d in after if comp[d] == d}

    mix = stages.mixed(spark, kept, folder).cache()
    copies = defaultdict(int)
    for r in mix.collect():
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and copies[401] == copies[402] == 1 and mix.columns == docs.columns

    pieces = stages.packed(spark, mix, folder).collect()
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(total[p.doc_id] == p.doc_tokens * copies[p.doc_id] for p in pieces) and set(total) == set(copies)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in whole) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces)
