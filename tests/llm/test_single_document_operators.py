import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from caseloom.llm import media, mixing, packing, spotsigs, token_counts, toxicity

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def got(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, clashing, none, rows):
    want = sorted(({"doc_id": r[0], "n_bytes": len((r[1] or "").encode()), "n_tokens": (n := len(library(r[1]))), "over_limit": n > 1024} for r in rows), key=str)
    assert got(token_counts.token_counts(docs, PATH)) == want
    assert got(token_counts.token_counts(clashing, PATH)) == want
    assert token_counts.token_counts(none, PATH).count() == 0


def test_packing(docs, clashing, none, rows):
    pieces = packing.pack(clashing, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*library(text), 1], "<u4")
        copies = sum(r[0] == doc for r in rows)
        want = sorted(copies * [(s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)])
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc]) == want
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1]
        assert sum(p.length for p in ps) <= 2048
    assert packing.pack(none, PATH).count() == 0


def test_mixing(docs, clashing, none, rows, monkeypatch):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = defaultdict(int)
    for r in rows:
        own[r[3]] += size(r[1])
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    while True:
        rest = sum(own.values()) - sum(target[s] for s in capped)
        for s in set(names) - capped:
            target[s] = rest * weight[s] / sum(weight[x] for x in set(names) - capped)
        over = {s for s in set(names) - capped if target[s] > 3 * own[s]}
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        capped |= over
    out = mixing.mix(clashing).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), size(r[1])) for r in rows)
    for s in names:
        mine = [r for r in out if r.source == s]
        assert all(r.source_size == own[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    assert got(mixing.mix(docs)) == got(mixing.mix(docs.repartition(5)))
    assert mixing.mix(none).count() == 0
    plain = got(mixing.mix(docs))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert got(mixing.mix(docs)) == plain
    assert {r.target for r in mixing.mix(docs.where("text is null or text = ''")).collect()} == {0.0}


@pytest.mark.parametrize("how", ["fixed", "xiph", "ebml"])
def test_matroska_lacing(how):
    payload = bytes(range(256)) * 30
    data = media.write(payload, frame=256 if how == "fixed" else 300, lace=7, packets=9, how=how)
    found = media.read(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in found.packets) == payload
    assert found.tracks == [{"number": 1, "kind": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8}]
    assert [c[0] for c in found.cues] == [p.ts_ms for p in found.packets if p.cluster != 0 or p is found.packets[0]][:1] + [next(p.ts_ms for p in found.packets if p.cluster == k) for k in range(1, len(found.cues))]
    segment = data.index(media.number(media.INFO))
    assert all(data[segment + at :].startswith(media.number(media.CLUSTER)) for _, _, at in found.cues)


def test_matroska_unknown_sizes_and_groups():
    block = media.element(media.GROUP, media.element(media.BLOCK, b"\x81\x00\x05\x00abc"))
    cluster = media.number(media.CLUSTER) + b"\xff" + media.element(media.TIME, b"\x07") + block
    data = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm")) + media.number(media.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    found = media.read(data)
    assert found.doc_type == "webm" and [(p.cluster, p.ts_ms, data[p.offset : p.offset + p.size]) for p in found.packets] == [(0, 12.0, b"abc"), (1, 12.0, b"abc")]
    with pytest.raises(ValueError):
        media.read(data[:-1])
    with pytest.raises(ValueError):
        media.read(b"RIFF")


def test_media(docs, clashing, none, rows):
    out = {r.doc_id: r for r in media.digests(media.stored(clashing)).collect()}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = out[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[3].feature == out[16].feature and out[3].media_sha256 == out[16].media_sha256
    packets = media.packets(media.stored(docs))
    assert packets.count() == sum(max(1, -(-len((r[1] or "").encode()) // 192)) for r in rows)
    assert media.digests(media.stored(none)).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=9), rng.normal(size=(2, 2)), 0.3
    first = np.array([1, 0, 0, 0, 1, 0, 0, 1, 0], bool)
    got_, _ = toxicity.chained(e, first, np.exp(trans), start, width=4)
    want = np.zeros(9)
    for a, b in ((0, 4), (4, 7), (7, 9)):
        total, ones = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(start * ys[0] + sum(e[a + k] * y for k, y in enumerate(ys)) + sum(trans[p, q] for p, q in zip(ys, ys[1:], strict=False)))
            total, ones = total + w, ones + w * np.array(ys)
        want[a:b] = ones / total
    assert np.allclose(got_, want)


def test_toxicity_held_out(spark, docs, none, prose):
    bad = ["scoundrel", "vermin", "wretch"]
    texts = [(k, "you " * (k % 3) + prose(k, 40) + (f" {bad[k % 3]} you {bad[(k + 1) % 3]} " + prose(k + 999, 9) if k % 4 == 0 else "")) for k in range(400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert all(out[k].predicted == (k % 4 == 0) for k in range(400))
    text = dict(texts)[8]
    assert {text[s.start : s.end] for s in out[8].spans} >= {"wretch"}
    rest = toxicity.scored(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rest) and {r.score for r in rest if r.doc_id in (12, 13, 14)} == {0.0}
    assert toxicity.scored(none, model).count() == 0
    clean = toxicity.fit(df, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(docs, clean).collect()} == {0.0}


def test_edited_copies(docs, clashing, none, rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        text, after = r[1] or "", nxt[1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, b, c = (spotsigs.signatures(x) for x in (text, edited, after))
        jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) or len(y) else 1.0
        out.setdefault(r[0], []).append((n, hashlib.sha256(edited.encode()).hexdigest(), spotsigs.encoded(a), spotsigs.encoded(b), jaccard(a, b), jaccard(a, c)))
    found = defaultdict(list)
    for r in spotsigs.edited_copies(clashing).collect():
        found[r.doc_id].append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in out.items()}
    assert spotsigs.edited_copies(none).count() == 0


def test_spotsigs_near_duplicates(docs, rows):
    sets = {}
    for r in rows:
        s = frozenset(spotsigs.signatures(r[1] or "").tolist())
        if s and r[0] is not None:
            sets[s] = min(r[0], sets.get(s, r[0]))
    want = sorted((min(x, y), max(x, y)) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if len(a & b) / len(a | b) >= 0.75)
    assert sorted((r.a, r.b) for r in spotsigs.near_duplicates(docs.where("doc_id is not null")).collect()) == want


def test_pieces_give_the_library_s_ids(rows):
    own = packing.Pieces(PATH)
    texts = [t for _, t, *_ in rows if t] + ["", "<|endoftext|> a<|endoftext|>", "it's  two\n\n lines ", "naïve ÄÖ ß 漢字 ١٢٣ \u00a0x\u2028y", "a" * 300, "!!'s 'll'"]
    assert own.apart
    for t in texts:
        assert own.ids([t, "", t])[2].tolist() == [*packing.tokenizer(PATH).encode(t, add_special_tokens=False).ids, packing.END_ID]
