"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

A word pair that the corpus has at least `least` times scores count(pair) / count(first word), another alpha * count(second) / N, and a
text's first word count / N. Counts cover the whole corpus, the scored text included. Terms are whole millionths of natural logarithms of counts, so sums
are exact in any order.

Rows of n-grams would be many times the input, so they move packed: a block of documents sends its distinct words and pairs
with counts, as sorted hashes, to the count table's partitions, and gets the corpus counts back in the same order. It
is a join of exploded n-grams with the count tables on the hash, with a row for each block and partition. A hot word is one entry a
block. The blocks' texts meet their counts by the block's digest. A hash has 48 bits beside those that its partition tells, so of n n-grams in a
partition each shares its key by chance with a probability of n / 2^48, at any size of the input that keeps n.

The input must give its rows in the same order when it is read again, as a table does; if it does not, the query fails
rather than score against other counts. Null and empty texts have 0 words and score 0. Repeated rows count as often as
they occur. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, checkpointed, id_text, shuffle_partitions, small_batches, with_long_id
from .hashing import _PLACES, mixed, words

ALPHA, LEAST, BLOCK = 0.4, 2, 4_000_000


def key_bits(parts: int) -> int:
    """48 for the place in a partition of the count table, and those that the partition tells, 64 at most: more partitions, longer keys."""
    return min(64, 47 + parts.bit_length())


def packed(values: np.ndarray, base: int) -> bytes:
    """Sorted numbers of 48 bits from base on as differences, byte by byte of all, so that their zeros compress."""
    steps = np.diff(values, prepend=np.uint64(base)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text) + 1
            if size > BLOCK:
                yield named(ids, texts), ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield named(ids, texts), ids, texts


def named(ids: list, texts: list[str]) -> bytes:
    h = hashlib.blake2b(repr(ids).encode(), digest_size=16)
    for t in texts:
        h.update(t.encode() + b"\0")
    return h.digest()


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and the pairs that begin at each word but the last, as hashes of so many bits; words of each text; true where a pair lies in one text."""
    h, counts = words(texts)
    drop = np.uint64(64 - bits)
    pair = mixed(h[:-1] * _PLACES[0] + h[1:] * _PLACES[1]) >> drop
    inside = np.ones(len(h), bool)
    inside[(np.cumsum(counts) - 1)[counts > 0]] = False
    return h >> drop, pair, counts, inside[: len(pair)] if len(h) else np.zeros(0, bool)


def micro(counts: np.ndarray | int) -> np.ndarray:
    return np.rint(np.log(np.maximum(counts, 1)) * 1e6).astype(np.int64)


def partial_scores(rows: DataFrame, parts: int, alpha: float, least: int) -> DataFrame:
    """doc_id, n_tokens, n_backoffs (words that are scored alone), partial: the score but for N."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    bits = key_bits(parts)
    begins_at = [-(-(q << bits) // parts) for q in range(parts)]

    def cuts(values: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(values, np.array(begins_at, np.uint64)), len(values))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in blocks(batches):
            word, pair, _, inside = grams(texts, bits)
            (w, wn), (p, pn) = np.unique(word, return_counts=True), np.unique(pair[inside], return_counts=True)
            wc, pc, out = cuts(w), cuts(p), []
            for q in range(parts):
                a, b = slice(wc[q], wc[q + 1]), slice(pc[q], pc[q + 1])
                out.append((q, name, packed(w[a], begins_at[q]), wn[a].astype("<u4").tobytes(), packed(p[b], begins_at[q]), pn[b].astype("<u4").tobytes()))
            cols = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["q", "block", "words", "word_n", "pairs", "pair_n"])

    def totals(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
        own = [unpacked(k) for k in keys]
        unique, inverse = np.unique(np.concatenate(own), return_inverse=True)
        n = np.zeros(len(unique), np.int64)
        np.add.at(n, inverse, np.concatenate([np.frombuffer(c, "<u4") for c in counts]).astype(np.int64))
        return [x.tobytes() for x in np.split(n[inverse], np.cumsum([len(k) for k in own])[:-1])]

    def answers(table: pa.Table) -> pa.Table:
        got = [totals(table[k].to_pylist(), table[n].to_pylist()) for k, n in (("words", "word_n"), ("pairs", "pair_n"))]
        return pa.table([table["block"], table["q"], *(pa.array(x, pa.binary()) for x in got)], ["block", "q", "word_n", "pair_n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], ["block", "ids", "texts"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            raise ValueError("the input gave other rows, or another order, when it was read again")
        parts_ = sorted(zip(right["q"].to_pylist(), right["word_n"].to_pylist(), right["pair_n"].to_pylist(), strict=True))
        first = {q: (a, b) for q, a, b in parts_}
        wn, pn = (np.frombuffer(b"".join(x[k] for _, x in sorted(first.items())), np.int64) for k in (0, 1))
        for ids, texts in zip(left["ids"].to_pylist(), left["texts"].to_pylist(), strict=True):
            word, pair, counts, inside = grams(texts, bits)
            if len(word):
                w, p = np.unique(word), np.unique(pair[inside])
                cw = wn[np.searchsorted(w, word)]
                cp = np.zeros(len(word), np.int64)  # of the pair that ends at a word
                cp[1:][inside] = pn[np.searchsorted(p, pair[inside])]
                seen = cp >= least
                before = np.concatenate([cw[:1], cw[:-1]])
                begins = np.zeros(len(word), bool)
                begins[(np.cumsum(counts) - counts)[counts > 0]] = True
                term = np.where(seen, micro(cp) - micro(before), micro(cw) + np.where(begins, 0, int(np.rint(np.log(alpha) * 1e6))))
                total, alone = np.concatenate([[0], np.cumsum(term)]), np.concatenate([[0], np.cumsum(~seen)])
                ends = np.cumsum(counts)
                out += zip(ids, counts.tolist(), (alone[ends] - alone[ends - counts]).tolist(), (total[ends] - total[ends - counts]).tolist(), strict=True)
            else:
                out += [(d, 0, 0, 0) for d in ids]
        cols = [*zip(*out, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_tokens", "n_backoffs", "partial"])

    asked = rows.mapInArrow(requests, "q int, block binary, words binary, word_n binary, pairs binary, pair_n binary")
    told = asked.groupBy("q").applyInArrow(answers, "block binary, q int, word_n binary, pair_n binary")
    full = rows.mapInArrow(whole, f"block binary, ids array<{kind}>, texts array<string>")
    return full.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, n_backoffs bigint, partial bigint")


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_tokens, n_backoffs, score (millionths of natural logarithms), mean_log_score of each row."""
    small_batches(df.sparkSession)
    rows = with_long_id(id_text(df, id_col, text_col))
    part = checkpointed(partial_scores(rows, shuffle_partitions(df.sparkSession), alpha, least))
    n = part.agg(F.sum("n_tokens")).first()[0] or 0
    score = F.col("partial") - F.col("n_backoffs") * int(micro(n))
    return part.select("doc_id", "n_tokens", "n_backoffs", score.alias("score"), F.round(F.try_divide(score, F.col("n_tokens") * 1e6), 6).alias("mean_log_score"))


def sql(alpha: float = ALPHA, least: int = LEAST) -> str:
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
u AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT round(ln(count(*)) * 1e6)::BIGINT AS l FROM w),
s AS (SELECT b.doc_id, coalesce(p.c, 0) >= {least} AS seen, CASE WHEN coalesce(p.c, 0) >= {least} THEN round(ln(p.c) * 1e6)::BIGINT - round(ln(a.c) * 1e6)::BIGINT
      ELSE round(ln(u.c) * 1e6)::BIGINT - n.l + CASE WHEN b.v IS NULL THEN 0 ELSE round(ln({alpha}) * 1e6)::BIGINT END END AS term
      FROM b CROSS JOIN n JOIN u ON b.w = u.w LEFT JOIN u a ON b.v = a.w LEFT JOIN p ON b.v = p.v AND b.w = p.w),
d AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (NOT seen) AS n_backoffs, sum(term)::BIGINT AS score FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoffs, 0) AS n_backoffs, coalesce(score, 0) AS score FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""
