"""Line dedup by winnowing: fingerprints of line pieces find equal places, matches are extended both ways, later runs go.

Lines are cut into pieces at words that the text itself chooses: of each WINDOW neighbouring words the least one (by its first
eight bytes, the rightmost of equals) begins a piece, and so does the first word of a line. Equal passages are then cut alike
wherever they begin, in a line or across lines. Piece hashes are winnowed: of each two neighbours the lower is a fingerprint,
so any two equal pieces in a row share one. Fingerprints that occur once go. Around the others, each pair of neighbouring pieces is
joined with the first place (by doc_id, then word) of an equal pair; later ones overlap to runs. A run of at least min_words words
is extended word by word both ways, by up to WINDOW words, against the words around its first place, and removed.

A passage of 3 * WINDOW words or more, wherever it begins, holds whole pieces of more than its length less 2 * WINDOW words, so with 16
and 20 every repeated passage of over 50 words is found; extension takes its ends. Removed words go with the white space after them. Null text is empty.
Rows with a null doc_id are kept whole and repeat nothing. Equal rows of one doc_id are one document. Only the id and text columns
are read. Hot fingerprints and pairs are pre-aggregated and joined under salts; no task holds more than a batch of documents.
Pairs are compared by 64-bit hashes, and extended by 64-bit hashes of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, id_text, small_batches
from .graph import perhaps_in, with_group
from .hashing import _PLACES, eight, mixed, places

WINDOW, MIN_WORDS = 16, 20


def least(key: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places of the least word of each window inside a text, the rightmost of equals; window: a power of two."""
    at, width = np.arange(len(key)), 1
    while width < window:
        if len(at) <= width:
            return np.zeros(0, np.int64)
        left, right = at[:-width], at[width:]
        at = np.where(key[right] <= key[left], right, left)
        width *= 2
    return at[doc[: len(at)] == doc[window - 1 : window - 1 + len(at)]]


class Words:
    """The words of some texts, end to end."""

    def __init__(self, texts: list[str]) -> None:
        self.parts = [t.encode() for t in texts]
        self.word, self.counts, self.starts, self.ends, self.data = places(self.parts, fold=False)
        self.begins = np.cumsum(self.counts) - self.counts

    def around(self, doc: int, at: int, reach: int) -> tuple[list[int], list[int]]:
        """Hashes of up to reach words of a text before a place, the nearest first, and from it on."""
        a = int(self.begins[doc])
        here, end = a + at, a + int(self.counts[doc])
        as_signed = lambda x: x.view(np.int64).tolist()
        return as_signed(self.word[max(a, here - reach) : here][::-1].copy()), as_signed(self.word[here : min(end, here + reach)])


class Pieces(Words):
    """And the pieces that they are cut into; numbers are over all texts."""

    def __init__(self, texts: list[str], window: int = WINDOW) -> None:
        super().__init__(texts)
        n = len(self.word)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        cut = np.zeros(n, bool)
        if n:
            feeds = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
            cut[0] = True
            after = np.searchsorted(self.starts, feeds)  # the first word after each line feed
            cut[after[after < n]] = True
            cut[least(eight(self.data, self.starts, self.ends - self.starts), self.doc, window)] = True
        self.first = np.flatnonzero(cut)
        self.sizes = np.diff(self.first, append=n)
        place = np.arange(n) - np.repeat(self.first, self.sizes)
        # a piece has no more words than a window
        self.hash = mixed(np.add.reduceat(self.word * _PLACES[place % 16] + (place // 16).astype(np.uint64), self.first) + self.sizes.astype(np.uint64)) if n else np.zeros(0, np.uint64)
        self.pair = mixed(self.hash[:-1] * _PLACES[1] + self.hash[1:] * _PLACES[2])
        self.inside = self.doc[self.first[:-1]] == self.doc[self.first[1:]]

    def span(self, i: np.ndarray) -> np.ndarray:
        """Words of the pair that begins at piece i."""
        return self.sizes[i] + self.sizes[i + 1]


def fingerprints(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of each two neighbouring pieces of a text the one of lower hash, the right one of equals; and the pairs."""
    pairs = np.flatnonzero(p.inside)
    return np.where(p.hash[pairs + 1] <= p.hash[pairs], pairs + 1, pairs), pairs


def common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def long_runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts overlap to runs. Of those of enough words: the order of all pairs, and in it the first and last pair of each run."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]  # ends rise with starts
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    enough = end[last] - start[first] >= min_words
    return order, first[enough], last[enough]


def words_in(text: str | None) -> int:
    return len(text.encode().split()) if text else 0


def short_digest(text: str) -> int:
    """Tells texts of one doc_id apart."""
    return zlib.crc32(text.encode()) & 0xFFFF


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS, keep: bool = False) -> DataFrame:
    """doc_id, text (without later repeated runs; null stays null), n_words, n_removed, n_runs of each row; keep: and the row itself as a struct."""
    small_batches(df.sparkSession)
    rows = id_text(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            p = Pieces(texts, window)
            d = np.array([short_digest(t) for t in texts], np.int32)
            low, pairs = fingerprints(p)
            order = np.argsort(low, kind="stable")
            low, pairs = low[order], pairs[order]
            own, first = np.unique(low, return_index=True)
            doc = p.doc[p.first[own]]
            around = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(low)), pa.int32()),
                pa.StructArray.from_arrays([pa.array((p.first[pairs] - p.begins[p.doc[p.first[pairs]]]).astype(np.int32)), pa.array(p.span(pairs).astype(np.int32)), pa.array(p.pair[pairs].view(np.int64))], ["s", "m", "key"]),
            )
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(d[doc]), pa.array(p.hash[own].view(np.int64)), around], ["doc_id", "d", "gram", "around"])

    def counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Pieces(b.column("text").to_pylist(), window)
            gram, n = np.unique(p.hash[np.unique(fingerprints(p)[0])].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    named = rows.where("doc_id is not null")
    grams = named.mapInArrow(marks, f"doc_id {kind}, d int, gram bigint, around array<struct<s:int,m:int,key:bigint>>")
    twice = named.select("text").mapInArrow(counted_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("members")).where("members > 1").withColumn("met", F.lit(True))
    near = with_group(grams, twice, "gram", F.struct("doc_id", F.get("around", F.lit(0))["s"])).where("met").select("doc_id", "d", F.explode("around").alias("x"))
    near = checkpointed(near.select("doc_id", "d", "x.s", "x.m", "x.key"))
    place = F.struct("doc_id", "d", "s")
    first = near.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("members")).where("members > 1")
    later = with_group(near, first, "key", place).where(place > F.col("first"))
    gone = later.groupBy("doc_id", "d").agg(F.collect_list(F.struct("s", "m", F.col("first.doc_id").alias("of"), F.col("first.d").alias("of_d"), F.col("first.s").alias("at"))).alias("marks"))

    # runs, with the first places of their first pair's start and their last pair's end
    def joined_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("marks").flatten()
            doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column("marks")).to_numpy())
            s, m, of, of_d, at = (own.field(k) for k in range(5))
            s, m, at = s.to_numpy(), m.to_numpy(), at.to_numpy()
            order, i, j = long_runs(doc, s, m, min_words)
            i, j = order[i], order[j]
            whose = pa.array(doc[i])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(whose), b.column("d").take(whose), pa.array(s[i]), pa.array(s[j] + m[j]), of.take(pa.array(i)), of_d.take(pa.array(i)), pa.array(at[i]), of.take(pa.array(j)), of_d.take(pa.array(j)), pa.array(at[j] + m[j])],
                ["doc_id", "d", "a", "e", "left_of", "left_d", "left_at", "right_of", "right_d", "right_at"],
            )

    runs = checkpointed(gone.mapInArrow(joined_pairs, f"doc_id {kind}, d int, a int, e int, left_of {kind}, left_d int, left_at int, right_of {kind}, right_d int, right_at int"))
    side = lambda k, name: F.struct(F.lit(k).alias("side"), F.struct(F.col(f"{name}_of").alias("of"), F.col(f"{name}_d").alias("of_d"), F.col(f"{name}_at").alias("at"), F.lit(k).alias("side")).alias("place"))
    asked = runs.select("doc_id", "d", "a", "e", F.explode(F.array(side(0, "left"), side(1, "right"))).alias("x")).select("doc_id", "d", "a", "e", "x.side", "x.place")
    wanted = asked.groupBy("place").agg(F.count("*").alias("members"))
    by_origin = wanted.groupBy(F.col("place.of").alias("doc_id")).agg(F.collect_list(F.struct(F.col("place.of_d").alias("d"), "place.at", "place.side", "members")).alias("wanted"))
    # texts that have no part in any of this stay where they are
    others = [F.col(c) for c in df.columns if c != text_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*others).alias("row")) if keep else df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = perhaps_in(rows, "doc_id", runs.select("doc_id").unionByName(runs.select(F.col("left_of").alias("doc_id"))).unionByName(runs.select(F.col("right_of").alias("doc_id"))).distinct())
    whole = marked.where("_perhaps").drop("_perhaps")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.filter(b.column("wanted").is_valid())
            texts, out = [x or "" for x in asked.column("text").to_pylist()], []
            p = Words(texts)
            for k, (doc, text, wanted) in enumerate(zip(asked.column("doc_id").to_pylist(), texts, asked.column("wanted").to_pylist(), strict=True)):
                d = short_digest(text)
                out += [(doc, d, w["at"], w["side"], w["members"], p.around(k, w["at"], window)[w["side"]]) for w in wanted if w["d"] == d]
            cols = [*zip(*out, strict=True)] or [[]] * 6
            kinds = (b.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["of", "of_d", "at", "side", "members", "words"])

    # this join deals the texts as the last one does; all columns stay, so that one exchange serves both
    told = whole.join(by_origin, "doc_id", "left").mapInArrow(answers, f"of {kind}, of_d int, at int, side int, members bigint, words array<bigint>")
    told = told.groupBy(F.struct("of", "of_d", "at", "side").alias("place")).agg(F.max("members").alias("members"), F.min("words").alias("words"))
    known = with_group(asked, told, "place", F.struct("doc_id", "a"), cut=False).groupBy("doc_id").agg(F.collect_list(F.struct("d", "a", "e", "side", "words")).alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts = [], b.column("text").to_pylist()
            p = Words([x if x and ends else "" for x, ends in zip(texts, b.column("ends").to_pylist(), strict=True)])
            for k, (text, ends) in enumerate(zip(texts, b.column("ends").to_pylist(), strict=True)):
                n, off, d = int(p.counts[k]) if ends else words_in(text), None, short_digest(text or "") if ends else 0
                for x in ends or []:
                    if x["d"] == d:
                        off = np.zeros(n + 1, bool) if off is None else off
                        off[x["a"] : x["e"]] = True
                        at = x["e"] if x["side"] else x["a"]
                        more = common(p.around(k, at, window)[x["side"]], x["words"] or [])
                        off[at if x["side"] else at - more : at + more if x["side"] else at] = True
                if off is None:
                    out.append((text, n, 0, 0))
                    continue
                off[n] = False
                edge = np.flatnonzero(np.diff(off, prepend=False))
                at, base = int(p.begins[k]), int(p.starts[p.begins[k]])
                lead = len(p.parts[k]) - len(p.parts[k].lstrip(b" \t\n\v\f\r"))
                byte = lambda i: len(p.parts[k]) if i == n else int(p.starts[at + i]) - base + lead  # noqa: B023, E731
                kept, since = [], 0
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    kept.append(p.parts[k][since : byte(x)])
                    since = byte(y)
                kept.append(p.parts[k][since:])
                out.append((b"".join(kept).decode(), n, int(off.sum()), len(edge) // 2))
            cols = [*zip(*out, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)), *([b.column("row")] if keep else [])], ["doc_id", "text", "n_words", "n_removed", "n_runs", *(["row"] if keep else [])])

    joined = whole.join(known, "doc_id", "left")
    fields = f"doc_id {kind}, text string, n_words bigint, n_removed bigint, n_runs bigint" + (f", row {joined.schema['row'].dataType.simpleString()}" if keep else "")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([words_in(x) for x in b.column("text").to_pylist()], pa.int64())
            zero = pa.array(np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), n, zero, zero, *([b.column("row")] if keep else [])], ["doc_id", "text", "n_words", "n_removed", "n_runs", *(["row"] if keep else [])])

    return marked.where("not _perhaps").drop("_perhaps").mapInArrow(counted, fields).unionByName(joined.mapInArrow(cut, fields))


_SPACE, WORD_AND_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_AND_SPACE}') AS toks FROM t),
o AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM k),
w AS (SELECT doc_id, i, tok, regexp_replace(tok, '{_SPACE}+$', '') AS w, i = 1 OR contains(lag(tok) OVER (PARTITION BY doc_id ORDER BY i), chr(10)) AS line FROM o),
x AS (SELECT doc_id, i, count(*) OVER own AS n, min(rpad(left(hex(w), 16), 16, '0') || lpad(cast(99999999 - i AS varchar), 8, '0')) OVER own AS low FROM w WINDOW own AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
c AS (SELECT DISTINCT doc_id, 99999999 - cast(right(low, 8) AS bigint) AS i FROM x WHERE n = {WINDOW}),
u AS (SELECT w.doc_id, w.i, w, sum(CASE WHEN line OR c.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS u FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.i),
p AS (SELECT doc_id, u, min(i) AS s, count(*) AS m, string_agg(w, ' ' ORDER BY i) AS content FROM u GROUP BY doc_id, u),
q AS (SELECT doc_id, s, m + lead(m) OVER d AS m, md5(content) || md5(lead(content) OVER d) AS key FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY u)),
f AS (SELECT doc_id, s, s + m AS e, first_value(doc_id) OVER b AS d0, first_value(s) OVER b AS s0 FROM q WHERE key IS NOT NULL WINDOW b AS (PARTITION BY key ORDER BY doc_id, s)),
l AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM f WHERE doc_id <> d0 OR s <> s0),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM l),
r AS (SELECT doc_id, min(s) AS a, max(e) AS e, arg_min(d0, s) AS ld, arg_min(s0, s) AS ls, arg_max(d0, s) AS rd, arg_max(s0 + e - s, s) AS rs FROM g GROUP BY doc_id, run HAVING max(e) - min(s) >= {MIN_WORDS}),
y AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM w GROUP BY doc_id),
z AS (SELECT r.doc_id, a, e, list_reverse(m.ws[greatest(a - {WINDOW}, 1):a - 1]) AS mb, list_reverse(lo.ws[greatest(ls - {WINDOW}, 1):ls - 1]) AS ob, m.ws[e:e + {WINDOW - 1}] AS ma, ro.ws[rs:rs + {WINDOW - 1}] AS oa
  FROM r JOIN y m ON r.doc_id = m.doc_id JOIN y lo ON ld = lo.doc_id JOIN y ro ON rd = ro.doc_id),
v AS (SELECT doc_id, a - len(list_filter(range(1, {WINDOW + 1}), lambda n: n <= len(mb) AND n <= len(ob) AND mb[1:n] = ob[1:n])) AS a, e + len(list_filter(range(1, {WINDOW + 1}), lambda n: n <= len(ma) AND n <= len(oa) AND ma[1:n] = oa[1:n])) AS e FROM z),
h AS (SELECT DISTINCT o.doc_id, o.i FROM o JOIN v ON o.doc_id = v.doc_id AND o.i >= v.a AND o.i < v.e),
b AS (SELECT o.doc_id, o.i, tok, h.i IS NOT NULL AS gone FROM o LEFT JOIN h ON o.doc_id = h.doc_id AND o.i = h.i),
n AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs, string_agg(tok, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM b) GROUP BY doc_id)
SELECT k.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(regexp_extract(text, '^{_SPACE}*') || coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN n ON k.doc_id = n.doc_id
"""


def applied(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of df with their columns, the text without later repeated runs and its characters counted again; rows that had words and have none left go."""
    out = dedup(df, id_col, text_col, window, min_words, keep=True)
    cut, whole = F.col("n_removed") > 0, lambda c: F.col("text") if c == text_col else F.col("row")[c]
    new = {count_col: F.when(cut, F.length("text").cast(df.schema[count_col].dataType)).otherwise(whole(count_col))} if count_col in df.columns else {}
    return out.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*(new.get(c, whole(c)).alias(c) for c in df.columns))
