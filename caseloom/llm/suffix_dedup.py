"""Removal of bytes that repeat an earlier document's, by blockwise suffix sorting with a difference cover.

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id goes; strings are judged
on the input. All suffixes of a corpus are too many to move, so

1. each string is assigned to one anchor, a gram of its own bytes chosen by its content alone (the leftmost of lowest
   hash), and a packed count tells which anchors stand in several documents; strings of other anchors can't repeat;
2. for the shared anchors, runs of neighbouring strings are dealt by anchor hash, so equal strings meet in one task. Equal runs
   are settled at once, within a block of documents before they are sent;
3. a task sorts its suffixes one bucket of anchors at a time: by their first PERIOD bytes, long ties by the precomputed
   rank of the suffix at the next position of a difference cover. Runs are laid out so that anchors fall on multiples of PERIOD;
   equal strings then have equal residues and one rank decides. Neighbours are compared over their whole length.
   Memory is bounded by BUCKET bytes of runs (or one anchor's).

An exact copy of a text with a smaller doc_id is removed as a whole if it holds a string at all. Null text is empty. Rows with
a null doc_id are neither smaller nor larger than any: they keep all bytes. Rows of one doc_id do not remove each other's
bytes. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import runs
from .common import block_key, checkpointed, digest, id_text, planes, shuffle_partitions, small_batches, unplaned, with_long_id
from .graph import with_group

LENGTH, GRAM = 50, 20
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK, BUCKET = 4_000_000, 4_000_000
LOCAL, REF = np.uint32(0xFFFFFFFF), np.uint16
#: From a residue to the next position of the cover.
NEXT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def by_block(batches: Iterator[pa.RecordBatch], cols: tuple[str, ...]) -> Iterator[list[list]]:
    """Columns of some documents at a time, about BLOCK characters of text, the last column."""
    held, size = [[] for _ in cols], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += len(row[-1])
            if size > BLOCK:
                yield held
                held, size = [[] for _ in cols], 0
    if held[0]:
        yield held


def shared_anchors(rows: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """doc_id, places: of anchors that stand in several documents (a few others may be among them)."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_block(batches, ("doc_id", "text")):
            doc, h, at, _, _ = runs([t.encode() for t in texts], length, gram)
            order = np.lexsort((doc, h))
            doc, h, at = doc[order].astype(np.uint32), h[order], at[order].astype(np.uint32)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            several = np.zeros(group[-1] + 1 if len(group) else 0, bool)
            several[group[1:][(doc[1:] != doc[:-1]) & ~new[1:]]] = True
            here = several[group]
            name, key, out = np.array(ids, np.int64), block_key(ids), []
            if here.any():
                by_doc = np.argsort(doc[here], kind="stable")
                used, counts = np.unique(doc[here], return_counts=True)
                out.append((-1, key, b"", b"", name[used].tobytes(), counts.astype(np.int64).tobytes(), planes(at[here][by_doc])))
            sent = np.flatnonzero(~here | new)
            to = (h[sent] % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(to, kind="stable")
            for q, k in zip(*grouped(to[by_bucket], sent[by_bucket]), strict=True):
                k = k[np.argsort(order[k])]  # in the order of documents, which compresses
                own = ~here[k]
                used, ref = np.unique(doc[k][own], return_inverse=True)
                short = np.full(len(k), LOCAL, np.uint32)
                short[own] = ref
                out.append((q, key, (h[k] >> np.uint64(20)).astype(np.uint32).tobytes(), short.astype(REF).tobytes() if len(used) < 65535 else short.tobytes(), name[used].tobytes(), b"", planes(at[k])))
            if out:
                cols = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["q", "block", "h", "ref", "ids", "counts", "at"])

    def answers(table: pa.Table) -> pa.Table:
        names = ["block", "ids", "counts", "at"]
        if table["q"][0].as_py() < 0:  # settled in its block
            return table.select(names)
        hs = [np.frombuffer(x, np.uint32) for x in table["h"].to_pylist()]
        refs = [reference(x, len(y)) for x, y in zip(table["ref"].to_pylist(), hs, strict=True)]
        # one entry for each block and hash; those that were settled in a block count twice
        once = [np.concatenate([np.unique(x), x[r == LOCAL]]) for x, r in zip(hs, refs, strict=True)]
        unique, counts = np.unique(np.concatenate(once), return_counts=True)
        unique = unique[counts > 1]
        out = []
        for block, x, r, name, at in zip(table["block"].to_pylist(), hs, refs, table["ids"].to_pylist(), table["at"].to_pylist(), strict=True):
            k = np.searchsorted(unique, x)
            hit = k < len(unique)
            hit[hit] = unique[k[hit]] == x[hit]
            hit &= r != LOCAL
            order = np.argsort(r[hit], kind="stable")
            used, counts = np.unique(r[hit], return_counts=True)
            if len(used):
                out.append((block, np.frombuffer(name, np.int64)[used].tobytes(), counts.astype(np.int64).tobytes(), planes(unplaned(at)[hit][order])))
        cols = [*zip(*out, strict=True)] or [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def by_document(table: pa.Table) -> pa.Table:
        """A block's answers, one row a document."""
        of: dict[int, list[np.ndarray]] = {}
        for name, counts, at in zip(table["ids"].to_pylist(), table["counts"].to_pylist(), table["at"].to_pylist(), strict=True):
            for doc, part in zip(np.frombuffer(name, np.int64).tolist(), np.split(unplaned(at), np.cumsum(np.frombuffer(counts, np.int64))[:-1]), strict=True):
                of.setdefault(doc, []).append(part)
        return pa.table([pa.array(of, pa.int64()), pa.array([np.concatenate(x).tobytes() for x in of.values()], pa.binary())], ["doc_id", "places"])

    asked = rows.mapInArrow(requests, "q int, block bigint, h binary, ref binary, ids binary, counts binary, at binary")
    spread = F.when(F.col("q") < 0, -1 - F.pmod(F.xxhash64("ids"), F.lit(4096)).cast("int")).otherwise(F.col("q"))
    return asked.withColumn("q", spread).groupBy("q").applyInArrow(answers, "block bigint, ids binary, counts binary, at binary").groupBy("block").applyInArrow(by_document, "doc_id bigint, places binary")


def reference(data: bytes, n: int) -> np.ndarray:
    """Documents' numbers, in two bytes if that is enough."""
    if len(data) == 4 * n:
        return np.frombuffer(data, np.uint32)
    short = np.frombuffer(data, REF)
    return np.where(short == 0xFFFF, LOCAL, short.astype(np.uint32))


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """values by sorted keys."""
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts)


def repeats(contexts: list[bytes], anchor: np.ndarray, doc: np.ndarray, length: int) -> list[np.ndarray]:
    """For runs of strings around one bucket's anchors: which starts' strings also start in another run with a smaller doc.

    anchor: each run's anchor place within it. Suffixes are sorted by their first PERIOD bytes, residue and cover rank.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    lead = -anchor % PERIOD
    room = -(-(lead + sizes + length + 16) // PERIOD) * PERIOD
    begin = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()) + 64, np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    # the eight bytes at each place as one number, so that numbers compare as strings do
    word = np.zeros(len(text) - 8, np.uint64)
    for k in range(8):
        word |= text[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    starts = sizes - length + 1
    run = np.repeat(np.arange(len(contexts)), starts)
    at = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + begin[run]
    residue = at % PERIOD
    sample = at + NEXT[residue]
    covered = np.unique(sample)
    words = range(0, length, 8)
    order = np.lexsort([word[np.minimum(covered + k, len(word) - 1)] for k in reversed(words)])
    rank = np.empty(len(covered), np.int64)
    rank[order] = np.arange(len(covered))
    tail = word[at + 8] >> np.uint64(64 - 8 * (PERIOD - 8))
    order = np.lexsort((rank[np.searchsorted(covered, sample)], residue, tail, word[at]))
    at, own = at[order], doc[run[order]]
    same = np.ones(max(0, len(at) - 1), bool)
    for k in range(0, length - 7, 8):
        same &= word[at[1:] + k] == word[at[:-1] + k]
    same &= word[at[1:] + length - 8] == word[at[:-1] + length - 8]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(at) else np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(own, heads)[group] if len(at) else own
    hit = np.zeros(len(at), bool)
    hit[order] = own > least
    return np.split(hit, np.cumsum(starts)[:-1])


def repeated_runs(rows: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """rows (doc_id, places, text) -> doc_id, crc (of the text), spans: pairs of first and last starts whose strings also start in a smaller doc."""
    names = ["q", "doc_id", "crc", "ref", "first", "anchor", "sizes", "bytes"]

    def row(q: int, entries: list[tuple], contexts: list[bytes]) -> tuple:
        doc, crc, first, anchor, _, size = zip(*entries, strict=True)
        texts = {x: k for k, x in enumerate(dict.fromkeys(zip(doc, crc, strict=True)))}
        ids, crcs = zip(*texts, strict=True)
        ref = [texts[x] for x in zip(doc, crc, strict=True)]
        return q, np.array(ids, np.int64).tobytes(), np.array(crcs, np.uint32).tobytes(), *(planes(np.array(x, np.uint32)) for x in (ref, first, anchor, size)), b"".join(contexts)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, places, texts in by_block(batches, ("doc_id", "places", "text")):
            parts = [t.encode() for t in texts]
            crcs = [short_digest(p) for p in parts]
            doc, h, at, first, last = runs(parts, length, gram)
            offsets = np.cumsum([0, *(len(p) for p in parts)])
            wanted = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + offsets[k] for k, xs in enumerate(places) for x in xs])
            keep = np.flatnonzero(np.isin(at + offsets[doc], wanted))
            # of equal runs, those of the smallest doc_id are sent, all others are settled
            leaders: dict[bytes, list[tuple]] = {}
            settled: list[tuple] = []
            for d, hh, a, f, z in zip(*(x[keep].tolist() for x in (doc, h, at, first, last)), strict=True):
                context = parts[d][f : z + length]
                entry = (ids[d], crcs[d], f, a - f, hh, len(context))
                had = leaders.get(context)
                if had is None or entry[0] < had[0][0]:
                    settled += had or []
                    leaders[context] = [entry]
                else:
                    (had if entry[0] == had[0][0] else settled).append(entry)
            by: dict[int, tuple[list, list]] = {}
            for context, entries in leaders.items():
                e, c = by.setdefault(entries[0][4] % buckets, ([], []))
                e += entries
                c += [context] * len(entries)
            out = [row(q, e, c) for q, (e, c) in by.items()] + ([row(-1, settled, [])] if settled else [])
            if out:
                cols = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def answers(table: pa.Table) -> pa.Table:
        load = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
        first, anchor, sizes = (np.concatenate([unplaned(x) for x in table[c].to_pylist()]).astype(np.int64) for c in ("first", "anchor", "sizes"))
        refs = [unplaned(x) for x in table["ref"].to_pylist()]
        doc, crc = (np.concatenate([x[r] for x, r in zip(load(c, t), refs, strict=True)]) for c, t in (("doc_id", np.int64), ("crc", np.uint32)))
        if table["q"][0].as_py() < 0:  # settled in its block
            return spans(doc, crc, np.stack([first, first + sizes - length], 1))
        contexts, data = [], b"".join(table["bytes"].to_pylist())
        for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            contexts.append(data[end - n : end])
        least: dict[bytes, int] = {}
        for c, d in zip(contexts, doc.tolist(), strict=True):
            if (had := least.get(c)) is None or d < had:
                least[c] = d
        whole = np.array([d > least[c] for c, d in zip(contexts, doc.tolist(), strict=True)])
        out = [(doc[whole], crc[whole], np.stack([first, first + sizes - length], 1)[whole])]
        rest = np.flatnonzero(~whole)
        _, h = np.unique(np.array([contexts[k][anchor[k] : anchor[k] + gram] for k in rest.tolist()], f"S{gram}"), return_inverse=True)
        by_anchor = np.argsort(h, kind="stable")
        _, parts = grouped(h[by_anchor], rest[by_anchor])
        bucket: list[np.ndarray] = []
        held = 0
        for k, part in enumerate(parts):
            if doc[part].min() < doc[part].max():
                bucket.append(part)
                held += int(sizes[part].sum())
            if bucket and (held > BUCKET or k == len(parts) - 1):
                at = np.concatenate(bucket)
                # runs of different anchors of one bucket can't hold equal strings
                for x, hit in zip(at.tolist(), repeats([contexts[i] for i in at.tolist()], anchor[at], doc[at], length), strict=True):
                    if hit.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                        pairs = edge.reshape(-1, 2) + first[x] - [0, 1]
                        out.append((np.full(len(pairs), doc[x]), np.full(len(pairs), crc[x]), pairs))
                bucket, held = [], 0
        return spans(*(np.concatenate(x) for x in zip(*out, strict=True)))

    asked = rows.mapInArrow(requests, "q int, doc_id binary, crc binary, ref binary, first binary, anchor binary, sizes binary, bytes binary")
    spread = F.when(F.col("q") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("int")).otherwise(F.col("q"))
    return asked.withColumn("q", spread).groupBy("q").applyInArrow(answers, "doc_id bigint, crc bigint, spans binary")


def short_digest(data: bytes) -> int:
    """Tells apart texts of one doc_id."""
    return int.from_bytes(hashlib.md5(data).digest()[:4], "little")


def spans(doc: np.ndarray, crc: np.ndarray, pairs: np.ndarray) -> pa.Table:
    order = np.lexsort((crc, doc))
    doc, crc, pairs = doc[order].astype(np.int64), crc[order].astype(np.int64), pairs[order].astype(np.int64)
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])) + 1
    heads = np.concatenate([[0], cuts]).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    parts = np.split(pairs, cuts) if len(doc) else []
    return pa.table([pa.array(doc[heads], pa.int64()), pa.array(crc[heads], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "crc", "spans"])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of struct of start, end in bytes) of each row."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = shuffle_partitions(spark)
    rows = with_long_id(id_text(df, id_col, text_col))
    known = rows.where("doc_id is not null")
    names = known.select("doc_id", digest(F.col("text")).alias("digest"))
    classes = names.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    copies = checkpointed(with_group(names, classes.where("members > 1"), "digest", F.col("doc_id")).where("least < doc_id").groupBy("doc_id").agg(F.collect_set("digest").alias("copies")))
    places = shared_anchors(known, length, gram, buckets).groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    mark = F.coalesce(F.array_contains("copies", digest(F.col("text"))), F.lit(False))
    dealt = known.repartition(buckets, "doc_id")  # one exchange of the texts for both joins
    first = dealt.join(places, "doc_id").join(copies, "doc_id", "left").where(~mark).select("doc_id", "places", "text")
    found = repeated_runs(first, length, gram, buckets).groupBy("doc_id").agg(F.collect_list(F.struct("crc", "spans")).alias("found"))
    last = dealt.join(found, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "found", mark.alias("copy"))
    last = last.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<crc:bigint,spans:binary>>").alias("found"), F.lit(False).alias("copy")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found, copy in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), b.column("copy").to_pylist(), strict=True):
                data = text.encode()
                gone: list[list[int]] = []
                if copy:
                    gone = [[0, len(data)]] if len(data) >= length else []
                elif found:
                    crc = short_digest(data)
                    pairs = np.concatenate([np.frombuffer(x["spans"], np.int64) for x in found if x["crc"] == crc] or [np.zeros(0, np.int64)]).reshape(-1, 2)
                    for a, z in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], z + length)
                        else:
                            gone.append([a, z + length])
                kept, at = hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                out.append((len(data), sum(z - a for a, z in gone), len(gone), kept.hexdigest(), [{"start": a, "end": z} for a, z in gone]))
            cols = [*zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return last.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>")
