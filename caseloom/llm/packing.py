"""Bounded-space online packing of tokenized documents into windows.

Each partition keeps a fixed number of open windows. A document is cut into whole windows and a rest; the rest goes into
the open window that it fills best. When none has room, the fullest open window is emitted and a new one opened. Windows
still open at a partition's end are merged in a second step over groups of partitions, so each task holds at most the
open windows of GROUP partitions, as piece records without tokens.

Null and empty texts are a single end token. Repeated rows are packed as often as they occur. Only the id and text
columns are read. A text of any length is cut into windows; only its own tokens are held. sequence_id holds the
partition, so a rerun over the same files gives the same sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_text, small_batches
from .token_counts import LETTERS, PIECES, PLAIN, PLAIN_PIECES

WINDOW, OPEN, GROUP, END_ID, KEPT_PIECES, AT_ONCE, CALL = 2048, 64, 16, 1, 140_000, 1 << 16, 200
#: Such pieces laid end to end are split into the same pieces again, so many are encoded in one call.
SPACED = re.compile(f" [{LETTERS}]{{1,62}}")
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces(dict):
    """The library's ids, as bytes, of pieces that a byte-level vocabulary encodes on their own; two generations of KEPT_PIECES are kept, so that common ones stay."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.whole = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        before, added = table.get("pre_tokenizer") or {}, table.get("added_tokens") or []
        self.apart = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not table.get("normalizer")
        self.apart = self.apart and table["model"]["type"] == "BPE" and not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word"))
        words = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, words))) if words else None
        vocab = self.whole.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[k for w, k in vocab.items() if w.startswith("\u0120")]] = True

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces ahead, those of a space and letters CALL at a time; the rest is left to __missing__."""
        if self.old:
            known = {p for p in pieces if p in self.old}
            self.update((p, self.old[p]) for p in known)
            pieces = pieces - known
        words = [*filter(SPACED.fullmatch, pieces)]
        for k in range(0, len(words), CALL):
            own = words[k : k + CALL]
            text = "".join(own)
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
            at = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(at) == len(own) and not (self.added and self.added.search(text)):
                data = ids.tobytes()
                self.update((w, data[i:j]) for w, i, j in zip(own, at, [*at[1:], len(data)], strict=True))

    def split(self, text: str) -> list[str]:
        """Added strings of the vocabulary and the pieces between them."""
        parts, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            parts += [*split(text[at : m.start()]), m[0]]
            at = m.end()
        return parts + split(text[at:] if at else text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, then the end token."""
        end = np.array([END_ID], "<u4").tobytes()
        if not self.apart:
            return [np.array([*self.whole.encode(t, add_special_tokens=False).ids, END_ID], "<u4") for t in texts]
        if len(self) > KEPT_PIECES:
            self.old = dict(self)
            super().clear()
        parts = [*map(self.split, texts)]
        self.learn(set(filterfalse(self.__contains__, set(chain.from_iterable(parts)))))
        return [np.frombuffer(b"".join([*map(self.__getitem__, p), end]), "<u4") for p in parts]


def split(text: str) -> list[str]:
    return (PLAIN_PIECES if PLAIN.fullmatch(text) else PIECES).findall(text)


@functools.lru_cache(maxsize=2)
def pieces_at(path: str) -> Pieces:
    return Pieces(path)


def encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, then the end token; texts are taken together up to AT_ONCE characters."""
    known, some, n = pieces_at(path), [], 0
    for text in texts:
        if some and n + len(text) > AT_ONCE:
            yield from known.ids(some)
            some, n = [], 0
        some.append(text)
        n += len(text)
    yield from known.ids(some) if some else ()


class Open:
    """Open windows by room, for best fit; each a list of pieces."""

    def __init__(self, most: int) -> None:
        self.most, self.rooms, self.windows = most, [], {}
        self.made = 0

    def put(self, length: int, pieces: list, window: int) -> list | None:
        """Places the pieces; returns a window that has to be emitted for that, if any."""
        out = None
        k = bisect_left(self.rooms, (length, -1))
        if k < len(self.rooms):
            room, name = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most:
                out = self.windows.pop(self.rooms.pop(0)[1])
            room, name = window, self.made
            self.made += 1
            self.windows[name] = []
        self.windows[name].extend(pieces)
        if room == length:
            full = self.windows.pop(name)
            return full if out is None else [out, full]
        insort(self.rooms, (room - length, name))
        return out


def emitted(out: list | None) -> list[list]:
    """The windows that put() returned, as a list."""
    return [] if not out else out if isinstance(out[0], list) else [out]


def packed_rows(windows: list[list], first: int) -> list[tuple]:
    rows = []
    for k, pieces in enumerate(windows):
        offset = 0
        for doc, start, length, crc, total in pieces:
            rows.append((doc, start, length, crc, total, first + k, offset))
            offset += length
    return rows


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(df.sparkSession, 200)
    base = id_text(df, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = [*PIECE, "open"]

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made, open_ = TaskContext.get().partitionId(), 0, Open(open_windows)
        schema: pa.Schema | None = None

        def batch_of(rows: list[tuple], still: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([still] * len(rows))], names)

        for batch in batches:
            schema, done = batch.schema.field("doc_id").type, []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path), strict=True):
                n = len(ids)
                cuts = [(doc, s, min(window, n - s), zlib.crc32(ids[s : s + window].tobytes()), n) for s in range(0, n, window)]
                if cuts[-1][2] == window:
                    done.extend([c] for c in cuts)
                    continue
                done.extend([c] for c in cuts[:-1])
                done.extend(emitted(open_.put(cuts[-1][2], [cuts[-1]], window)))
            if done:
                yield batch_of(packed_rows(done, (pid << 32) + made), False)
                made += len(done)
        pieces_at(path).clear()  # an idle worker keeps no table
        if open_.windows:
            yield batch_of(packed_rows([*open_.windows.values()], (pid << 32) + made), True)

    def merge(table: pa.Table) -> pa.Table:
        """Whole open windows into each other, the largest first, each where it fits best."""
        bins: dict[int, list[tuple]] = {}
        for row in sorted(zip(*(table[c].to_pylist() for c in PIECE), strict=True), key=lambda r: r[5:]):
            bins.setdefault(row[5], []).append(row)
        open_, done = Open(1 << 62), []
        filled = lambda b: b[-1][2] + b[-1][6]
        for pieces in sorted(bins.values(), key=lambda b: (-filled(b), b[0][5])):
            done += emitted(open_.put(filled(pieces), [p[:5] for p in pieces], window))
        cols = zip(*packed_rows([*done, *open_.windows.values()], min(bins)), strict=True)
        return pa.table([pa.array(c, table.schema.field(name).type) for c, name in zip(cols, PIECE, strict=True)], [*PIECE])

    pieces = base.mapInArrow(online, f"{fields}, open boolean")
    return merged_leftovers(pieces, merge, fields, group)


def merged_leftovers(pieces: DataFrame, merge, fields: str, group: int) -> DataFrame:
    """Closed windows as they are; open ones by groups of partitions. One pass: closed rows go through the same exchange, spread by their window."""
    key = F.when(F.col("open"), F.shiftright("sequence_id", 32).cast("bigint") / group).cast("bigint")
    tagged = pieces.withColumn("g", key)

    def either(table: pa.Table) -> pa.Table:
        return merge(table) if table["open"][0].as_py() else table.select([*PIECE])

    spread = F.coalesce(-1 - F.pmod(F.xxhash64("sequence_id"), F.lit(4096)), F.lit(0))
    return tagged.withColumn("g", F.coalesce("g", spread)).groupBy("g").applyInArrow(either, fields)
