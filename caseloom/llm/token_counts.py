"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are emitted.

A text is split at the vocabulary's added strings, each rest into pieces by the byte-level pattern, and each piece is
counted on its own: every byte is a symbol, the adjacent pair of lowest rank is popped from a heap and merged in a
linked list until none is left, and the count is symbols minus merges. The counts of recent pieces are kept in a
bounded table, so common words are merged once.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give their row. Only the id and text columns are
read, so other columns may have any name. A text's length does not matter: memory follows its longest piece.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import id_text, small_batches

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ƺ"
#: The plain pattern is equal to the full one on texts of these characters alone, and faster.
PLAIN = re.compile(rf"[\t\n\r -~{LETTERS}]*")
PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEPT_PIECES = 400_000


def printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """Ranks of a byte-pair vocabulary and the counts of recent pieces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        before, model = table.get("pre_tokenizer") or {}, table["model"]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not table.get("normalizer")
        plain = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(t.get(k) for t in table.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocab = model["vocab"]
        self.first = [vocab[c] for _, c in sorted(printable_bytes().items())]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(table["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        added = sorted((t["content"] for t in table.get("added_tokens") or []), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = Known(self)

    def merged(self, data: bytes) -> int:
        """Symbols of one piece after all merges."""
        n = left = len(data)
        if n < 2:
            return n
        rank, made, first = self.rank, self.made, self.first
        ids = [first[b] for b in data]
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 20 | ids[j]) != r:
                continue  # one of its symbols has gone into another pair
            ids[i], ids[j] = made[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, r * n + h)
        return left

    def count(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total, at = total + self._plain(text[at : m.start()]) + 1, m.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        pieces = PLAIN_PIECES if PLAIN.fullmatch(text) else PIECES
        return sum(map(self.known.__getitem__, pieces.findall(text)))


class Known(dict):
    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.merged(piece.encode())
        if len(piece) < 64:
            self[piece] = n
        return n


@functools.lru_cache(maxsize=4)
def merges_at(path: str) -> Merges:
    return Merges(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of df; path: a byte-level BPE .json that every executor can open."""
    small_batches(df.sparkSession)
    base = id_text(df, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_at(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(merges.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
