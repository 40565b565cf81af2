"""64-bit hashes of words and shingles of many texts at once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
_SIZES, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes([*range(65), *range(97, 123), *range(91, 256)])
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
SEGMENT, LONG = 1 << 18, 512


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight(data: bytes, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, of those left of its word, as a number that orders like them."""
    found = np.ndarray(len(data) + 1, ">u8", data + b"\0" * 8, strides=(1,))[at].astype(np.uint64)
    spare = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
    return (found >> spare) << spare


def _segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; bytes are taken eight at a time."""
    space = np.ones(len(data) + 2, bool)
    _SPACE.take(np.frombuffer(data, np.uint8), out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    h = mixed(eight(data, starts, size) + size.astype(np.uint64) * _SIZES)
    k, rest = 8, np.flatnonzero(size > 8)
    while len(rest) and k < LONG:
        h[rest] = mixed(h[rest] * _NEXT + eight(data, starts[rest] + k, size[rest] - k))
        k += 8
        rest = rest[size[rest] > k]
    for i in rest.tolist():
        more = hashlib.blake2b(data[starts[i] + k : ends[i]], digest_size=8).digest()
        h[i] = mixed(h[i : i + 1] * _NEXT + np.frombuffer(more, "<u8"))[0]
    return h, starts, ends


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words (runs of bytes other than white space, A-Z lower-cased), end to end, and their number in each text."""
    return places([t.encode() for t in texts])[:2]


def places(parts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of the words of all texts, end to end: hashes, their number in each text, starts and ends in the texts joined by line feeds, and that text."""
    data = b"\n".join(parts)
    folded = data.translate(LOWER) if fold else data
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    hashes, where, until, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            m = _BREAK.search(data, end)
            end = m.start() if m else len(data)
        h, s, e = _segment(folded[at:end])
        hashes.append(h)
        where.append(s + at)
        until.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), data
    starts = np.concatenate(where)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, begins)), starts, np.concatenate(until), data


def shingle_sets(texts: list[str], k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with fewer words the whole sequence is the one shingle."""
    h, counts = words(texts)
    long = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        long += h[j : j + len(long)] * _PLACES[j]
    long = mixed(long)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(long[at : at + n - k + 1])
        elif n:
            yield mixed((h[at : at + n] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACES[15] * np.full(1, n, np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
