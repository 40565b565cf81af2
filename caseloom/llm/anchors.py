"""Content-chosen anchors: every `length`-byte string has one `gram`-byte anchor, whichever document it stands in."""

from __future__ import annotations

import numpy as np

from .hashing import mixed

_CASED = np.random.default_rng(77).integers(1, 1 << 63, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all gram-byte strings."""
    width, x = 1, _CASED[buf]
    left, at, total = gram, 0, None
    while left:
        if left & 1:
            part = x[at : at + len(buf) - gram + 1]
            total = part.copy() if total is None else total * np.uint64(pow(_STEP, width, 1 << 64)) + part
            at += width
        left >>= 1
        if left:
            x = x[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + x[width:]
            width *= 2
    return mixed(total)


def sliding_min(v: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while width * 2 <= window:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (window - width)], v[window - width :]) if window > width else v


def runs(parts: list[bytes], length: int = 50, gram: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor hash, anchor place, first start, last start) of each run of starts whose strings have one anchor; places count from the document's first byte."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(parts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(buf, gram)
    low = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(len(buf) + 1, np.int8)
    whole = sizes >= length
    np.add.at(step, begins[whole], 1)
    np.add.at(step, begins[whole] + sizes[whole] - length + 1, -1)
    valid = np.cumsum(step, dtype=np.int8)[: len(anchor)] > 0
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(change)
    stop = valid & ~np.concatenate([valid[1:] & (anchor[1:] == anchor[:-1]), [False]])
    last = np.flatnonzero(stop)
    doc = np.searchsorted(begins, first, "right") - 1
    at = anchor[first]
    return doc, h[at], at - begins[doc], first - begins[doc], last - begins[doc]
