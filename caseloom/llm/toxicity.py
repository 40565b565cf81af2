"""Toxic spans by a linear-chain conditional random field over words, aggregated to document scores.

Labels are given for documents only, so training first marks tokens: words that tell toxic from clean training documents
are picked greedily, each for the toxic documents that no earlier word explains, then the other frequent ones (MOST_SEEDS at most), and their
places in toxic documents are the toxic tokens. Then, language by language, pieces of words (4-7 characters with the word's edges) are picked
that make up a share of a text's words in toxic documents and hardly ever in clean ones; where they make up that share, in any document,
the words with them are toxic tokens, elsewhere not. The field has two states, features of the word itself (identity, prefix, suffix, length)
or, where it has picked pieces, of their share of the whole text. Emission weights, transitions and start are fitted together to the
likelihood of the marked tokens of whole texts, each a chain, by gradient steps (marked less expected counts). Forward-backward marginals of all
tokens of a whole text give its score, the largest marginal, and the offsets of runs of tokens at or above one half.

Fitting reads at most MOST_TOXIC and MOST_CLEAN labelled texts, chosen by hash of the id, whole, copies once; scoring reads every text.
Null and empty texts, and texts without words, score 0. Equal texts get equal scores. Rows with a null id are scored but
never used for fitting. Without any toxic training document every score is 0. Only the named columns are read. A text
of any length is scored as one chain, its forward and backward messages computed over blocks of tokens; a pass takes texts of
about PASS characters together, so memory is bounded by the longest text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, small_batches

WORD = re.compile(r"[^\W\d_]+")
MOST_TOXIC, MOST_CLEAN, MOST_SEEDS, SLOTS, EPOCHS, KEPT, PASS = 1500, 3000, 400, 1 << 16, 60, 300_000, 1_000_000
#: Shares of a text's words that a piece is judged at, the least part of a language's toxic documents it must have it in, and the largest of its clean ones.
SHARES, COVERS, STRAYS = (0.005, 0.0075, 0.01, 0.0125, 0.015, 0.02), 0.1, 0.01


def slot(key: str) -> int:
    return zlib.crc32(key.encode()) % SLOTS


def pieces(word: str) -> set[str]:
    x = f"^{word}$"
    return {x[i : i + n] for n in range(4, 8) for i in range(len(x) - n + 1)}


def features(word: str, found: list[str] | tuple = (), full: list[str] | tuple = ()) -> list[int]:
    """found: picked pieces of the word, which then tell instead of its spelling; full: those that have their share of the text."""
    if found:
        return [slot(f"{'d' if x in full else 'z'}:{x}") for x in found]
    keys = (f"w:{word}", f"p:{word[:3]}", f"s:{word[-3:]}", f"n:{min(len(word), 12)}")
    return [slot(k) for k in keys]


@dataclass
class Field:
    """weights: of state 1 against state 0, by feature slot; trans: log potentials from state to state; start: of state 1; picked: pieces with the share they tell from."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    empty: bool = False
    picked: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)
    carried: dict[str, list[str]] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        if (e := self.known.get(word)) is None:
            if len(self.known) > KEPT:
                self.known.clear()
            found = [x for x in self.picked if x in f"^{word}$"]
            e = float(self.weights[features(word, found)].sum())
            self.known[word] = e
            if found:
                self.carried[word] = found
        return e

    def emissions(self, words: list[str]) -> list[float]:
        known, carried = self.known, self.carried
        out = [known[w] if w in known else self.emission(w) for w in words]
        own = [(k, carried[w]) for k, w in enumerate(words) if w in carried]
        for k, found in dense(own, len(words), self.picked).items():
            out[k] = float(self.weights[features(words[k], carried[words[k]], found)].sum())
        return out

    def marginals(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of state 1, for chains laid end to end; first: true where a chain begins."""
        return chained(emissions, first, np.exp(self.trans), self.start)[0]


def chained(emissions: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, width: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward marginals, and the expected number of steps from state to state.

    Products of 2x2 step matrices within blocks, for all blocks at once, then along the blocks, then messages inside them.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    blocks = -(-n // width)
    e = np.zeros(blocks * width)
    e[:n] = np.clip(emissions, -30, 30)
    begins = np.ones(blocks * width, bool)
    begins[:n] = first
    # one row a step of all blocks, which lie side by side
    lift = 1 / (1 + np.exp(-e.reshape(blocks, width).T))
    begins = np.ascontiguousarray(begins.reshape(blocks, width).T)
    head = 1 / (1 + np.exp(-start))
    # m[i][j]: from state i before a token to state j at it; at a chain's beginning the state before doesn't matter
    m = [[np.where(begins, (1 - head, head)[j], trans[i, j]) * (1 - lift, lift)[j] for j in range(2)] for i in range(2)]
    p = [[np.ones(blocks) if i == j else np.zeros(blocks) for j in range(2)] for i in range(2)]
    for t in range(width):
        p = [[p[i][0] * m[0][j][t] + p[i][1] * m[1][j][t] for j in range(2)] for i in range(2)]
        scale = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[x / scale for x in row] for row in p]
    whole = np.array(p).transpose(2, 0, 1)
    alpha, state = np.empty((blocks, 2)), np.array([1 - head, head])
    for b in range(blocks):
        alpha[b] = state
        state = state @ whole[b]
        state /= state.sum()
    beta, state = np.empty((blocks, 2)), np.ones(2)
    for b in range(blocks - 1, -1, -1):
        beta[b] = state
        state = whole[b] @ state
        state /= state.sum()
    a0, a1 = alpha.T
    forward = np.empty((width + 1, 2, blocks))
    forward[0] = a0, a1
    for t in range(width):
        b0, b1 = a0 * m[0][0][t] + a1 * m[1][0][t], a0 * m[0][1][t] + a1 * m[1][1][t]
        a1 = b1 / (b0 + b1)
        a0 = 1 - a1
        forward[t + 1] = a0, a1
    out, steps = np.empty((width, blocks)), np.zeros((2, 2))
    inner = ~begins
    z0, z1 = beta.T
    for t in range(width - 1, -1, -1):
        joint = forward[t + 1, 1] * z1
        out[t] = joint / (forward[t + 1, 0] * z0 + joint)
        to = [[forward[t, i] * m[i][j][t] * (z0, z1)[j] for j in range(2)] for i in range(2)]
        weight = np.where(inner[t], 1 / (to[0][0] + to[0][1] + to[1][0] + to[1][1]), 0)
        steps += [[float((x * weight).sum()) for x in row] for row in to]
        b0, b1 = m[0][0][t] * z0 + m[0][1][t] * z1, m[1][0][t] * z0 + m[1][1][t] * z1
        z0, z1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return out.T.reshape(-1)[:n], steps


def telling_words(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Greedily, the word of most toxic documents yet unexplained that at most one in 500 clean documents has; until a word explains under 1 % of them. Then such words as 5 % of all have."""
    in_clean = Counter(w for d in clean for w in set(d))
    left = [s for d in toxic if (s := {w for w in d if len(w) > 2 and in_clean[w] <= len(clean) / 500})]
    least, chosen, often = max(2.0, 0.01 * len(toxic)), set(), Counter(w for s in left for w in s)
    while len(chosen) < MOST_SEEDS:
        counts = Counter(w for s in left for w in s)
        if not counts:
            break
        top = max(counts.values())
        if top < least:
            break
        word = min(w for w, c in counts.items() if c == top)
        chosen.add(word)
        left = [s for s in left if word not in s]
    return chosen | {w for w, c in often.items() if c >= max(least, 0.05 * len(toxic))}


def dense(own: list[tuple[int, list[str]]], n: int, picked: dict[str, float]) -> dict[int, list[str]]:
    """Of the places of words with picked pieces in a text of n words, those with pieces that have their share of it, and are in two words or more."""
    counts = Counter(x for _, found in own for x in found)
    full = {x for x, c in counts.items() if c > 1 and c >= picked[x] * n}
    return {k: here for k, found in own if (here := [x for x in found if x in full])} if full else {}


def telling_pieces(toxic: list[tuple[str, list[str]]], clean: list[tuple[str, list[str]]], seeds: set[str]) -> dict[str, float]:
    """For each language, greedily, the piece and share that most toxic documents yet unexplained reach, less ten times the part of clean ones.

    Seeds that a third of a language's toxic documents have explain their documents.
    """
    split: dict[str, list[str]] = {}

    def shares(words: list[str], only: set[str] | None = None) -> dict[str, int]:
        """Pieces with the number of SHARES that they reach."""
        counts: Counter = Counter()
        for w, c in Counter(words).items():
            if (own := split.get(w)) is None:
                own = split[w] = [x for x in pieces(w) if only is None or x in only]
            for x in own:
                counts[x] += c
        least = max(2, SHARES[0] * len(words))
        return {x: sum(c >= s * len(words) for s in SHARES) for x, c in counts.items() if c >= least}

    chosen: dict[str, float] = {}
    reached = [(lang, shares(d)) for lang, d in toxic]
    sizes = Counter(lang for lang, _ in toxic)
    had = Counter((lang, x) for lang, own in reached for x in own)
    seen = Counter((lang, w) for lang, d in toxic for w in seeds.intersection(d))
    plain = [any(3 * seen[lang, w] >= sizes[lang] for w in seeds.intersection(d)) for lang, d in toxic]
    able = {x for (lang, x), c in had.items() if c >= max(3, COVERS * sizes[lang])}
    split.clear()
    held, strays = Counter(lang for lang, _ in clean), Counter()
    for lang, d in clean:
        strays.update((lang, x, k) for x, n in shares(d, able).items() for k in range(n))
    stray = lambda x, k: max((strays[lang, x, k] / n for lang, n in held.items()), default=0.0)
    for lang in sorted(sizes):
        left = [{x: n for x, n in own.items() if x in able} for (of, own), p in zip(reached, plain, strict=True) if of == lang and not p]
        least = max(3, COVERS * sizes[lang])
        while True:
            counts = Counter((x, k) for own in left for x, n in own.items() for k in range(n))
            worth = {(x, k): c / sizes[lang] - 10 * s for (x, k), c in counts.items() if c >= least and (s := stray(x, k)) <= STRAYS}
            if not worth:
                break
            x, k = min(worth, key=lambda g: (-worth[g], -len(g[0]), g))
            chosen[x] = min(SHARES[k], chosen.get(x, 1.0))
            left = [own for own in left if own.get(x, 0) <= k]
    return chosen


def fitted(toxic: list[tuple[str, str]], clean: list[tuple[str, str]]) -> Field:
    """Texts with their languages."""
    bad = [(lang, WORD.findall(t.lower())) for t, lang in sorted({(t, lang) for lang, t in toxic})]
    good = [(lang, WORD.findall(t.lower())) for t, lang in sorted({(t, lang) for lang, t in clean})]
    seeds = telling_words([d for _, d in bad], [d for _, d in good])
    picked = telling_pieces(bad, good, seeds)
    if not seeds and not picked:
        return Field(np.zeros(1), np.zeros((2, 2)), 0.0, empty=True)
    carried: dict[str, list[str]] = {}
    kinds: dict[tuple[str, tuple[str, ...]], int] = {}
    kind, first, marked = [], [], []
    for d, toxic_text in [*((d, True) for _, d in bad), *((d, False) for _, d in good)]:
        for w in d:
            if w not in carried:
                carried[w] = [x for x in picked if x in f"^{w}$"]
        full = dense([(k, carried[w]) for k, w in enumerate(d) if carried[w]], len(d), picked)
        for k, w in enumerate(d):
            kind.append(kinds.setdefault((w, tuple(full.get(k, ()))), len(kinds)))
            marked.append(k in full or toxic_text and w in seeds and not carried[w])
            first.append(not k)
    own = [features(w, carried[w], full) for w, full in kinds]
    slots, owner = np.concatenate([np.array(x) for x in own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
    kind, first, y = np.array(kind), np.array(first), np.array(marked, float)
    inner = ~first[1:]
    steps = np.zeros((2, 2))
    np.add.at(steps, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    # parameters: slots, four transitions, start
    theta, grad2 = np.zeros(SLOTS + 5), np.full(SLOTS + 5, 1e-3)
    by_kind = np.bincount(kind, y, len(own))
    for _ in range(EPOCHS):
        e = np.bincount(owner, theta[slots], len(own))[kind]
        p, expected = chained(e, first, np.exp(theta[SLOTS:-1].reshape(2, 2)), theta[-1])
        miss = by_kind - np.bincount(kind, p, len(own))
        g = np.concatenate([np.bincount(slots, miss[owner], SLOTS), (steps - expected).reshape(-1), [(y - p)[first].sum()]]) - 0.02 * theta
        grad2 += g * g
        theta += 0.5 * g / np.sqrt(grad2)
    return Field(theta[:SLOTS], theta[SLOTS:-1].reshape(2, 2), float(theta[-1]), picked=picked)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Field:
    """Fits on labelled rows that are not held out, MOST_TOXIC and MOST_CLEAN of them at most. Without lang_col all are of one language."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(~held_out(F.col("doc_id"))).distinct()
    by_hash = F.xxhash64(F.lit(1), "doc_id")
    part = lambda y, n: known.where(F.col("y") == y).orderBy(by_hash, "doc_id").limit(n)
    sample = part(1, MOST_TOXIC).unionByName(part(0, MOST_CLEAN))  # so few ids can be broadcast
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(sample), "doc_id").select(F.lit(0).alias("k"), F.col("y").cast("int").alias("y"), "text", "lang")

    def run(table: pa.Table) -> pa.Table:
        texts: tuple[list[tuple[str, str]], list[tuple[str, str]]] = ([], [])
        for y, text, of in zip(table["y"].to_pylist(), table["text"].to_pylist(), table["lang"].to_pylist(), strict=True):
            texts[y].append((of, text))
        net = fitted(texts[1], texts[0])
        return pa.table([[net.weights.tobytes()], [net.trans.tobytes()], [net.start], [net.empty], [json.dumps(net.picked)]], ["weights", "trans", "start", "empty", "picked"])

    # on an executor, which has more memory than the driver; the sample's bound is the task's
    found = rows.groupBy("k").applyInArrow(run, "weights binary, trans binary, start double, empty boolean, picked string").first()
    if found is None:
        return fitted([], [])
    return Field(np.frombuffer(found.weights), np.frombuffer(found.trans).reshape(2, 2), found.start, found.empty, json.loads(found.picked))


def document_scores(net: Field, texts: list[str]) -> tuple[list[float], list[np.ndarray]]:
    """The largest marginal of each text, and all of them by token."""
    if net.empty:
        return [0.0] * len(texts), [np.zeros(0)] * len(texts)
    if len(net.carried) > KEPT:
        net.known.clear()
        net.carried.clear()
    p: list[np.ndarray] = []
    while len(p) < len(texts):
        rows, held = [], 0
        while held <= PASS and len(p) + len(rows) < len(texts):
            text = texts[len(p) + len(rows)]
            rows.append(net.emissions(WORD.findall(text.lower())))
            held += len(text)
        sizes = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(sizes)
        first = np.zeros(int(sizes.sum()), bool)
        first[(ends - sizes)[sizes > 0]] = True
        p += np.split(net.marginals(np.fromiter((x for r in rows for x in r), float, len(first)), first), ends[:-1])
    return [float(x.max()) if len(x) else 0.0 for x in p], p


def scored(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, spans (array of start, end in code points, marginal) of each row."""
    small_batches(df.sparkSession)
    base = id_text(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.trans, model.start, model.empty, model.picked))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Field(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, own = document_scores(net, texts)
            spans = [runs(t, p) if s >= 0.5 else [] for t, s, p in zip(texts, scores, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, span)], ["doc_id", "score", "predicted", "spans"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")


def runs(text: str, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring toxic tokens. Lower-casing can lengthen a text, so tokens are found in the text as it is where that gives as many."""
    where = [m.span() for m in WORD.finditer(text)]
    if len(where) != len(p):
        where = [m.span() for m in WORD.finditer(text.lower())]
    out: list[dict] = []
    hot = np.flatnonzero(p >= 0.5).tolist()
    for before, k in zip([-9, *hot], hot, strict=False):
        if k == before + 1:
            out[-1] |= {"end": where[k][1], "marginal": max(out[-1]["marginal"], float(p[k]))}
        else:
            out.append({"start": where[k][0], "end": where[k][1], "marginal": float(p[k])})
    return out


def filtered(df: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """Rows of df, all columns, whose text scores under one half; decided where the rows lie, so nothing is joined."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.trans, model.start, model.empty, model.picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Field(*shared.value)
        for batch in batches:
            scores = document_scores(net, [t or "" for t in batch.column(text_col).to_pylist()])[0]
            yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)
