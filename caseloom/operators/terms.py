"""Terminology candidates by an inverted index, and words that lost the blanks between them."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from caseloom.functions import text as T

# The cut before re-ranking, the weights and floor of the final score, and how candidates are cut off.
SHORTLIST, OF_WORDS, OF_SIGNS, FLOOR = 512, 0.6, 0.4, 0.45
MOST_RUN = 40


def vocabulary(rows: DataFrame, id_: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """term, n, df: occurrences and documents of every term, in one exchange of sums that are combined before it; nothing is distinct over the corpus."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    one = lambda x, n, df: F.transform(x, lambda w: F.struct(w.alias("term"), F.lit(n).alias("n"), F.lit(df).alias("df")))
    told = rows.select(words.alias("w")).select(F.explode(F.concat(one(F.col("w"), 1, 0), one(F.array_distinct("w"), 0, 1))).alias("x"))
    return told.groupBy("x.term").agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df"))


def shortlist(queries: DataFrame, docs: DataFrame, q: str, d: str, text: str, k: int = SHORTLIST) -> DataFrame:
    """q, d, score (sum of ln(1 + N / (1 + df)) over common words, in millionths), shared, place up to k; ties by id.

    Every common word counts. Words of more than one part in a thousand of the postings are dealt under salts, and pairs are summed
    before they are ranked.
    """
    words = lambda df, i: df.select(F.col(i), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    posted, asked = words(docs, d), words(queries, q)
    wanted = asked.select("term").distinct()
    own = posted.join(wanted, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("_n"))
    weight = df.crossJoin(F.broadcast(n)).select("term", F.round(1_000_000 * F.log(1 + F.col("_n") / (1 + F.col("df")))).cast("bigint").alias("idf"), F.greatest(F.lit(1), F.ceil(F.col("df") * 64 / F.col("_n"))).cast("int").alias("_cuts"))
    left = asked.join(weight, "term").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    right = own.join(weight.select("term", "_cuts"), "term").withColumn("_salt", F.pmod(F.xxhash64(d), F.col("_cuts")).cast("int"))
    met = left.select(q, "term", "idf", "_salt").join(right.select(d, "term", "_salt"), ["term", "_salt"])
    scored = met.groupBy(q, d).agg(F.sum("idf").alias("score"), F.count("*").alias("shared"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(q).orderBy(F.col("score").desc(), d))).where(F.col("place") <= k)


def candidates(concepts: DataFrame, queries: DataFrame, limit: int = 8, system: str | None = None) -> DataFrame:
    """Concepts (concept, system, tasks array, display) for queries (query, task, text) -> query, concept, score, place.

    Top SHORTLIST by weight of common words first, then the task and system filter, then words' Jaccard and matching characters re-rank, from FLOOR on.
    """
    short = shortlist(queries.select("query", "text"), concepts.select("concept", F.col("display").alias("text")), "query", "concept", "text").select("query", "concept")
    rows = short.join(queries, "query").join(concepts, "concept").where(F.array_contains("tasks", F.col("task")))
    rows = rows.where(F.col("system") == system) if system else rows
    a, b = T.words(F.col("text"), True), T.words(F.col("display"), True)
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    score = OF_WORDS * jaccard + OF_SIGNS * T._ratio(T.key(F.col("text")), T.key(F.col("display")))
    ranked = rows.withColumn("score", score).where(F.col("score") >= FLOOR)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "concept"))).where(F.col("place") <= limit).select("query", "concept", "score", "place")


# ---- segmentation


class Segmenter:
    """Best ways to cut a run of letters into words of a vocabulary: the sum of -ln of their shares, an unknown piece costs by its length."""

    def __init__(self, counts: dict[str, int], unknown: float = 12.0) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = unknown

    def piece(self, s: str) -> float:
        return self.cost.get(s, self.unknown + 2.0 * len(s))

    def best(self, run: str, k: int = 2, longest: int = 24) -> list[tuple[float, tuple[str, ...]]]:
        """The k cheapest cuts, cheapest first, ties by their words."""
        ways: list[list[tuple[float, tuple[str, ...]]]] = [[(0.0, ())]]
        for end in range(1, len(run) + 1):
            found = [(c + self.piece(run[at:end]), words + (run[at:end],)) for at in range(max(0, end - longest), end) for c, words in ways[at]]
            ways.append(heapq.nsmallest(k, found))
        return ways[-1]


def glued(rows: DataFrame, id_: str, text: str, vocabulary_: dict[str, int], least_gain: float = 4.0) -> DataFrame:
    """id, start, piece, parts (array), gain, sure: runs of letters that no vocabulary word is, but that cut into known words far cheaper than they stand.

    vocabulary_: a dictionary of bounded size (it goes to every executor). Addresses, file names and words with digits are left alone; runs of up to
    MOST_RUN letters are read. sure: the second best cut is far behind.
    """
    kind = dict(rows.dtypes)[id_]
    net = Segmenter(vocabulary_)
    skip = re.compile(r"https?://\S+|www\.\S+|\S*[\d_/@\\]\S*|\S+\.\w{2,4}\b")
    word = re.compile(r"[A-Za-z]{6,%d}" % MOST_RUN)

    def known(w: str) -> bool:
        return w in net.cost or (w.endswith("s") and w[:-1] in net.cost) or any(w.endswith(e) and (w[: -len(e)] in net.cost or w[: -len(e)] + "e" in net.cost) for e in ("ed", "ing", "ly", "es"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b[id_], b[text], strict=True):
                masked = skip.sub(lambda m: " " * len(m[0]), t or "")
                for m in word.finditer(masked):
                    w = m[0].lower()
                    if known(w):
                        continue
                    ways = net.best(w)
                    cost, parts = ways[0]
                    gain = net.piece(w) - cost
                    if len(parts) > 1 and all(p in net.cost for p in parts) and gain >= least_gain:
                        out.append((i, m.start(), m[0], list(parts), gain, len(ways) < 2 or ways[1][0] - cost >= 2.0))
            yield pd.DataFrame(out, columns=["id", "start", "piece", "parts", "gain", "sure"])

    return rows.select(id_, text).mapInPandas(run, f"id {kind}, start int, piece string, parts array<string>, gain double, sure boolean")


def punctuation_glue(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """id, found: words stuck to a comma, semicolon or full stop before them."""
    return rows.select(F.col(id_).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b[a-z]{2,}[,;][A-Za-z]{2,}\b|\b[a-z]{3,}\.[A-Z][a-z]+\b"), F.lit(0))).alias("found"))


@F.pandas_udf(StringType())
def apply_segmentations(text: pd.Series, starts: pd.Series, pieces: pd.Series, parts: pd.Series) -> pd.Series:
    """Texts with found pieces (aligned arrays of start, piece and its parts joined by blanks) replaced, from the last to the first."""
    out = []
    for t, ss, ps, ws in zip(text, starts, pieces, parts, strict=True):
        for s, p, w in sorted(zip(ss if ss is not None else [], ps if ps is not None else [], ws if ws is not None else [], strict=True), reverse=True):
            if t[s : s + len(p)] == p:
                t = t[:s] + w + t[s + len(p) :]
        out.append(t)
    return pd.Series(out)
