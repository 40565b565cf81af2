"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared by Jaccard.

An anchor is a common word of the list below (any language). Its signature is the anchor with the next CHAIN content
words, each DISTANCE content words on; the fingerprint is the sorted set of 32-bit signature hashes, in base 64. A text
without any full signature gives those of all runs of CHAIN + 1 of its words, with fewer words one of them all, and without any
word one of its characters, so all texts but the empty one have fingerprints.

Likeness is Jaccard of two sets, 1 for two empty ones. near_duplicates() partitions sets by their length and compares only
those that share a signature of their prefix and whose lengths allow the threshold.

Null text is empty. Equal texts have equal fingerprints. Rows with one doc_id stand in the order of their texts. Only
the id and text columns are read. near_duplicates() leaves out null ids and empty fingerprints, and gives no pairs of an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import id_text, shuffle_partitions, small_batches

CHAIN, DISTANCE = 2, 1
WORD = re.compile(r"[^\W\d_]+")
# Common words of four languages.
ANCHORS = frozenset(
    "the of and to in is was it for on that by this with from are as be at an or not which have has "
    "der die das und ist von mit den dem des ein eine zu im auf sich nicht "
    "le la les de du et un une est en que qui dans pour pas au par sur "
    "el los las y del se por con una su para es lo como".split()
)


def signatures(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    words = WORD.findall(text.lower())
    content, spots = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    reach, n = (chain - 1) * distance, len(content)
    out = {zlib.crc32(" ".join([a, *content[k : k + reach + 1 : distance]]).encode()) for a, k in spots if k + reach < n}
    if not out:
        out = {zlib.crc32(" ".join(words[k : k + chain + 1]).encode()) for k in range(len(words) - chain)}
    if not out and text:
        out = {zlib.crc32((" ".join(words) or text).encode())}
    return np.array(sorted(out), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encoded(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.tobytes()).decode()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, signatures (array of bigint) of each row."""
    small_batches(df.sparkSession)
    base = id_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(encoded, sets), pa.string()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "signatures"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fingerprint string, signatures array<bigint>")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of representatives, the smallest ids of equal fingerprints, with likeness at or above the threshold; membership is fingerprints()'s equality."""
    reps = fingerprints(df, id_col, text_col).where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("signatures").alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    step = float(np.log(1 / threshold))
    part = F.floor(F.log(n.cast("double")) / step).cast("int")
    prefix = F.expr(f"slice(s, 1, size(s) - cast(ceil({threshold} * size(s) - 1e-9) as int) + 1)")
    keyed = reps.select("doc_id", "s", part.alias("part"), F.explode(prefix).alias("sig"))
    left = keyed.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"), "sig", "part")
    right = keyed.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), F.col("part").alias("own"))
    met = left.join(right, ["sig", "part"]).where((F.col("own") > F.col("part")) | (F.col("a") < F.col("b")))
    met = met.where((F.size("sa") >= threshold * F.size("sb") - 1e-9) & (F.size("sb") >= threshold * F.size("sa") - 1e-9))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = met.dropDuplicates(["a", "b"]).withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    return pairs.where(F.col("likeness") >= threshold - 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def edited_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text against itself with the last half replaced by the beginning of the next document's, and against that document.

    Rows are dealt by range of the id and sorted, so a row's next stands beside it; a partition's last row meets the first of
    the next partition that has rows in a second, small step with two rows a partition.
    """
    spark = df.sparkSession
    small_batches(spark, 200)
    base = id_text(df, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    rows = base.repartitionByRange(max(shuffle_partitions(spark), 2), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    fields = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def results(ids: list, pairs: list[tuple[str, str]], kind: pa.DataType) -> pa.RecordBatch:
        out, held = [], ("", signatures(""))
        for text, after in pairs:
            own = held[1] if held[0] == text else signatures(text)
            held = (after, signatures(after))
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            sigs = signatures(edited)
            out.append((n, hashlib.sha256(edited.encode()).hexdigest(), encoded(own), encoded(sigs), likeness(own, sigs), likeness(own, held[1])))
        cols = [*zip(*out, strict=True)] or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            mine = [*zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            mine, held = ([held] if held else []) + mine, mine[-1] if mine else held
            if len(mine) > 1:
                yield results([d for d, _ in mine[:-1]], [(x[1], y[1]) for x, y in zip(mine, mine[1:], strict=False)], b.schema.field("doc_id").type)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first, last, schema = first or b.slice(0, 1).to_pylist()[0], b.slice(b.num_rows - 1).to_pylist()[0], b.schema
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([last["doc_id"]], schema.field("doc_id").type), pa.array([last["text"]], pa.string()), pa.array([first["text"]], pa.string())], ["pid", "doc_id", "text", "head"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield results(b.column("doc_id").to_pylist(), [*zip(b.column("text").to_pylist(), b.column("after").to_pylist(), strict=True)], b.schema.field("doc_id").type)

    # an exchange of its own: in one stage with the union below, partitions would be numbered after those of its other side
    edge = rows.mapInArrow(ends, f"pid int, doc_id {kind}, text string, head string").repartition(shuffle_partitions(spark), "pid")
    numbers = edge.select("pid").agg(F.sort_array(F.collect_list("pid")).alias("pids"))  # one number a partition
    follow = edge.select("pid", "doc_id", "text").crossJoin(numbers).withColumn("to", F.expr("element_at(pids, cast(array_position(pids, pid) % size(pids) as int) + 1)"))
    joined = follow.join(edge.select(F.col("pid").alias("to"), F.col("head").alias("after")), "to").select("doc_id", "text", "after")
    return rows.mapInArrow(inner, fields).unionByName(joined.mapInArrow(across, fields))
