"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), to connected components.

A document's set holds its distinct 5-word shingles. Documents of equal sets are one class. A class can only be linked if
enough of its shingles occur in other classes too: linked sets share at least 75 % of the larger one. So

1. half of each set (the lowest hashes) is counted over the corpus, in packed blocks, and classes with too few shared
   shingles in their half go;
2. the rest, as blocks of whole sets, learn in how many sets each of their shingles occurs; those with too few shared
   shingles go, and the rarest shared ones of each that could still miss the threshold are its prefix;
3. classes that share a prefix shingle form candidate clusters; every link lies inside one;
4. in each cluster, sets in order of size query an inverted index of the smaller ones: short lists are merged over a
   heap, long ones are only probed, and sets that reach the overlap are linked. A set that is already in the query's component
   needs no probing. Clusters beyond BLOCK sets are cut into blocks and each pair of blocks is a task.

Texts without words and null texts have empty sets and link with nothing. Rows of one doc_id are one node. Rows with a null id
have their size, and a null component. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import block_key, checkpointed, id_text, planes, shuffle_partitions, small_batches, unplaned, with_long_id
from .graph import connected_components, with_group
from .hashing import set_digest, shingle_sets

BLOCK, BLOCK_TOKENS, COUNTED = 2000, 1_000_000, 400_000
PROBE_COST = 0.0085
LOCAL = np.uint32(0xFFFFFFFF)


def least_overlap(n: np.ndarray | int, percent: int):
    """A set of n must share so many of its members with any set that it links with."""
    return -(-n * percent // 100)


def sets_of(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [*shingle_sets(b.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n", "digest"])

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, digest binary")


def half(s: np.ndarray) -> np.ndarray:
    return s[: len(s) // 2 + 1]


def promising(rows: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """doc_id of rows of whose half enough shingles occur in other rows too."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for b in batches:
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist(), k), strict=True):
                if len(s):
                    ids.append(doc)
                    parts.append(half(s))
                    held += len(parts[-1])
                if held > COUNTED:
                    yield blocks(ids, parts)
                    ids, parts, held = [], [], 0
        if ids:
            yield blocks(ids, parts)

    def blocks(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, doc = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        unique, first, counts = np.unique(tokens, return_index=True, return_counts=True)
        own = np.bincount(doc[np.repeat(counts > 1, counts)], minlength=len(ids)).astype(np.uint32)
        ref = np.where(counts > 1, LOCAL, doc[first]).astype(np.uint32)
        to = (unique % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        name, key = np.array(ids, np.int64), block_key(ids)
        out = []
        for q in range(buckets):
            at = order[cuts[q] : cuts[q + 1]]
            if len(at) or not q:
                at = at[np.argsort(ref[at], kind="stable")]  # in the order of documents, which compresses
                used, r = np.unique(ref[at][ref[at] != LOCAL], return_inverse=True)
                short = np.full(len(at), LOCAL, np.uint32)
                short[ref[at] != LOCAL] = r
                # 32 bits beside the bucket: a chance meeting only keeps a document in the race
                out.append((q, key, (unique[at] >> np.uint64(20)).astype(np.uint32).tobytes(), planes(short), name[used].tobytes(), (name[own > 0].tobytes() if not q else b""), (own[own > 0].tobytes() if not q else b"")))
        cols = [*zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["q", "block", "tokens", "ref", "ids", "own_ids", "own"])

    def answers(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()]
        refs = [unplaned(x) for x in table["ref"].to_pylist()]
        unique, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[inverse[np.concatenate(refs) == LOCAL]] = True
        shared, at, out = shared[inverse], 0, []
        for block, ref, name, own_ids, own in zip(*(table[c].to_pylist() if c != "ref" else refs for c in ("block", "ref", "ids", "own_ids", "own")), strict=True):
            name = np.frombuffer(name, np.int64)
            c = np.bincount(ref[shared[at : at + len(ref)] & (ref != LOCAL)], minlength=len(name))
            out.append((block, name[c > 0].tobytes() + own_ids, c[c > 0].astype(np.uint32).tobytes() + own))
            at += len(ref)
        cols = [*zip(*out, strict=True)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "ids", "n"])

    def by_document(table: pa.Table) -> pa.Table:
        """A block's answers, one row a document."""
        ids, inverse = np.unique(np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64), return_inverse=True)
        n = np.bincount(inverse, np.frombuffer(b"".join(table["n"].to_pylist()), np.uint32), len(ids)).astype(np.int64)
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "shared"])

    asked = rows.mapInArrow(requests, "q int, block bigint, tokens binary, ref binary, ids binary, own_ids binary, own binary")
    told = asked.groupBy("q").applyInArrow(answers, "block bigint, ids binary, n binary").groupBy("block").applyInArrow(by_document, "doc_id bigint, shared bigint")
    return told.groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def whole_blocks(rows: DataFrame, k: int) -> DataFrame:
    """Blocks of whole sets: block, ids, sizes, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, made, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + made], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64), np.concatenate(sets)))], ["block", "ids", "sizes", "tokens"])

        for b in batches:
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist(), k), strict=True):
                ids.append(doc)
                sets.append(s)
                held += len(s)
                if held > COUNTED:
                    yield block()
                    made, ids, sets, held = made + 1, [], [], 0
        if ids:
            yield block()

    return rows.mapInArrow(run, "block bigint, ids binary, sizes binary, tokens binary")


def frequencies(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, tokens, df: of each block's tokens that several sets have."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                unique, counts = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                to = (unique % np.uint64(buckets)).astype(np.int64)
                for q in np.unique(to).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([block], pa.int64()), pa.array([unique[to == q].tobytes()], pa.binary()), pa.array([counts[to == q].astype(np.uint32).tobytes()], pa.binary())], ["q", "block", "tokens", "n"])

    def answers(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["n"].to_pylist()])
        unique, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(inverse, n, len(unique)).astype(np.int64)[inverse]
        ends = np.cumsum([len(t) for t in tokens])
        out = [(t[d > 1].tobytes(), d[d > 1].tobytes()) for t, d in zip(tokens, np.split(df, ends[:-1]), strict=True)]
        cols = [*zip(*out, strict=True)]
        return pa.table([table["block"], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["block", "tokens", "df"])

    asked = blocks.select("block", "tokens").mapInArrow(requests, "q int, block bigint, tokens binary, n binary")
    return asked.groupBy("q").applyInArrow(answers, "block bigint, tokens binary, df binary")


def candidates(blocks: DataFrame, df: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, tokens (shared ones, as bytes), prefix (array of bigint): of sets with enough shared shingles."""
    names = ["doc_id", "n", "tokens", "prefix"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known = np.concatenate([np.frombuffer(x, np.uint64) for x in right["tokens"].to_pylist()] or [np.zeros(0, np.uint64)])
        count = np.concatenate([np.frombuffer(x, np.int64) for x in right["df"].to_pylist()] or [np.zeros(0, np.int64)])
        order = np.argsort(known)
        known, count = known[order], count[order]
        for ids, sizes, tokens in zip(left["ids"].to_pylist(), left["sizes"].to_pylist(), left["tokens"].to_pylist(), strict=True):
            sizes = np.frombuffer(sizes, np.int64)
            for doc, s in zip(np.frombuffer(ids, np.int64).tolist(), np.split(np.frombuffer(tokens, np.uint64), np.cumsum(sizes)[:-1]), strict=True):
                n, at = len(s), np.searchsorted(known, s)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == s[hit]
                shared, freq = s[hit], count[at[hit]]
                need = int(least_overlap(n, percent))
                if len(shared) >= need:
                    spare = len(shared) - need + 1  # unshared shingles are the rarest and have used their part of the prefix
                    out.append((doc, n, shared.tobytes(), shared[np.lexsort((shared, freq))[:spare]].astype(np.int64).tolist()))
        cols = [*zip(*out, strict=True)] or [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names)

    return blocks.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(run, "doc_id bigint, n bigint, tokens binary, prefix array<bigint>")


def divide_skip(sets: list[tuple[int, int, list[int], int]], percent: int) -> list[tuple[int, int]]:
    """Links (of a spanning forest) between sets given as (id, size, shared tokens, side); sides -1 and 1 are only compared with each other, 0 with 0."""
    sets = sorted(sets, key=lambda s: (s[1], s[0]))
    parent = [*range(len(sets))]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index: dict[tuple[int, int], list[int]] = defaultdict(list)
    out = []
    for q, (doc, n, tokens, side) in enumerate(sets):
        need = int(least_overlap(n, percent))
        lists = [own for t in tokens if (own := index.get((t, -side)))]
        if len(lists) >= need:
            lists.sort(key=len)
            skip = min(need - 1, int(need / (PROBE_COST * math.log2(len(lists[-1]) + 1) + 1)))
            short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
            run, count = -1, 0
            for y in heapq.merge(*short, [len(sets)]):
                if y == run:
                    count += 1
                    continue
                if run >= 0 and count >= need - skip and sets[run][1] * 100 >= n * percent and root(run) != root(q):
                    overlap = -(-percent * (n + sets[run][1]) // (100 + percent))
                    left = len(long)
                    for own in reversed(long):
                        if count >= overlap or count + left < overlap:
                            break
                        left -= 1
                        k = bisect_left(own, run)
                        count += k < len(own) and own[k] == run
                    if count >= overlap:
                        out.append((sets[run][0], doc))
                        parent[root(q)] = root(run)
                run, count = y, 1
        for t in tokens:
            index[t, side].append(q)
    return out


def links(cands: DataFrame, percent: int, parts: int) -> DataFrame:
    """node, component of sets that have links.

    A task that has a whole cluster gives its components at once; only links from pieces of cut clusters are put together.
    """
    posted = cands.select("doc_id", F.explode("prefix").alias("token"))
    met = posted.groupBy("token").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1")
    stars = with_group(posted, met, "token", F.col("doc_id"), cut=False).where("least is not null and least <> doc_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    cluster = connected_components(stars)
    placed = cands.select("doc_id", "n", "tokens").join(cluster.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    size = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(F.octet_length("tokens") / 8).alias("weight"))
    size = size.select("cluster", "members", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / BLOCK_TOKENS)).cast("int").alias("cuts"))
    sized = with_group(placed, size, "cluster", F.col("doc_id"), cut=False).withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("cuts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    sent = sized.withColumn("pair", F.explode(pairs)).withColumn("i", F.col("pair.i")).withColumn("j", F.col("pair.j"))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("mine") == F.col("i"), -1).otherwise(1)
    task = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(parts * 4))).otherwise(F.xxhash64("cluster", "i", "j"))
    sent = sent.select(task.alias("task"), "cluster", "i", "j", side.alias("side"), (F.col("cuts") > 1).cast("int").alias("cut"), "doc_id", "n", "tokens")

    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list] = defaultdict(list)
        for r in zip(*(table[c].to_pylist() for c in ("cluster", "i", "j", "cut", "doc_id", "n", "tokens", "side")), strict=True):
            groups[r[:4]].append(r[4:])
        found = []
        for (*_, cut), sets in groups.items():
            if len(sets) > 1:
                forest = divide_skip([(d, n, np.frombuffer(t, np.uint64).tolist(), s) for d, n, t, s in sets], percent)
                found += [(b, a, cut) for a, b in (forest if cut else stars_of(forest))]
        cols = [*zip(*found, strict=True)] or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["a", "b", "cut"])

    edges = checkpointed(sent.groupBy("task").applyInArrow(run, "a bigint, b bigint, cut int"))
    whole = edges.where("cut = 0").select(F.col("a").alias("node"), F.col("b").alias("component"))
    pieces = edges.where("cut = 1").select("a", "b")
    return whole if pieces.isEmpty() else whole.unionByName(connected_components(pieces))


def stars_of(forest: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(least of its tree, node) of each other node of a forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in forest:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return [(root(x), x) for x in list(parent) if root(x) != x]


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; links hold where 100 * intersection >= percent * union."""
    spark = df.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    rows = with_long_id(id_text(df, id_col, text_col))
    sets = checkpointed(sets_of(rows, k))
    named = sets.where("doc_id is not null and digest is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.min("n").alias("size"))
    known = rows.where("doc_id is not null")
    spare = F.floor(F.col("size") / 2) + 1 - (F.col("size") - F.ceil(F.col("size") * percent / 100))
    chances = promising(known, k, percent, parts).join(classes.select(F.col("rep").alias("doc_id"), "size"), "doc_id").where(F.col("shared") >= F.greatest(spare, F.lit(1)))
    blocks = checkpointed(whole_blocks(known.join(chances.select("doc_id").distinct(), "doc_id", "left_semi"), k))
    cands = checkpointed(candidates(blocks, frequencies(blocks, parts), percent))
    found = links(cands, percent, parts)
    final = classes.select("digest", "rep", "members").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "members", F.coalesce("component", "rep").alias("component_id"))
    both = with_group(sets, final, "digest", F.coalesce(F.col("doc_id"), F.lit(0)))
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Rows of df, all columns: of each component those of its smallest id, repeated rows once; rows without words or id stay."""
    found = components(df, id_col, text_col, k, percent)
    gone = found.where("doc_id is not null and n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    # rows of an id lie together after the join; 128 bits tell those of one id apart, so no text is a sort key
    hashed = df.join(gone, id_col, "left_anti").withColumns({f"_row{k}": F.xxhash64(F.lit(k), *df.columns, *(F.col(c).isNull() for c in df.columns)) for k in range(2)})
    return hashed.dropDuplicates([id_col, "_row0", "_row1"]).select(*df.columns)


