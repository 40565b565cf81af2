"""Samples, ranks, seats and packed waves: reproducible by salted digests, ties broken by ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def digest_rank(id_: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), id_.cast("string")), 256)


def sample(rows: DataFrame, id_: str, n: int, salt: str) -> DataFrame:
    """The n rows of lowest digest: a uniform sample that any run draws again."""
    return rows.orderBy(digest_rank(F.col(id_), salt), id_).limit(n)


def round_robin(rows: DataFrame, by: Sequence[str], id_: str, n: int, salt: str, first: Sequence[Column] = ()) -> DataFrame:
    """Rows with `pick`, 1 to n: turns over the groups (in the order of their digests), in each by `first`, then by digest."""
    own = Window.partitionBy(*by).orderBy(*first, digest_rank(F.col(id_), salt), id_)
    turns = rows.withColumn("_turn", F.row_number().over(own)).where(F.col("_turn") <= n)
    turns = turns.withColumn("_group", digest_rank(F.concat_ws("|", *by), salt))
    picked = turns.orderBy("_turn", "_group", *by).limit(n)
    return picked.withColumn("pick", F.row_number().over(Window.orderBy("_turn", "_group", *by))).drop("_turn", "_group")  # n rows


def holdout(rows: DataFrame, id_: str, share: float, least: int, salt: str) -> DataFrame:
    """Rows with `held`: the share of lowest digests, rounded to even, at least so many."""
    total = rows.agg(F.greatest(F.lit(least), F.bround(F.count("*") * share).cast("int")).alias("_n"))
    ranked = rows.select(id_).withColumn("_k", F.row_number().over(Window.orderBy(digest_rank(F.col(id_), salt), id_)))
    cut = ranked.crossJoin(F.broadcast(total)).where("_k <= _n").select(id_)  # one row
    return rows.join(cut.withColumn("held", F.lit(True)), id_, "left").na.fill(False, ["held"])


def fixed_then_ranked(rows: DataFrame, id_: str, fixed: Sequence[str], n: int, salt: str) -> DataFrame:
    """Rows with `pick`: the fixed ids that are there, in their order, then others by digest, n in all."""
    place = F.array_position(F.array(*map(F.lit, fixed)), F.col(id_).cast("string")) if fixed else F.lit(0)
    ordered = rows.withColumn("_place", F.when(place > 0, place).otherwise(len(fixed) + 1)).withColumn("_rank", digest_rank(F.col(id_), salt))
    order = ("_place", "_rank", id_)
    return ordered.orderBy(*order).limit(max(n, len(fixed))).withColumn("pick", F.row_number().over(Window.orderBy(*order))).where((F.col("pick") <= n) | (F.col("_place") <= len(fixed))).drop("_place", "_rank")


def size_bucket(n: Column, limits: Sequence[tuple[float, str]], beyond: str, missing: str | None = None) -> Column:
    """The name of the first limit that lies above; missing for null."""
    out = F.when(n.isNull(), missing)
    for limit, name in limits:
        out = out.when(n < limit, name)
    return out.otherwise(beyond)


def richness(numbers: Column, points: Column, present: Sequence[Column], tables: Column, characters: Column, patients: Column) -> Column:
    """A score that counts saturate: more than a hundred numbers or points add nothing, long sources and many patients cost."""
    many = lambda c: F.log1p(F.least(c, F.lit(100)))
    has = sum((F.when(c > 0, 0.3).otherwise(0.0) for c in present), F.lit(0.0))
    return 2 * many(numbers) + 1.5 * many(points) + has + F.when(tables > 0, 0.4).otherwise(0.0) - characters / 20000 - 0.5 * (patients - 1)


def seats(candidates: DataFrame, id_: str, family: str, stratum: str, score: str, multiple: str, n: int, salt: str, multiples: int, most_of_family: int = 3) -> DataFrame:
    """Candidates with `seat`, 1 to n: one of each family first, then by score and the novelty of their stratum, a quota of multiples ahead, most_of_family of a family.

    Each seat depends on those before. Only the best most_of_family + 1 of each (family, stratum, multiple) can get one, so these few rows, found by a window, are one task's.
    """
    kinds = dict(candidates.dtypes)
    own = Window.partitionBy(family, stratum, multiple).orderBy(F.col(score).desc(), digest_rank(F.col(id_), salt))
    few = candidates.select(id_, family, stratum, score, multiple, digest_rank(F.col(id_), salt).alias("_rank")).withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= most_of_family + 1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        free = {r[0]: r for r in rows[[id_, family, stratum, score, multiple, "_rank"]].itertuples(index=False, name=None)}
        families: dict = {}
        strata: dict = {}
        out: list = []

        def take(pool: list) -> None:
            best = min(pool, key=lambda r: (-r[3] - 2 / (1 + strata.get(r[2], 0)), r[5]))
            out.append(best[0])
            del free[best[0]]
            families[best[1]], strata[best[2]] = families.get(best[1], 0) + 1, strata.get(best[2], 0) + 1

        chosen_multiples = 0
        for name in sorted({r[1] for r in free.values()}):
            if len(out) < n:
                pool = [r for r in free.values() if r[1] == name]
                before = dict(free)
                take(pool)
                chosen_multiples += bool(before[out[-1]][4])
        while len(out) < n:
            pool = [r for r in free.values() if families.get(r[1], 0) < most_of_family]
            if not pool:
                raise ValueError("the families' ceiling leaves too few candidates")
            if chosen_multiples < multiples and any(r[4] for r in pool):
                pool = [r for r in pool if r[4]]
            before = dict(free)
            take(pool)
            chosen_multiples += bool(before[out[-1]][4])
        return pd.DataFrame({id_: out, "seat": range(1, len(out) + 1)})

    chosen = few.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"{id_} {kinds[id_]}, seat int")
    return candidates.join(F.broadcast(chosen), id_)  # n rows


def running_cap(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """The first rows of each group while both their number and their summed size stay within the caps."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n", F.count("*").over(upto)).withColumn("_size", F.sum(size).over(upto)).where((F.col("_n") <= most_rows) & (F.col("_size") <= most_size)).drop("_n", "_size")


def newest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key, without a window: one maximum a key, pre-aggregated."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*(F.col(key) if c == key else F.col(f"_row.{c}") for c in rows.columns))


def first_done(attempts: DataFrame, key: str, order: Sequence[str], done: Column, last: bool = False) -> DataFrame:
    """The first (or last) finished attempt of each key."""
    rest = [c for c in attempts.columns if c != key]
    pick = F.max_by if last else F.min_by
    return attempts.where(done).groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, *(F.col(f"_row.{c}") for c in rest))


def stale(log: DataFrame, key: str, order: Sequence[str], decision: str, version: str, current: str) -> DataFrame:
    """Keys whose last decision is held and was made under another version."""
    return newest(log, key, order).where((F.col(decision) == "held") & ~F.col(version).eqNullSafe(F.lit(current)))


def facet_counts(rows: DataFrame, filters: dict[str, Column], values: dict[str, Column], order: Sequence[str] = ()) -> DataFrame:
    """facet, value, n: each facet's counts under all filters but its own; every row is read once."""
    hits = {k: F.coalesce(c, F.lit(False)) for k, c in filters.items()}
    under = lambda own: F.forall(F.array(*(c for k, c in hits.items() if k != own), F.lit(True)), lambda x: x)
    told = F.array(*(F.when(under(k), F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value"))) for k, v in values.items()))
    return rows.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def matching(rows: DataFrame, any_of: dict[str, tuple[Column, Sequence]], all_of: Column | None = None, terms: Sequence[str] = (), names: Column | None = None) -> DataFrame:
    """Rows that pass every filter: one of the values in each group, all conditions of all_of, and every term inside some name."""
    out = rows
    for c, values in any_of.values():
        out = out.where(c.isin(*values)) if values else out
    out = out.where(all_of) if all_of is not None else out
    for t in terms:
        out = out.where(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(t.lower()))))
    return out


def packed_waves(jobs: DataFrame, id_: str, resources: Sequence[str], limits: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Jobs with `wave` (from 1): first fit, the largest by the first resource ahead, within the limits of all resources. A group is one task's.

    A job beyond a limit fails the query: no wave can hold it.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in jobs.dtypes) + ", wave int"
    groups = list(by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([resources[0], id_], ascending=[False, True])
        waves: list[list[float]] = []
        out = []
        for need in rows[[*resources]].itertuples(index=False, name=None):
            if any(x > m for x, m in zip(need, limits, strict=True)):
                raise ValueError("a job asks for more than a wave may have")
            k = next((k for k, w in enumerate(waves) if all(a + b <= m + 1e-9 for a, b, m in zip(w, need, limits, strict=True))), len(waves))
            if k == len(waves):
                waves.append([0.0] * len(limits))
            waves[k] = [a + b for a, b in zip(waves[k], need, strict=True)]
            out.append(k + 1)
        return rows.assign(wave=out)

    return jobs.groupBy(*(groups or [F.lit(0).alias("_all")])).applyInPandas(run, kinds)


def residency(jobs: DataFrame, share: str, parts: str, size: str, by: Sequence[str]) -> DataFrame:
    """by..., total: space that jobs take whose parts (array) nest under one shared key: the largest of each nest, summed. A null key shares with nothing."""
    kinds = ", ".join(f"{c} {t}" for c, t in jobs.select(*by).dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nests: list[tuple] = []
        for s, p, n in sorted(zip(rows[share], rows[parts], rows[size], strict=True), key=lambda r: (-len(r[1]), str(r[0]), -r[2])):
            own = next((k for k, (of, whole, _) in enumerate(nests) if s is not None and of == s and set(p) <= whole), None)
            if own is None:
                nests.append((s, set(p), n))
            else:
                nests[own] = (nests[own][0], nests[own][1], max(nests[own][2], n))
        return pd.DataFrame([(*key, float(sum(n for *_, n in nests)))], columns=[*by, "total"])

    return jobs.groupBy(*by).applyInPandas(run, f"{kinds}, total double")


def windows(rows: DataFrame, text: str, most: int = 12_000, overlap: int = 300) -> DataFrame:
    """Rows with `start`, `end`, `part`: pieces of at most `most` characters, each from `overlap` before the last one's end, cut after a line feed or else a blank in their second half."""
    if most < 512 or not 0 <= overlap < most // 2:
        raise ValueError("bounds of the pieces don't fit")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", start int, end int, part string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in enumerate(b[text]):
                t, at = t or "", 0
                while True:
                    end = min(len(t), at + most)
                    if end < len(t):
                        near = max(t.rfind("\n", at + most // 2, end), -1)
                        near = near if near >= 0 else t.rfind(" ", at + most // 2, end)
                        end = near + 1 if near >= 0 else end
                    out.append((k, at, end, t[at:end]))
                    if end == len(t):
                        break
                    at = end - overlap
            own = b.iloc[[k for k, *_ in out]].reset_index(drop=True)
            yield own.assign(start=[x[1] for x in out], end=[x[2] for x in out], part=[x[3] for x in out])

    return rows.mapInPandas(run, kinds)


def around(rows: DataFrame, by: Sequence[str], order: Sequence[str], hit: Column, reach: int = 1, always: Column | None = None) -> DataFrame:
    """Rows of each group that are hit, or always kept, or lie within reach of one that is; all rows of a group without any hit."""
    own = Window.partitionBy(*by)
    seed = F.coalesce(hit, F.lit(False)) | (F.coalesce(always, F.lit(False)) if always is not None else F.lit(False))
    near = F.max(seed.cast("int")).over(own.orderBy(*order).rowsBetween(-reach, reach)) == 1
    some = F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(own) == 1
    return rows.withColumn("_keep", near | ~some).where("_keep").drop("_keep")


def chunked(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows with `chunk` (from 0): n neighbours of a group each."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / n).cast("int"))


def integer_runs(rows: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """by..., first, last, length of maximal runs of consecutive integers; repeats count once."""
    island = F.col(n) - F.row_number().over(Window.partitionBy(*by).orderBy(n))
    runs = rows.where(F.col(n).isNotNull()).select(*by, n).distinct().withColumn("_island", island)
    return runs.groupBy(*by, "_island").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_island")


def tiles(blocks: DataFrame, by: Sequence[str], first: str, last: str, n: Column) -> DataFrame:
    """by..., tiled: whether blocks first..last lie end to end from 1 to n, without gap or overlap."""
    before = F.lag(last).over(Window.partitionBy(*by).orderBy(first, last))
    sound = (F.col(first) == F.coalesce(F.col("_before"), F.lit(0)) + 1) & (F.col(last) >= F.col(first))
    return blocks.withColumn("_before", before).withColumn("_n", n).groupBy(*by).agg((F.bool_and(sound) & (F.max(last) == F.max("_n"))).alias("tiled"))
