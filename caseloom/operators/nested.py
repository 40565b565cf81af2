"""Nested values: leaves and pointers of JSON, differences, unions that keep order, table grids to series, and rewriting rules for facts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from caseloom.functions import text as T
from caseloom.functions.labels import canonical
from caseloom.functions.measurements import parsed_cell

# Keys that tell where a value comes from, fields that name a fact, words by which a legend is split.
PROVENANCE = ("evidence", "attribution_evidence", "documentation_evidence", "field_support", "record_id", "patient_id", "source_id", "fact_id", "review_id")
NAMES = ("name", "measurement_name", "substance", "attribute", "action_text", "event", "text_value")


# ---- JSON texts


def _walk(value: object, skip: frozenset, path: str = "") -> Iterator[tuple[str, object]]:
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", v[k]) for k in sorted(v, reverse=True) if k not in skip]
        elif isinstance(v, list):
            todo += [(f"{at}/{k}", v[k]) for k in reversed(range(len(v)))]
        else:
            yield at, v


def _parsed(text: str | None) -> object:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _rows_of(df: DataFrame, keys: Sequence[str], col: str, fields: str, told) -> DataFrame:
    """keys... and fields of what told(value) yields for each JSON text."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*k, *row) for k, text in zip(b[[*keys]].itertuples(index=False, name=None), b[col], strict=True) for row in told(_parsed(text))]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return df.select(*keys, col).mapInPandas(run, f"{kinds}, {fields}")


def leaves(df: DataFrame, keys: Sequence[str], col: str, skip: Sequence[str] = PROVENANCE) -> DataFrame:
    """keys..., attribute (a1, a2, ... in order of pointers), pointer, value (as JSON) of every scalar in a JSON column but under the skipped keys; malformed JSON has none."""
    left_out = frozenset(skip)
    return _rows_of(df, keys, col, "attribute string, pointer string, value string", lambda v: [] if v is None else ((f"a{n}", p, json.dumps(x, ensure_ascii=False)) for n, (p, x) in enumerate(_walk(v, left_out), 1)))


def string_leaves(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """keys..., pointer, text of every string."""
    return _rows_of(df, keys, col, "pointer string, text string", lambda v: ((p, x) for p, x in _walk(v, frozenset()) if isinstance(x, str)))


def objects(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """keys..., pointer, object (canonical JSON) of every object, outer ones first."""

    def told(v: object, at: str = "") -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            yield at, canonical(v)
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from told(x, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")

    return _rows_of(df, keys, col, "pointer string, object string", told)


def references(df: DataFrame, keys: Sequence[str], col: str, key: str = "reference") -> DataFrame:
    """keys..., pointer, target of every string under a key, at any depth."""
    return _rows_of(df, keys, col, "pointer string, target string", lambda v: ((p, x) for p, x in _walk(v, frozenset()) if p.rsplit("/", 1)[-1] == key and isinstance(x, str)))


def pointed(col: Column, pointer: str) -> Column:
    """The value at a JSON pointer as JSON or plain text; null if it leads nowhere. Keys are taken literally."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    path = "$"
    for k in pointer[1:].split("/") if pointer else ():
        k = k.replace("~1", "/").replace("~0", "~")
        path += f"[{k}]" if k.isdigit() else f"['{k}']"
    return F.get_json_object(col, path)


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("pointer", "before", "after")])))
def changes(before: pd.Series, after: pd.Series) -> pd.Series:
    """Scalars that differ between two JSON texts: their pointers and both values as JSON, null where one has none."""

    def told(a: str | None, b: str | None) -> list[dict]:
        x, y = (dict(_walk(_parsed(t), frozenset())) for t in (a, b))
        text = lambda own, p: json.dumps(own[p], ensure_ascii=False) if p in own else None
        return [{"pointer": p, "before": text(x, p), "after": text(y, p)} for p in sorted(x.keys() | y.keys()) if p not in x or p not in y or x[p] != y[p] or type(x[p]) is not type(y[p])]

    return pd.Series([told(a, b) for a, b in zip(before, after, strict=True)])


def lost(before: Column, after: Column) -> Column:
    """Pointers whose value is gone or null after."""
    return F.transform(F.filter(changes(before, after), lambda c: (F.coalesce(c["before"], F.lit("null")) != "null") & (F.coalesce(c["after"], F.lit("null")) == "null")), lambda c: c["pointer"])


def protected_changes(before: Column, after: Column, allowed: Column) -> Column:
    """Changed pointers that lie neither at nor under an allowed one (array)."""
    return F.filter(F.transform(changes(before, after), lambda c: c["pointer"]), lambda p: ~F.exists(allowed, lambda a: (p == a) | F.startswith(p, F.concat(a, F.lit("/")))))


@F.pandas_udf(StringType())
def scrubbed(col: pd.Series) -> pd.Series:
    """A JSON text in canonical form without string values that are absolute paths."""

    def clean(v: object) -> object:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if not (isinstance(x, str) and x.startswith("/"))}
        return [clean(x) for x in v if not (isinstance(x, str) and x.startswith("/"))] if isinstance(v, list) else v

    return col.map(lambda t: None if _parsed(t) is None else canonical(clean(_parsed(t))))


def filled(col: Column, schema: str) -> Column:
    """A JSON object with every field of a schema (DDL), missing ones null; null for malformed JSON."""
    return F.from_json(col, schema, {"mode": "PERMISSIVE"})


# ---- unions and copies


def unique(values: Column) -> Column:
    """Distinct values in order of their first place; structs and maps are compared by their JSON."""
    keyed = F.transform(values, lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"}))
    return F.filter(values, lambda x, i: F.array_position(keyed, F.get(keyed, i)) == i + 1)


def merged(parts: DataFrame, by: Sequence[str], scalars: Sequence[str], lists: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by..., scalars, lists, conflicts: lists are unions in order of parts, each value once; a scalar that known values ('unknown' is none) disagree on makes all of them null and is named."""
    known = {s: F.collect_set(F.when(T.informative(F.col(s).cast("string")), F.col(s))) for s in scalars}
    own = parts.groupBy(*by).agg(*(v.alias(f"_{s}") for s, v in known.items()), *(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, x))), (lambda x: lambda p: p[x])(x))).alias(x) for x in lists))
    clash = F.filter(F.array(*(F.when(F.size(f"_{s}") > 1, F.lit(s)) for s in scalars)), lambda x: x.isNotNull())
    out = own.withColumn("conflicts", clash)
    return out.select(*by, *(F.when(F.size("conflicts") == 0, F.get(f"_{s}", F.lit(0))).alias(s) for s in scalars), *(unique(F.col(x)).alias(x) for x in lists), "conflicts")


def added(base: DataFrame, more: DataFrame, same: Sequence[str], evidence: str, least: float = 0.5) -> DataFrame:
    """Base, and the rows of `more` that no base row of equal `same` columns (nulls alike) shares evidence with (array<struct<segment, quote>>, at least this overlap)."""
    tagged = more.withColumn("_m", F.monotonically_increasing_id())
    on = None
    for c in same:
        both = F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = both if on is None else on & both
    a, b = tagged.withColumn("_ms", T.spans(F.col(evidence))).alias("m"), base.withColumn("_bs", T.spans(F.col(evidence))).alias("b")
    known = a.join(b, on).where(T.span_overlap(F.col("_ms"), F.col("_bs")) >= least).select("_m").distinct()
    return base.unionByName(tagged.join(known, "_m", "left_anti").drop("_m"))


def retained(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of before that after lacks: empty if all were kept."""
    return before.select(*key).distinct().join(after.select(*key), [*key], "left_anti")


def owners(values: Column) -> Column:
    """Sorted distinct ids of nested arrays of ids."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(values), lambda x: x.isNotNull())))


def owned_by(ids: Column, patient: Column) -> Column:
    """Whether a fact belongs to one patient alone."""
    return F.coalesce((F.size(F.array_distinct(ids)) == 1) & F.array_contains(ids, patient), F.lit(False))


def term(fields: dict[str, Column], otherwise: Column) -> Column:
    """The first field that names a fact, else the given value."""
    return F.coalesce(*(F.nullif(F.trim(fields[n]), F.lit("")) for n in NAMES if n in fields), otherwise)


def species_flag(species: Column) -> Column:
    """True if any is nonhuman, false if all are human, else null (array, nulls are unknown)."""
    own = F.transform(species, lambda s: F.coalesce(s, F.lit("unknown")))
    return F.when(F.array_contains(own, "nonhuman"), True).when((F.size(own) > 0) & F.forall(own, lambda s: s == "human"), False)


def compact(df: DataFrame, drop: Sequence[str] = ("evidence", "attribution_evidence", "field_support")) -> DataFrame:
    """Facts without their evidence payloads."""
    return df.drop(*drop)


# ---- tables


def cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda x: F.trim(x))


def table_grid(segments: DataFrame, article: str = "article", table: str = "table_id", order: str = "pos", text: str = "text") -> DataFrame:
    """Segments of table rows -> article, table, pos, header_pos, header, row (arrays of cells, null where none).

    The last line with bars is a segment's row and the one before it the table's header from there on; a first segment of one such
    line is the header itself if the next segment also has one alone.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    own = Window.partitionBy(article, table).orderBy(order)
    s = segments.withColumn("_lines", lines).withColumn("_n", F.size("_lines"))
    alone = (F.row_number().over(own) == 1) & (F.col("_n") == 1) & (F.lead("_n").over(own) == 1)
    s = s.withColumn("_alone", F.coalesce(alone, F.lit(False)))
    s = s.withColumn("_head", F.when(F.col("_n") >= 2, F.get("_lines", F.col("_n") - 2)).when(F.col("_alone"), F.get("_lines", F.lit(0))))
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_line", F.last("_head", True).over(upto)).withColumn("header_pos", F.last(F.when(F.col("_head").isNotNull(), F.col(order)), True).over(upto))
    row = F.when((F.col("_n") >= 1) & ~F.col("_alone"), cells(F.get("_lines", F.col("_n") - 1)))
    some = F.col("_n") > 0
    return s.select(article, table, order, F.when(some, F.col("header_pos")).alias("header_pos"), F.when(some, cells(F.col("_line"))).alias("header"), row.alias("row"))


def grid_points(grid: DataFrame, keys: Sequence[str], reference_header: str = r"(?i)\b(?:reference|normal)\b") -> DataFrame:
    """table_grid() -> keys..., name, column, time, raw, parsed (parsed_cell()), reference: one row a value cell of a labelled row that parses.

    The first column names the series, a column whose header speaks of a reference is its range, headers of the others are times.
    """
    at = F.array_position(F.transform(F.coalesce("header", F.array()), lambda h: h.rlike(reference_header)), F.lit(True))
    rows = grid.where("row is not null").select(*keys, F.get("row", F.lit(0)).alias("name"), "header", F.when(at > 0, at - 1).cast("int").alias("_ref"), F.posexplode("row").alias("column", "raw"), F.col("row").alias("_row"))
    rows = rows.where((F.col("column") > 0) & (F.col("name") != "") & ~F.col("column").eqNullSafe(F.col("_ref")))
    out = rows.withColumn("parsed", parsed_cell(F.col("raw"))).where("parsed.status = 'parsed'")
    return out.select(*keys, "name", "column", F.nullif(F.get("header", F.col("column")), F.lit("")).alias("time"), "raw", "parsed", F.get("_row", F.col("_ref")).alias("reference"))


def legend_entries(text: Column) -> Column:
    """A footnote, and its entries where semicolons or sentence ends part it."""
    own = F.filter(F.transform(F.split(text, r";|(?<=\.)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text) != "", F.concat(F.array(text), F.when(F.size(own) > 1, own).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def series_rows(points: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Points as one row a series, its points an ordered array of structs."""
    rest = [c for c in points.columns if c not in by]
    return points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias("points"))


# ---- rewriting rules for facts: new values, and what goes to review


def without_unwritten_time(time: Column, date: Column, quotes: Column) -> dict[str, Column]:
    """A time (and its date) that no quote holds is dropped."""
    written = F.coalesce(F.exists(quotes, lambda q: F.contains(q, time)), F.lit(False))
    return {"time": F.when(written, time), "date": F.when(written, date), "audit": F.when(T.informative(time) & ~written, "time_not_in_quotes")}


def quarantined_time(time: Column, quotes: Column) -> dict[str, Column]:
    """The time becomes unknown, and quotes that held only it go while others remain."""
    rest = F.filter(quotes, lambda q: F.trim(q) != F.trim(time))
    return {"time": F.lit("unknown"), "quotes": F.when(F.size(rest) > 0, rest).otherwise(quotes)}


def settled_comparator(comparator: Column, value: Column, quotes: Column) -> dict[str, Column]:
    """An unknown comparator of a number is '=', unless a cue is printed before it, which is for review."""
    from .checks import upper_bound_printed

    open_ = (F.coalesce(comparator, F.lit("unknown")) == "unknown") & value.isNotNull()
    cue = upper_bound_printed(value, quotes)
    return {"comparator": F.when(open_ & ~cue, "=").otherwise(comparator), "review": F.when(open_ & cue, "comparator_cue")}


def settled_absence(assertion: Column, verification: Column, quotes: Column) -> dict[str, Column]:
    """Absent but confirmed, provisional or differential: refuted after a work-up, unknown where the history denies it; both or neither, or a table row, is for review."""
    text = F.array_join(quotes, " ")
    workup = text.rlike(r"(?i)\b(?:ruled out|excluded|negative|no evidence|workup|work-up)\b")
    denied = text.rlike(r"(?i)\b(?:denied|denies|no history|without history|never had)\b")
    due = (assertion == "absent") & verification.isin("confirmed", "provisional", "differential")
    clear = due & (workup != denied) & ~F.contains(text, F.lit("|"))
    return {"verification": F.when(clear & workup, "refuted").when(clear, "unknown").otherwise(verification), "review": F.when(F.coalesce(due & ~clear, F.lit(False)), "absent_but_confirmed")}


def settled_flag(flag: Column, text: Column) -> Column:
    """A result that says normal is flagged so."""
    return F.when(~T.informative(flag) & text.rlike(r"(?i)^\s*(?:within normal limits|normal|unremarkable)\b"), "normal").otherwise(flag)


def settled_use(status: Column, assertion: Column, quotes: Column) -> dict[str, Column]:
    """Never-use is a present finding if a quote says so; without a cue it is for review."""
    cue = F.exists(quotes, lambda q: q.rlike(r"(?i)\b(?:never|non-?smoker|denie[ds]|no (?:history|use) of|does not)\b"))
    due = F.coalesce((status == "never") & (assertion == "absent"), F.lit(False))
    return {"assertion": F.when(due & cue, "present").otherwise(assertion), "review": F.when(due & ~cue, "never_without_cue")}


def settled_performance(assertion: Column, reason: Column) -> Column:
    """What was not performed is neither present nor absent."""
    return F.when(reason == "not_performed", "unknown").otherwise(assertion)


def settled_anchor(anchor: Column, relation: Column, source: Column) -> dict[str, Column]:
    """An anchor that the source doesn't print goes, and a relation without one is unknown."""
    kept = F.when(F.contains(F.lower(source), F.lower(anchor)), anchor)
    return {"anchor": kept, "relation": F.when(kept.isNull() & relation.isin("before", "after", "during", "at"), "unknown").otherwise(relation)}


def mapped(c: Column, values: dict[str, str]) -> Column:
    """Old values by their new ones, others as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), c), c)
