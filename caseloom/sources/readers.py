"""Scans: JSON lines, canonical records, wide files, XML articles, ZIP and spreadsheet listings, fixed-width releases, keyed caches.

All read in parallel by Spark's own file sources (gzip as it is); checks that fail the scan are expressions in the plan, so a bad row stops the job
with its message instead of passing silently.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caseloom.functions.identifiers import source_kind
from caseloom.functions.labels import json_digest

MOST_PREVIEW = 1 << 20


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines (also gzipped); blank lines are skipped, a line that isn't an object of the schema fails the scan. With `_file`.

    Without a schema: `value` (the line) alone, checked to be an object.
    """
    if schema:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_file", F.col("_metadata.file_path"))
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).where(F.trim("value") != "")
    sound = F.col("value").rlike(r"^\s*\{") & F.is_variant_null(F.try_parse_json("value")).eqNullSafe(F.lit(False))
    return lines.withColumn("value", F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), F.col("_file")))))


def canonical_records(lines: DataFrame, value: str = "value", revision: str = "local-unversioned") -> DataFrame:
    """JSON lines of cases -> record_id, text, source_hash, source_kind, dataset_revision, source_id, original_row, original_row_hash.

    record_id or _id and text or description are due; a given hash must be the text's. Rows that break this fail the scan.
    """
    get = lambda *names: F.coalesce(*(F.get_json_object(value, f"$.{n}") for n in names))
    rid, text = get("record_id", "_id"), get("text", "description")
    fail = lambda why: F.raise_error(F.concat(F.lit(why + " "), F.coalesce(rid, F.lit("?"))))
    whole = F.when(F.coalesce(rid, F.lit("")) == "", fail("no id:")).when(F.trim(F.coalesce(text, F.lit(""))) == "", fail("no text in")).when(get("source_hash").isNotNull() & (get("source_hash") != F.sha2(text, 256)), fail("another hash than the text's in")).otherwise(rid)
    return lines.select(
        whole.alias("record_id"), text.alias("text"), F.sha2(text, 256).alias("source_hash"), F.coalesce(get("source_kind"), source_kind(rid)).alias("source_kind"),
        F.coalesce(get("dataset_revision"), F.lit(revision)).alias("dataset_revision"), F.coalesce(get("source_id", "_id"), rid).alias("source_id"), F.col(value).alias("original_row"), json_digest(F.col(value)).alias("original_row_hash"),
    )


def unique_records(rows: DataFrame, id_: str = "record_id", limit: int | None = None) -> DataFrame:
    """Rows (the first `limit` by id), failing if an id repeats."""
    own = rows.orderBy(id_).limit(limit) if limit is not None else rows
    n = own.groupBy(id_).agg(F.count("*").alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(id_).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return own.join(n, id_).where(once).drop("_n")


def page(rows: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def last_wins(rows: DataFrame, key: str, file: str, pos: str) -> DataFrame:
    """Of rows of one key the last one of the last file, as if files were read in order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(file, pos)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


def newest_file(files: DataFrame, key: str, path: str = "path", modified: str = "modificationTime") -> DataFrame:
    """key, path of its file that changed last."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(modified, path)).alias(path))


def fresh(cache: DataFrame, key: str, expires: str, now: Column, allow_stale: bool = False) -> DataFrame:
    """Entries of a cache that haven't expired (allow_stale: all), the last one of each key."""
    rest = [c for c in cache.columns if c != key]
    last = cache.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(expires)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))
    return last if allow_stale else last.where(F.col(expires) >= now)


def chosen_view(views: DataFrame, key: str, kind: str, preferred: str, fallbacks: Sequence[str], sound: Column) -> DataFrame:
    """Of each key the view of the preferred kind, else the first fallback that is there; unsound ones don't count."""
    order = F.array_position(F.array(*map(F.lit, (preferred, *fallbacks))), F.col(kind))
    rest = [c for c in views.columns if c != key]
    return views.where(sound & (order > 0)).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


def stored_path(kind: Column, article: Column, role: Column | None = None, supplement: Column | None = None) -> Column:
    """kind/article[/role][/supplement].json"""
    return F.concat(F.concat_ws("/", kind, article, *(x for x in (role, supplement) if x is not None)), F.lit(".json"))


def stored_ids(files: DataFrame, kind: str, path: str = "path", like: str | None = None) -> DataFrame:
    """article: sorted distinct ids of a kind's files; like: with a shell pattern (* and ?)."""
    own = files.select(F.regexp_extract(path, rf"(?:^|/){re.escape(kind)}/([^/]+?)(?:/.*)?(?:\.json)?$", 1).alias("article")).where("article <> ''").distinct()
    if like:
        own = own.where(F.col("article").rlike("^" + re.escape(like).replace(r"\*", ".*").replace(r"\?", ".") + "$"))
    return own.orderBy("article")


def inventory(spark: SparkSession, path: str | list[str], like: str = "*") -> DataFrame:
    """path, length, sha256 of files; contents are hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", like).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, state: added, removed or changed, of two inventories."""
    both = before.select("path", F.col("sha256").alias("_b")).join(after.select("path", F.col("sha256").alias("_a")), "path", "full")
    return both.withColumn("state", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")).where("state is not null").select("path", "state")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", most_rows: int | None = None, most_columns: int | None = None) -> DataFrame:
    """A table with its first line as names, all texts; the caps are a preview's."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')
    df = df.select(*df.columns[:most_columns]) if most_columns else df
    return df.limit(most_rows) if most_rows is not None else df


def fixed_width(lines: DataFrame, line: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Fields as (first place from 1, length), trimmed; blank ones are null."""
    return lines.select(*(F.nullif(F.trim(F.substring(line, a, n)), F.lit("")).alias(k) for k, (a, n) in fields.items()))


def inherited(nodes: DataFrame, key: str, prefixes: DataFrame, prefix: str, value: str, most: int = 8) -> DataFrame:
    """Nodes with the value of their longest prefix that has one: an equi-join on each prefix length up to `most`, then the longest."""
    own = nodes.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(key), F.lit(most))), lambda n: F.substr(F.col(key), F.lit(1), n))))
    found = own.join(prefixes.select(F.col(prefix).alias("_p"), F.col(value).alias("_v")), "_p").groupBy(key).agg(F.max_by("_v", F.length("_p")).alias(value))
    return nodes.join(found, key, "left")


def preview_text(cells: Column) -> Column:
    """A preview (array of arrays of cells) as searchable lines."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.filter(row, lambda c: c.isNotNull()), " ")), "\n")


# ---- files that Python takes apart, one at a time, where they lie


def _per_file(files: DataFrame, fields: str, told) -> DataFrame:
    """path, fields..., error: rows that told(content) yields; a file that can't be read gives one row with its error."""
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, *row, None) for row in told(bytes(content))]
                except (ValueError, KeyError, IndexError, ET.ParseError, zipfile.BadZipFile) as e:
                    out.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {fields}, error string")


def zip_entries(files: DataFrame) -> DataFrame:
    """path, pos, name, size, error of the members of ZIP files."""
    return _per_file(files, "pos int, name string, size bigint", lambda c: ((k, i.filename, i.file_size) for k, i in enumerate(zipfile.ZipFile(io.BytesIO(c)).infolist())))


def _safe_xml(text: bytes) -> ET.Element:
    if b"<!ENTITY" in text:
        raise ValueError("entities are not read")
    return ET.fromstring(text)


def spreadsheet_rows(files: DataFrame, most_rows: int | None = None) -> DataFrame:
    """path, sheet, row (from 1), cells (array of texts, gaps null), error of XLSX files."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def place(ref: str) -> int:
        n = 0
        for ch in re.match("[A-Z]*", ref)[0]:
            n = n * 26 + ord(ch) - 64
        return n - 1

    def told(content: bytes) -> Iterator[tuple]:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = book.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in _safe_xml(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for r, row in enumerate(_safe_xml(book.read(name)).iter(f"{ns}row"), 1):
                if most_rows is not None and r > most_rows:
                    break
                own: dict[int, str | None] = {}
                for k, c in enumerate(row.iter(f"{ns}c")):
                    v = c.find(f"{ns}v")
                    text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    own[place(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" and text else text
                yield name.rsplit("/", 1)[-1].removesuffix(".xml"), int(row.get("r") or r), [own.get(k) for k in range(max(own, default=-1) + 1)]

    return _per_file(files, "sheet string, row int, cells array<string>", told)


def slide_texts(files: DataFrame) -> DataFrame:
    """path, pos, text, error: paragraphs of PPTX slides and DOCX bodies in order."""

    def told(content: bytes) -> Iterator[tuple]:
        archive, n = zipfile.ZipFile(io.BytesIO(content)), 0
        number = lambda s: int((re.findall(r"\d+", s) or ["0"])[-1])
        for name in sorted((x for x in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml|word/document\.xml", x)), key=number):
            for p in _safe_xml(archive.read(name)).iter():
                if p.tag.rsplit("}", 1)[-1] == "p" and (text := "".join(t.text or "" for t in p.iter() if t.tag.rsplit("}", 1)[-1] == "t").strip()):
                    n += 1
                    yield n, text

    return _per_file(files, "pos int, text string", told)


def embedded_media(files: DataFrame, most: int = 500) -> DataFrame:
    """path, name, size, error of media parts of office files; more than `most` parts are an error."""

    def told(content: bytes) -> Iterator[tuple]:
        parts = [i for i in zipfile.ZipFile(io.BytesIO(content)).infolist() if re.search(r"(^|/)media/[^/]+$", i.filename)]
        if len(parts) > most:
            raise ValueError("too many media parts")
        return ((i.filename, i.file_size) for i in parts)

    return _per_file(files, "name string, size bigint", told)


def article_segments(files: DataFrame) -> DataFrame:
    """path, segment, kind, heading, text, table_id, label, href, error of JATS articles, in document order.

    Kinds: title, abstract, paragraph, table_row (header line, then its row, cells between bars), table_footnote, figure (its caption, with href).
    Superscripts are written ^(..), subscripts _(..), citations of the reference list are left out.
    """

    def local(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def clean(e: ET.Element) -> str:
        def inner(x: ET.Element) -> str:
            name = local(x)
            own = (x.text or "") + "".join(inner(c) + (c.tail or "") for c in x)
            if name == "xref" and x.get("ref-type") == "bibr":
                return ""
            return f"^({own.strip()})" if name == "sup" and own.strip() else f"_({own.strip()})" if name == "sub" and own.strip() else own

        return re.sub(r"\s+", " ", inner(e)).strip()

    def told(content: bytes) -> Iterator[tuple]:
        root, n = _safe_xml(content), 0

        def made(kind: str, text: str, heading: str | None = None, table: str | None = None, label: str | None = None, href: str | None = None) -> tuple:
            nonlocal n
            n += 1
            return f"b{n:05d}", kind, heading, text, table, label, href

        def table(e: ET.Element, heading: str | None) -> Iterator[tuple]:
            name = e.get("id") or f"t{n}"
            title = next((clean(c) for c in e.iter() if local(c) == "caption"), "")
            label = next((clean(c) for c in e if local(c) == "label"), None)
            head = ""
            for row in (r for r in e.iter() if local(r) == "tr"):
                line = " | ".join(clean(c) for c in row if local(c) in ("td", "th"))
                if all(local(c) == "th" for c in row) and not head:
                    head = line
                    continue
                yield made("table_row", "\n".join(x for x in (title, head, line) if x), heading, name, label)
            for foot in (f for f in e.iter() if local(f) == "table-wrap-foot"):
                if text := clean(foot):
                    yield made("table_footnote", text, heading, name, label)

        def section(e: ET.Element, heading: str | None, kind: str) -> Iterator[tuple]:
            for c in e:
                name = local(c)
                if name == "sec":
                    yield from section(c, next((clean(t) for t in c if local(t) == "title"), heading), kind)
                elif name == "p":
                    if text := clean(c):
                        yield made(kind, text, heading)
                    for inside in (x for x in c.iter() if local(x) in ("table-wrap", "fig")):
                        yield from section([inside], heading, kind)
                elif name == "table-wrap":
                    yield from table(c, heading)
                elif name == "fig":
                    href = next((v for g in c.iter() if local(g) == "graphic" for k, v in g.attrib.items() if k.endswith("href")), None)
                    yield made("figure", next((clean(x) for x in c.iter() if local(x) == "caption"), ""), heading, None, next((clean(x) for x in c if local(x) == "label"), None), href)

        for e in root.iter():
            if local(e) == "article-title":
                yield made("title", clean(e))
                break
        for e in root.iter():
            if local(e) == "abstract":
                yield from section(e, "Abstract", "abstract")
        for e in root.iter():
            if local(e) == "body":
                yield from section(e, None, "paragraph")

    return _per_file(files, "segment string, kind string, heading string, text string, table_id string, label string, href string", told)


def cross_references(files: DataFrame) -> DataFrame:
    """path, kind, target, text, error of the inline references of XML articles."""

    def told(content: bytes) -> Iterator[tuple]:
        return ((x.get("ref-type"), x.get("rid"), "".join(x.itertext()).strip()) for x in _safe_xml(content).iter() if isinstance(x.tag, str) and x.tag.rsplit("}", 1)[-1] == "xref")

    return _per_file(files, "kind string, target string, text string", told)


def bibliography(files: DataFrame) -> DataFrame:
    """path, ref, text, pmid, doi, error of the reference list."""

    def told(content: bytes) -> Iterator[tuple]:
        for r in _safe_xml(content).iter():
            if isinstance(r.tag, str) and r.tag.rsplit("}", 1)[-1] == "ref":
                ids = {p.get("pub-id-type"): (p.text or "").strip() for p in r.iter() if isinstance(p.tag, str) and p.tag.rsplit("}", 1)[-1] == "pub-id"}
                yield r.get("id"), re.sub(r"\s+", " ", " ".join(r.itertext())).strip(), ids.get("pmid"), ids.get("doi")

    return _per_file(files, "ref string, text string, pmid string, doi string", told)


def matched_graphics(figures: DataFrame, media: DataFrame, article: str = "article") -> DataFrame:
    """Figures (article, figure, href) with `media`: the file of the article with that path, else of that name, else (an href without suffix) of that stem; the first by path."""
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    stem = lambda c: F.regexp_replace(base(c), r"\.[^.]+$", "")
    f = figures.select(article, "figure", "href", F.array(F.struct(F.lit(0).alias("k"), F.col("href").alias("x")), F.struct(F.lit(1).alias("k"), base(F.col("href")).alias("x")), F.when(~F.contains(base(F.col("href")), F.lit(".")), F.struct(F.lit(2).alias("k"), base(F.col("href")).alias("x")))).alias("_ways"))
    f = f.withColumn("_w", F.explode(F.filter("_ways", lambda w: w.isNotNull()))).select(article, "figure", "href", F.col("_w.k").alias("_k"), F.col("_w.x").alias("_x"))
    m = media.select(article, "path", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("path").alias("x")), F.struct(F.lit(1).alias("k"), base(F.col("path")).alias("x")), F.struct(F.lit(2).alias("k"), stem(F.col("path")).alias("x")))).alias("_w")).select(article, "path", F.col("_w.k").alias("_k"), F.col("_w.x").alias("_x"))
    best = f.join(m, [article, "_k", "_x"]).groupBy(article, "figure").agg(F.min(F.struct("_k", "path")).alias("_b"))
    return figures.join(best, [article, "figure"], "left").withColumn("media", F.col("_b.path")).drop("_b")


def media_manifest(media: DataFrame, article: str, url: str, prefix: Column) -> DataFrame:
    """Files once each by address, those below their article's prefix, with their class."""
    from caseloom.functions.identifiers import media_class

    return media.where(F.startswith(F.col(url), prefix)).dropDuplicates([article, url]).withColumn("media_class", media_class(F.col(url)))


def ordinal(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
