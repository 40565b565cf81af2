"""Article identifiers and their addresses as column expressions of built-in functions; anything that isn't a whole identifier is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name prefixes of records with their kinds, hosts of identifier services, yes and no words.
KINDS = (("pmc-", "published_case_summary"), ("usmle-", "educational_vignette"), ("trec-cds-2016-", "ehr_summary"), ("trec-cds-2014-", "synthetic_vignette"), ("trec-cds-2015-", "synthetic_vignette"), ("trec-ct-", "synthetic_vignette"))
PUBMED, PMC, DOI_HOST = "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "doi.org"
PMC_HOSTS, DOI_HOSTS = (PMC, "www.ncbi.nlm.nih.gov"), (DOI_HOST, "dx.doi.org")
YES, NO = ("yes", "true", "1"), ("no", "false", "0")
KEYS = ("pmid", "pmcid", "doi")


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def source_kind(record_id: Column) -> Column:
    out = F.when(F.lit(False), "")
    for prefix, kind in KINDS:
        out = out.when(F.startswith(F.lower(record_id), F.lit(prefix)), kind)
    return out.otherwise("unknown")


def flag(c: Column) -> Column:
    """yes/true/1 and no/false/0 as a boolean, whatever their case; else null."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def pmid(c: Column) -> Column:
    """Digits without leading zeros, above 0."""
    return _or_null(F.regexp_extract(F.trim(c.cast("string")), r"^0*([1-9]\d*)$", 1))


def pmcid(c: Column) -> Column:
    """PMC and a number, without its version."""
    n = F.regexp_extract(F.trim(c), r"(?i)^PMC([1-9]\d*)(?:\.\d+)?$", 1)
    return F.when(n != "", F.concat(F.lit("PMC"), n))


def doi(c: Column) -> Column:
    """10.nnnn/suffix, from itself, from doi:... or from an address of a resolver."""
    t = F.trim(c)
    address = t.rlike(r"(?i)^https?://(dx\.)?doi\.org/") & ~t.rlike(r"(?i)^http://dx\.")
    path = F.regexp_replace(F.regexp_replace(t, r"(?i)^https?://[^/]+/+", ""), r"[?#].*$", "")
    t = F.when(address, F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(t)
    t = F.trim(F.regexp_replace(t, "(?i)^doi:", ""))
    return F.when(t.rlike(r"^10\.\d{4,9}/\S+$"), t)


def from_address(url: Column) -> Column:
    """struct<pmid, pmcid, doi> of a web address of an identifier service; addresses with a user name tell nothing."""
    u = F.trim(url)
    sound = u.rlike(r"(?i)^https?://[^/@\s]+(/|$)")
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://([^/:?#]+)", 1))
    path = F.try_url_decode(F.replace(F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1), F.lit("+"), F.lit("%2B")))
    bare = F.trim(F.regexp_replace(path, "^/+|/+$", ""))
    in_pmc = host.isin(*PMC_HOSTS)
    by_pmid = F.when(host == PUBMED, pmid(bare)).when(in_pmc, pmid(F.regexp_extract(path, r"^/pubmed/(\d+)/?$", 1)))
    by_pmc = F.when(in_pmc, pmcid(F.regexp_extract(path, r"(?i)^/(?:pmc/)?articles/(PMC\d+(?:\.\d+)?)/?$", 1)))
    by_doi = F.when(host.isin(*DOI_HOSTS), doi(F.regexp_replace(path, "^/+", "")))
    return F.struct(F.when(sound, by_pmid).alias("pmid"), F.when(sound, by_pmc).alias("pmcid"), F.when(sound, by_doi).alias("doi"))


def addresses(pmid_: Column, pmcid_: Column, doi_: Column) -> Column:
    """struct<pubmed_url, pmc_url, doi_url>."""
    escaped = F.url_encode(doi_)
    for sign in "/():;":
        escaped = F.replace(escaped, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.struct(F.concat(F.lit(f"https://{PUBMED}/"), pmid_, F.lit("/")).alias("pubmed_url"), F.concat(F.lit(f"https://{PMC}/articles/"), pmcid_, F.lit("/")).alias("pmc_url"), F.concat(F.lit(f"https://{DOI_HOST}/"), escaped).alias("doi_url"))


def merged_claims(claims: list[dict[str, Column]]) -> dict[str, Column]:
    """For each identifier its one claimed value, null if claims differ, and `conflicts`: array<struct<key, values>> of those that do.

    Claims are compared as they are; nulls claim nothing.
    """
    every = {k: F.array_sort(F.array_distinct(F.filter(F.array(*(c[k] for c in claims if k in c)), lambda x: x.isNotNull()))) for k in KEYS}
    out = {k: F.when(F.size(v) == 1, F.get(v, F.lit(0))) for k, v in every.items()}
    clash = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("values")) for k, v in every.items()))
    return out | {"conflicts": F.filter(clash, lambda c: F.size(c["values"]) > 1)}


def added_claim(known: Column, claim: Column) -> Column:
    """struct<value, conflict>: a known value is never overwritten; another claim, whatever its case, is a conflict."""
    clash = known.isNotNull() & claim.isNotNull() & (F.lower(known) != F.lower(claim))
    return F.struct(F.when(clash, known).otherwise(F.coalesce(claim, known)).alias("value"), F.when(clash, F.array(known, claim)).alias("conflict"))


def https_address(c: Column, hosts: tuple[str, ...]) -> Column:
    """s3://bucket/path as an address of the bucket's web host; an address of one of the hosts as it is; else null."""
    bucket, path = F.regexp_extract(c, r"^s3://([^/]+)/(.+)$", 1), F.regexp_extract(c, r"^s3://([^/]+)/(.+)$", 2)
    web = F.when(bucket != "", F.concat(F.lit("https://"), bucket, F.lit(".s3.amazonaws.com/"), path)).otherwise(c)
    return F.when(F.lower(F.regexp_extract(web, r"^https://([^/:?#@]+)/", 1)).isin(*hosts), web)


def media_class(name: Column) -> Column:
    """A file's class by its suffix."""
    from .text import extension

    end = extension(name)
    return F.when(end.isin(".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".svg"), "image").when(end.isin(".mp4", ".mov", ".avi", ".webm", ".mpg"), "video").when(end.isin(".pdf", ".doc", ".docx", ".txt", ".rtf", ".odt"), "document").when(end.isin(".csv", ".tsv", ".xls", ".xlsx"), "table").otherwise("other")


def content_type(head: Column, name: Column) -> Column:
    """A file's type by its first bytes, else by its suffix; null if neither tells."""
    from .text import extension

    start = F.hex(F.substring(head, 1, 12))
    out = F.when(F.lit(False), "")
    for magic, kind in (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("25504446", "pdf"), ("1F8B", "gzip"), ("504B0304", "zip"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("1A45DFA3", "matroska"), ("D0CF11E0A1B11AE1", "ole")):
        out = out.when(F.startswith(start, F.lit(magic)), kind)
    out = out.when(start.rlike("^.{8}66747970"), "mp4").when(F.hex(F.substring(head, 129, 4)) == "4449434D", "dicom")
    office = F.when(extension(name).isin(".docx", ".xlsx", ".pptx"), F.substring(extension(name), 2, 10))
    by_name = F.nullif(F.substring(extension(name), 2, 20), F.lit(""))
    return F.coalesce(F.when(out == "zip", office), out, by_name)


def image_size(head: Column) -> Column:
    """struct<width, height> from the header of a PNG, GIF or BMP image; null for others."""
    def number(at: int, n: int, little: bool) -> Column:
        h = F.hex(F.substring(head, at, n))
        return F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(n)))) if little else h, 16, 10).cast("bigint")

    start = F.hex(F.substring(head, 1, 8))
    png, gif, bmp = start == "89504E470D0A1A0A", start.rlike("^474946383[79]61"), start.rlike("^424D")
    width = F.when(png, number(17, 4, False)).when(gif, number(7, 2, True)).when(bmp, number(19, 4, True))
    height = F.when(png, number(21, 4, False)).when(gif, number(9, 2, True)).when(bmp, number(23, 4, True))
    return F.when(width.isNotNull(), F.struct(width.alias("width"), height.alias("height")))
