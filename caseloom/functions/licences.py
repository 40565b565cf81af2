"""Licence names, addresses and decisions as column expressions of built-in functions.

A name is only taken whole: 'CC BY-NC 4.0', a Creative Commons address, an SPDX identifier or a known alias. Versions and jurisdictions stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .identifiers import flag
from .lets import let

# Groups of codes, aliases, words for no classification, accepted versions, obligations.
SHARED = ("CC0", "CC BY", "CC BY-NC", "CC BY-NC-SA", "CC BY-SA")
SOFTWARE = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense")
WORLDWIDE = "Public domain worldwide"
ACCEPTED = (*SHARED, *SOFTWARE, "PDM", WORLDWIDE)
NO_CHANGES = ("CC BY-ND", "CC BY-NC-ND")
OPEN_ONLY = ("CC0", "CC BY", "CC BY-SA", "PDM", WORLDWIDE)
UNCLASSIFIED = ("", "unknown", "other", "custom", "non-cc", "non cc", "no-cc", "none", "n/a", "public domain", "public-domain", "pd")
ALIASES = {c.lower(): c for c in SOFTWARE} | {"mit license": "MIT", "mit no attribution": "MIT-0", "apache license, version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "bsd 2-clause": "BSD-2-Clause", "bsd 3-clause": "BSD-3-Clause", "isc license": "ISC", "the unlicense": "Unlicense", "public domain worldwide": WORLDWIDE}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
IDENTITY = "struct<code:string,version:string,jurisdiction:string,url:string>"


def _spelled(letters: Column) -> Column:
    """Code of a Creative Commons attribution licence from its letters, in whatever spelling ('by-nc-sa', 'Attribution-NonCommercial')."""
    flat = F.upper(F.regexp_replace(letters, r"[\s_-]", ""))
    has = lambda long, short: F.contains(flat, F.lit(long)) | flat.rlike(short)
    part = lambda name, *how: F.when(has(*how), f"-{name}").otherwise("")
    return F.concat(F.lit("CC BY"), part("NC", "NONCOMMERCIAL", "^(CC)?BYNC"), part("SA", "SHAREALIKE", "^(CC)?BY(NC)?SA$"), part("ND", "NODERIVATIVES", "^(CC)?BY(NC)?ND$"))


def identity(c: Column) -> Column:
    """struct<code, version, jurisdiction, url> of a whole name, identifier or official address; null for anything else."""
    blank = lambda x: F.nullif(x, F.lit(""))

    def of_name(token: Column, url: Column) -> Column:
        low = F.lower(token)
        words = r"(?:\s+(?:International|Unported|License))*$"
        # letters, then a version after blanks or hyphens
        attribution = r"(?i)^(CC[\s-]*BY(?:[\s-]*NC)?(?:[\s-]*(?:SA|ND))?|Creative Commons Attribution(?:[\s-]*Non[\s-]*Commercial)?(?:[\s-]*(?:Share[\s-]*Alike|No[\s-]*Derivatives))?)(?:[\s-]+(?:License[\s,]*)?(?:v(?:ersion)?\s*)?(\d+\.\d+))?" + words
        public = r"(?i)^(CC[\s-]*0|PDM|Public Domain Mark)(?:[\s-]+(\d+\.\d+))?(?:\s+(?:Universal|License))*$"
        by, domain = F.regexp_extract(token, attribution, 1), F.regexp_extract(token, public, 1)
        alias = F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), low)
        code = F.when(by != "", _spelled(F.regexp_replace(by, "(?i)Creative Commons Attribution", "BY"))).when(domain.rlike("(?i)^CC"), "CC0").when(domain != "", "PDM").otherwise(alias)
        version = F.coalesce(blank(F.regexp_extract(token, attribution, 2)), blank(F.regexp_extract(token, public, 2)), F.when(code == "Apache-2.0", "2.0"))
        return F.when(code.isNotNull(), F.struct(code.alias("code"), version.alias("version"), F.lit(None).cast("string").alias("jurisdiction"), url.alias("url")))

    def of_address(raw: Column) -> Column:
        full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
        host = F.regexp_replace(F.lower(F.regexp_extract(full, r"(?i)^https?://([^/:?#@]+)(?=[/:?#]|$)", 1)), r"^www\.", "")
        path = F.regexp_replace(F.regexp_extract(full, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
        page = r"(?:/(?:legalcode|deed)(?:\.[A-Za-z_-]+)?)?$"
        licence = r"(?i)^/licenses/(by(?:-nc)?(?:-sa|-nd)?)/(\d+\.\d+)(?:/([a-z]{2}|igo|legalcode|deed))?" + page
        domain = r"(?i)^/publicdomain/(zero|mark)/(\d+\.\d+)" + page
        letters, kind = F.regexp_extract(path, licence, 1), F.lower(F.regexp_extract(path, domain, 1))
        place = F.lower(F.regexp_extract(path, licence, 3))
        code = F.when(host == "creativecommons.org", F.when(letters != "", _spelled(letters)).when(kind == "zero", "CC0").when(kind == "mark", "PDM"))
        code = F.coalesce(code, F.when((host == "apache.org") & path.rlike(r"^/licenses/LICENSE-2\.0(\.txt|\.html)?$"), "Apache-2.0"), F.when((host == "unlicense.org") & path.isin("", "/UNLICENSE"), "Unlicense"))
        version = F.coalesce(blank(F.regexp_extract(path, licence, 2)), blank(F.regexp_extract(path, domain, 2)), F.when(code == "Apache-2.0", "2.0"))
        own = F.struct(code.alias("code"), version.alias("version"), F.when(~place.isin("", "legalcode", "deed"), place).alias("jurisdiction"), raw.alias("url"))
        listed = F.when(host.isin("spdx.org", "opensource.org"), blank(F.regexp_replace(F.regexp_extract(path, "^/licenses/(.+)$", 1), r"\.(html|php)$", "")))
        return F.when(code.isNotNull(), own).otherwise(of_name(F.replace(listed, F.lit("_"), F.lit("-")), raw))

    raw = F.trim(c)
    address = raw.rlike(r"(?i)^(https?://|www\.|creativecommons\.org/)")
    token = F.trim(F.regexp_replace(F.replace(raw, F.lit("_"), F.lit("-")), r"\s+", " "))
    found = let(F.struct(raw.alias("raw"), token.alias("token"), address.alias("address")), lambda v: F.when(v["address"], of_address(v["raw"])).otherwise(of_name(v["token"], F.lit(None).cast("string"))))
    return F.when(F.coalesce(raw, F.lit("")) != "", found).cast(IDENTITY)


def normalized(c: Column) -> Column:
    return identity(c)["code"]


URL = r"(?i)(?:https?://|www\.)[^\s<>\"']+|(?<![\w./])creativecommons\.org/[^\s<>\"']+"
NAMED = r"(?i)(?<![\w-])(?:CC[\s-]*BY(?:[\s-]*NC)?(?:[\s-]*(?:SA|ND))?|Creative Commons Attribution(?:[\s-]*Non[\s-]*Commercial)?(?:[\s-]*(?:Share[\s-]*Alike|No[\s-]*Derivatives))?|CC[\s-]*0|PDM|Public Domain Mark)(?:[\s-]+(?:License[\s,]*)?(?:v(?:ersion)?\s*)?\d+\.\d+)?(?![\w-])"


def mentioned(text: Column) -> Column:
    """array<IDENTITY> of all licences that a prose text names: addresses first, then names outside addresses, each once."""
    t = F.coalesce(text, F.lit(""))
    urls = F.transform(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), lambda u: identity(F.regexp_replace(u, r"[.,);\]]+$", "")))
    alias = r"(?i)(?<![\w-])(?:" + "|".join(a.replace(".", r"\.") for a in sorted(ALIASES, key=len, reverse=True)) + r")(?![\w-])"
    prose = F.regexp_replace(t, URL, " ")
    names = F.transform(F.concat(F.regexp_extract_all(prose, F.lit(NAMED), F.lit(0)), F.regexp_extract_all(prose, F.lit(alias), F.lit(0))), identity)
    return F.array_distinct(F.filter(F.concat(urls, names), lambda x: x.isNotNull()))


def lane(code: Column, version: Column) -> Column:
    """The release lane of an accepted code."""
    return F.when(code == "CC BY-SA", "sharealike_source_terms").when((code == "CC BY-NC-SA") & (version == "1.0"), "legacy_sharealike_source_terms").when(code == "PDM", "public_domain_mark").when(code == WORLDWIDE, "public_domain_statement").when(code.isin(*SOFTWARE), "permissive_source_terms").otherwise("noncommercial_compatible")


def _said(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def decision(code: Column, retracted: Column, open_access: Column, text: Column, open_only: bool = False) -> Column:
    """struct<outcome, reason, code, version, lane, obligations> of an article's declared code, flags and licence prose.

    An ordered ladder: the first rule that holds decides; retraction and access come before any conflict. open_only: also refuses what isn't CC0, CC BY, CC BY-SA or public domain.
    """
    declared = identity(code)
    found = mentioned(text)
    worldwide = _said(text, r"\b(?:this|the|entire)\s+(?:article|paper|work|publication)\s+is\s+(?:dedicated to|in)\s+the public domain\s+(?:worldwide|throughout the world)\b")

    def decide(v: Column) -> Column:
        said = F.array_distinct(F.transform(v["found"], lambda x: x["code"]))
        said = F.when(v["worldwide"], F.array_union(said, F.array(F.lit(WORLDWIDE)))).otherwise(said)
        apart = _said(text, r"\b(?:software|source code|code|data ?sets?|figures?|images?|supplements?|supplementary material)\b")
        article = _said(text, r"\b(?:this|the|entire)\s+(?:article|paper|work|publication)\b")
        unclear = (F.size(said) > 0) & apart & (~article | (F.size(said) > 1))
        explicit = F.when(unclear, F.array().cast("array<string>")).otherwise(said)
        final = F.coalesce(v["declared"]["code"], F.when(F.size(explicit) == 1, F.get(explicit, F.lit(0))))
        same = F.filter(F.concat(F.array(v["declared"]), F.when(unclear, F.array().cast(f"array<{IDENTITY}>")).otherwise(v["found"])), lambda x: x["code"] == final)
        versions = F.array_distinct(F.filter(F.transform(same, lambda x: x["version"]), lambda x: x.isNotNull()))
        places = F.array_distinct(F.filter(F.transform(same, lambda x: x["jurisdiction"]), lambda x: x.isNotNull()))
        version = F.when(F.size(versions) == 1, F.get(versions, F.lit(0)))
        restricted = _said(text, r"\bno[\s-]*derivatives\b|\bcannot be changed\b|\ball rights reserved\b|\bnot (?:licensed|distributed|available) under\b|\b(?:additional|further) restrictions\b") | (v["worldwide"] & _said(text, r"\b(?:not|never|no longer)\b"))
        compound = _said(text, r"\bdual[ -]licens|\blicensed under both\b|\b(?:CC[\s-]*BY(?:[\s-]*NC)?(?:[\s-]*(?:SA|ND))?|MIT(?:-0)?|Apache-2\.0|BSD-[23]-Clause|ISC|0BSD|Unlicense)\s+(?:AND|OR|WITH)\s+\w")
        old = F.when(final.isin("CC0", "PDM"), version != "1.0").when(final.isin(*SHARED), ~version.isin(*VERSIONS)).otherwise(F.lit(False))
        clash = (F.size(explicit) > 1) | ((F.size(explicit) == 1) & v["declared"].isNotNull() & (F.get(explicit, F.lit(0)) != v["declared"]["code"]))
        rules = [
            (flag(retracted).isNull() | flag(retracted), "rejected", "retracted_or_retraction_status_unknown"),
            (flag(open_access).isNull() | ~flag(open_access), "rejected", "not_verified_open_access"),
            (clash, "review", "conflicting_license_statements"),
            ((F.size(versions) > 1) | (F.size(places) > 1), "review", "conflicting_license_versions_or_jurisdictions"),
            (unclear, "review", "article_license_scope_requires_review"),
            (compound, "review", "compound_license_terms_require_review"),
            (final.isin(*NO_CHANGES), "rejected", "license_disallows_adaptations"),
            (restricted, "review", "restrictive_license_prose_requires_review"),
            (v["declared"].isNull() & ~F.lower(F.trim(F.coalesce(code, F.lit("")))).isin(*UNCLASSIFIED), "review", "unrecognized_metadata_terms_require_review"),
            (final.isNull() | ~final.isin(*ACCEPTED), "review", "license_unknown_requires_review"),
            (old, "review", "license_version_requires_review"),
        ]
        if open_only:
            rules.append((~final.isin(*OPEN_ONLY), "rejected", "license_not_permissive_only"))
        ladder = F.when(F.lit(False), F.struct(F.lit("").alias("outcome"), F.lit("").alias("reason")))
        for holds, outcome, reason in rules:
            ladder = ladder.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason")))
        ladder = ladder.otherwise(F.struct(F.lit("accepted").alias("outcome"), F.lit("explicit_allowlist").alias("reason")))
        due = F.filter(
            F.concat(
                F.array(F.lit("preserve_source_citation_and_rights_evidence"), F.lit("check_asset_exceptions")),
                F.when(final.isin(*SHARED[1:]), F.array(F.lit("attribution"), F.lit("identify_changes"), F.lit("retain_license_link"))).otherwise(F.array().cast("array<string>")),
                F.array(F.when(F.contains(final, F.lit("-NC")), "noncommercial"), F.when(F.contains(final, F.lit("-SA")), "sharealike_under_source_version_rules"), F.when(final.isin(*SOFTWARE), "retain_full_license_and_copyright_notices")),
                F.array(F.when(final == "Apache-2.0", "identify_changes"), F.when(final == "Apache-2.0", "retain_applicable_NOTICE_and_attributions"), F.when(final == "BSD-3-Clause", "no_endorsement"), F.when(final.isin(*SHARED, "PDM") & version.isNull(), "resolve_version_before_release")),
            ),
            lambda x: x.isNotNull(),
        )
        return let(ladder, lambda r: F.struct(r["outcome"].alias("outcome"), r["reason"].alias("reason"), final.alias("code"), version.alias("version"), F.when(r["outcome"] == "accepted", lane(final, version)).alias("lane"), due.alias("obligations")))

    return let(F.struct(declared.alias("declared"), found.alias("found"), worldwide.alias("worldwide")), decide)


def without_data_waiver(text: Column) -> Column:
    """The text without its one sentence that waives rights in data only; null unless that sentence stands there exactly once and nothing else names the public domain."""
    waiver = r"(?i)\s*The Creative Commons Public Domain Dedication waiver\s*\(\s*(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?\s*\)\s*applies to the data made available in this article(?:,\s*unless otherwise stated(?:\s+in a credit line to the data)?)?\."
    rest = F.trim(F.regexp_replace(text, waiver, ""))
    return F.when((F.regexp_count(text, F.lit(waiver)) == 1) & ~rest.rlike(r"(?i)public domain|publicdomain|\bCC[\s-]*0\b|waiver"), rest)


def open_only_decision(code: Column, retracted: Column, open_access: Column, text: Column) -> Column:
    """decision() under the stricter rule; an article under CC BY alone is accepted if all that spoke against it is a waiver for its data."""
    strict = decision(code, retracted, open_access, text, open_only=True)
    bare = without_data_waiver(text)
    again = decision(code, retracted, open_access, bare, open_only=True)
    rescued = bare.isNotNull() & (strict["outcome"] != "accepted") & (again["outcome"] == "accepted") & (again["code"] == "CC BY") & (F.size(mentioned(bare)) > 0)
    return F.when(rescued, again.withField("reason", F.lit("article_cc_by_with_cc0_data_waiver"))).otherwise(strict)


def rechecked(outcome: Column, code: Column, text: Column, open_only: bool = False) -> Column:
    """Decides accepted articles again from their kept terms; others keep their outcome."""
    return F.when(outcome == "accepted", decision(code, F.lit("no"), F.lit("yes"), text, open_only)["outcome"]).otherwise(outcome)
