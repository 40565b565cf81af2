"""Queries of scalar functions: every part gets one of a list of inputs by its key; the SQL side only knows the results, written by hand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.functions import identifiers as ID, licences as L, measurements as M, text as T, times as I
from caseloom.operators import checks as C, extraction as E, nested as N, scoring as S
from caseloom.sources.tables import table


@dataclass(frozen=True)
class Cases:
    """inputs: DDL of the input fields; outputs: names and expressions over them; rows: (inputs, results)."""

    inputs: str
    outputs: dict[str, Callable[[], Column]]
    rows: list[tuple[tuple, tuple]]

    def query(self, spark: SparkSession, folder: str) -> DataFrame:
        own = spark.createDataFrame([(k, *given) for k, (given, _) in enumerate(self.rows)], f"k bigint, {self.inputs}")
        parts = table(spark, folder, "part").select("p_partkey", F.pmod("p_partkey", F.lit(len(self.rows))).alias("k"))
        rows = parts.join(F.broadcast(own), "k")  # as many rows as there are cases
        return rows.select("p_partkey", *(e().alias(n) for n, e in self.outputs.items()))

    def sql(self) -> str:
        def literal(v: object) -> str:
            return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

        def cast(k: int) -> str:
            known = [r[k] for _, r in self.rows if r[k] is not None]
            kind = "varchar" if not known or isinstance(known[0], str) else "boolean" if isinstance(known[0], bool) else "bigint" if all(isinstance(x, int) for x in known) else "double"
            return kind

        names = [*self.outputs]
        rows = ", ".join(f"({k}, {', '.join(literal(x) for x in told)})" for k, (_, told) in enumerate(self.rows))
        cols = ", ".join(f"cast(v.c{k} AS {cast(k)}) AS {n}" for k, n in enumerate(names))
        return f"SELECT p_partkey, {cols} FROM part JOIN (VALUES {rows}) AS v(k, {', '.join(f'c{k}' for k in range(len(names)))}) ON p_partkey % {len(self.rows)} = v.k"


c = F.col
joined = lambda x: F.array_join(x, "|")
r9 = lambda x: F.round(x, 9)
strings = "array<struct<segment:string,quote:string>>"

CASES: dict[str, Cases] = {
    "text_keys": Cases(
        "x string",
        {"key": lambda: T.key(c("x")), "signs": lambda: T.signs(c("x")), "words": lambda: joined(T.words(c("x"))), "weighty": lambda: joined(T.words(c("x"), True)), "informative": lambda: T.informative(c("x")), "numbers": lambda: joined(T.numbers(c("x")).cast("array<string>"))},
        [
            (("The Heart rates",), ("the heart rates", "theheartrates", "the|heart|rate", "heart|rate", True, "")),
            (("  Blood-Pressure 120/80 mmHg ",), ("blood pressure 120 80 mmhg", "blood-pressure120/80mmhg", "blood|pressure|120|80|mmhg", "blood|pressure|120|80|mmhg", True, "120.0|80.0")),
            (("ﬁbrosis µg",), ("fibrosis ug", "fibrosisμg", "fibrosi|ug", "fibrosi|ug", True, "")),
            (("+++",), ("", "+++", "", "", True, "")),
            (("− 5",), ("5", "-5", "5", "5", True, "5.0")),
            (("Straße glass gas",), ("strasse glass gas", "strasseglassgas", "strasse|glass|gas", "strasse|glass|gas", True, "")),
            ((" Unknown ",), ("unknown", "unknown", "unknown", "unknown", False, "")),
            ((None,), ("", "", "", "", False, "")),
            (("",), ("", "", "", "", False, "")),
            (("not_documented",), ("not documented", "not_documented", "not|documented", "not|documented", False, "")),
            (("-1.5 to +2",), ("1 5 to 2", "-1.5to+2", "1|5|to|2", "1|5|2", True, "-1.5|2.0")),
        ],
    ),
    "label_similarity": Cases(
        "a string, b string",
        {"similarity": lambda: r9(T.similarity(c("a"), c("b"))), "dice": lambda: r9(T.text_dice(c("a"), c("b"))), "agree": lambda: T.texts_agree(c("a"), c("b"))},
        [
            (("Heart rates", "heart rate"), (1.0, 1.0, True)),
            (("The heart", "heart"), (1.0, round(2 / 3, 9), True)),
            (("+++", "+++"), (1.0, 0.0, True)),
            (("+++", "++"), (0.0, 0.0, False)),
            ((None, None), (0.0, 0.0, False)),
            (("−", "-"), (1.0, 0.0, True)),
            (("abcd", "bcde"), (0.75, 0.0, True)),
            (("dose 5", "dose 6"), (round(10 / 12, 9), 0.5, False)),
            (("renal failure", "failure"), (0.75, round(2 / 3, 9), True)),
            (("alpha", "zzzzzz"), (0.0, 0.0, False)),
        ],
    ),
    "evidence_overlap": Cases(
        f"a {strings}, b {strings}",
        {"overlap": lambda: r9(T.span_overlap(T.spans(c("a")), T.spans(c("b")))), "jaccard": lambda: r9(T.span_overlap(T.spans(c("a")), T.spans(c("b")), True))},
        [
            (([("s1", "fever and cough")], [("s1", "Fever and cough.")]), (1.0, 1.0)),
            (([("s1", "fever and dry cough")], [("s1", "cough and fever")]), (1.0, 0.75)),
            (([("s1", "fever and dry cough")], [("s2", "cough and fever")]), (0.9, 0.675)),
            (([("s1", "dry cough")], [(None, "a cough")]), (0.25, round(0.5 / 3, 9))),
            (([("s1", "fever")], [("s1", "rash")]), (0.0, 0.0)),
            (([], [("s1", "rash")]), (0.0, 0.0)),
            ((None, [("s1", "")]), (0.0, 0.0)),
            (([("s1", "rash"), ("s1", "severe knee pain")], [("s1", "knee pain was severe today")]), (1.0, 0.6)),
        ],
    ),
    "unit_and_figure_keys": Cases(
        "unit string, figure string, panel string",
        {"unit_key": lambda: T.unit(c("unit")), "figure_key": lambda: T.figure_key(c("figure")), "panel_key": lambda: T.panel_key(c("panel"))},
        [
            (("mcg per Liter", "Figure 2A", "(A)"), ("ug/l", "fig2a", "a")),
            (("µmol / L", "fig. 10", None), ("umol/l", "fig10", "_whole")),
            (("10^9", "F3", "Panel b"), ("109", "fig3", "b")),
            (("yrs", "Graph 1", "Top-left inset"), ("year", "graph1", "upper left inset")),
            (("unknown", "", "whole figure"), (None, "", "_whole")),
            ((None, None, "main image"), (None, "", "main")),
            (("mm×mm", "FIGURE-7", "2c"), ("mmxmm", "fig7", "c")),
            (("years", "figs 4", "bottom view"), ("year", "figs4", "lower")),
        ],
    ),
    "column_names": Cases(
        "ref string, i bigint, name string",
        {"column_index": lambda: T.column_index(c("ref")), "letters": lambda: T.column_letters(c("i")), "extension": lambda: T.extension(c("name"))},
        [(("A1", 0, "a/b/Table S1.XLSX"), (0, "A", ".xlsx")), (("Z9", 25, "archive.tar.gz"), (25, "Z", ".gz")), (("AB12", 27, "README"), (27, "AB", "")), (("ZZ1", 701, ".hidden"), (701, "ZZ", "")), (("AAA3", 702, None), (702, "AAA", "")), (("17", -1, "a.b/c"), (None, None, "")), (("xfd2", 16383, "x.y.Z"), (16383, "XFD", ".z"))],
    ),
    "word_forms": Cases(
        "w string, short string, label string",
        {"american": lambda: T.british_to_american(c("w")), "stems": lambda: joined(T.inflection_stems(c("w"))), "initials": lambda: T.initials_match(c("short"), c("label"))},
        [(("anaemia", "CKD", "chronic kidney disease"), ("anemia", "", True)), (("haemorrhages", "CKD", "chronic renal disease"), ("hemorrhages", "haemorrhage|haemorrhag", False)), (("colour", "AKI", "acute-kidney injury"), ("color", "", True)), (("oesophageal", "X", "y"), ("esophageal", "", False)), (("studies", "MRI", "magnetic resonance imaging"), ("studies", "studie|studi|study", True)), (("admitted", "US", "ultrasound"), ("admitted", "admitt|admitte", False)), (("walking", "a", "Alpha"), ("walking", "walk|walke", True))],
    ),
    "sentence_parts": Cases(
        "x string",
        {"sentences": lambda: joined(T.sentences(c("x"))), "abbreviations": lambda: joined(F.transform(T.abbreviations(c("x")), lambda e: F.concat(e["short"], F.lit("="), e["long"]))), "unquoted": lambda: T.without_quoted(c("x")), "asks": lambda: C.question_outside_quotes(c("x"))},
        [
            (("He came on day 3. She left. (All well.)",), ("He came on day 3.|She left.|(All well.)", "", "He came on day 3. She left. (All well.)", False)),
            (("See Fig. 2 for Dr. Smith vs. Jones.",), ("See Fig. 2 for Dr. Smith vs. Jones.", "", "See Fig. 2 for Dr. Smith vs. Jones.", False)),
            (("with chronic kidney disease (CKD) and a mass (XYZ)",), ("with chronic kidney disease (CKD) and a mass (XYZ)", "CKD=chronic kidney disease", "with chronic kidney disease (CKD) and a mass (XYZ)", False)),
            (('Labelled "why?" here',), ('Labelled "why?" here', "", "Labelled  here", False)),
            (("Is it so?",), ("Is it so?", "", "Is it so?", True)),
            ((None,), ("", "", None, False)),
        ],
    ),
    "literal_places": Cases(
        "x string, part string",
        {"places": lambda: joined(T.all_places(c("x"), c("part")).cast("array<string>")), "literal": lambda: T.literal_span(c("x"), c("part"))},
        [(("banana", "ana"), ("1|3", "ana")), (("Beta-blocker therapy", "beta blocker"), ("", "Beta-blocker")), (("aaa", "a"), ("0|1|2", "a")), (("abc", "x"), ("", None)), (("abc", ""), ("", None)), ((None, "a"), ("", None)), (("white  blood cell", "Whiteblood"), ("", "white  blood"))],
    ),
    "markup_text": Cases(
        "x string",
        {"plain": lambda: T.without_markup(c("x"))},
        [(("<p>Fish &amp; <b>chips</b></p>",), ("Fish & chips",)), (("a&lt;b",), ("a<b",)), (("  x\n<br/> y ",), ("x y",)), (("plain",), ("plain",)), ((None,), (None,))],
    ),
    "written_dates": Cases(
        "x string, iso string",
        {"dates": lambda: joined(I.written_dates(c("x"))), "calendar": lambda: joined(I.calendar_values(c("x"))), "valid": lambda: I.valid_date(c("iso")), "error": lambda: I.date_error(c("iso"), c("x"))},
        [
            (("seen on May 20, 2025 and 2025-06-01", "2025-05-20"), ("2025-05-20|2025-06-01", "2025|2025-05-20|2025-06-01", True, None)),
            (("the 3rd of Sept 2021", "2021-09-03"), ("2021-09-03", "2021|2021-09|2021-09-03", True, None)),
            (("February 30, 2020", "2020-02-30"), ("", "2020", False, "not_a_date")),
            (("October 2022", "2022-10-01"), ("", "2022|2022-10", True, "not_written")),
            (("in 1999 or 2022-13 or 2022-11", None), ("", "1999|2022-11", False, None)),
            (("5 jan. 2020; 5 Jan 2020", "2020-1-5"), ("2020-01-05", "2020|2020-01|2020-01-05", False, "not_a_date")),
            (("03/04/2020", "2020-04-03"), ("", "2020", True, "not_written")),
            ((None, ""), ("", "", False, None)),
        ],
    ),
    "ages": Cases(
        "n double, u string, t string",
        {"years": lambda: r9(I.age_years(c("n"), c("u"), c("t"))), "stage": lambda: I.age_group(I.age_years(c("n"), c("u"), c("t")))},
        [
            ((45.0, "years", None), (45.0, "adult")), ((18.0, "months", None), (1.5, "child")), ((None, None, "13 years 1 month"), (round(13 + 1 / 12, 9), "adolescent")), ((None, None, "two weeks"), (round(14 / 365.25, 9), "neonate")),
            ((None, None, "newborn girl"), (0.0, "neonate")), ((None, None, "day of life 30"), (round(30 / 365.25, 9), "infant")), ((None, None, "in her 40s"), (45.0, "adult")), ((None, None, "a 70-year-old man"), (70.0, "older_adult")), ((None, None, "elderly"), (None, "unknown")), ((3.0, "fortnights", "old"), (None, "unknown")), ((17.99, None, None), (17.99, "adolescent")),
        ],
    ),
    "measured_cells": Cases(
        "x string",
        {n: (lambda n=n: M.parsed_measurement(c("x"))[n]) for n in ("comparator", "mantissa", "power_of_ten", "magnitude", "unit", "notation")} | {"status": lambda: M.parsed_cell(c("x"))["status"], "markers": lambda: joined(M.parsed_cell(c("x"))["markers"]), "explicit": lambda: M.explicit_notation(c("x"))},
        [
            (("12 mg/dl",), ("=", "12", 0, "12", "mg/dl", "decimal", "parsed", "", "12 mg/dl")),
            (("≥ 1,250.50",), (">=", "1250.50", 0, "1250.50", None, "decimal", "parsed", "", "≥ 1,250.50")),
            (("3.2 × 10⁹/L",), ("=", "3.2", 9, "3200000000.0", "/L", "scientific", "parsed", "", "3.2 × 10^(9)/L")),
            (("5e-3 umol/l/hr",), ("=", "5", -3, "0.005", "µmol/L/h", "scientific", "parsed", "", "5e-3 umol/l/hr")),
            (("<.5",), ("<", "0.5", 0, "0.5", None, "decimal", "parsed", "", "<.5")),
            (("10-20",), (None, None, None, None, None, None, "unparseable", "", "10-20")),
            (("3 x 4 cm",), (None, None, None, None, None, None, "unparseable", "", "3 x 4 cm")),
            (("1,2,3",), (None, None, None, None, None, None, "unparseable", "", "1,2,3")),
            (("7.4*",), (None, None, None, None, None, None, "parsed", "*", "7.4*")),
            (("12^(a,b)",), (None, None, None, None, None, None, "parsed", "a|b", "12^(a,b)")),
            (("n/a",), (None, None, None, None, None, None, "missing_cell", "", "n/a")),
            (("5 IM × 3",), (None, None, None, None, None, None, "parsed", "", "5 IM × 3")),
            (("−4 %",), ("=", "-4", 0, "-4", "%", "decimal", "parsed", "", "−4 %")),
            (("1e40",), (None, None, None, None, None, None, "unparseable", "", "1e40")),
        ],
    ),
    "dose_cells": Cases(
        "x string",
        {"doses": lambda: joined(F.transform(M.parsed_dose(c("x"))["components"], lambda p: F.concat_ws(" ", p["magnitude"], p["unit"], p["route"]))), "times": lambda: M.parsed_dose(c("x"))["multiplicity"]},
        [(("5 IM",), ("5 IM", None)), (("10 mg PO",), ("10 mg PO", None)), (("5 IM × 3",), ("5 IM", 3)), (("5 IM + 2.5 mgPO",), ("5 IM|2.5 mg PO", None)), (("5 XX",), (None, None)), (("tablet",), (None, None))],
    ),
    "identifiers": Cases(
        "x string",
        {"pmid": lambda: ID.pmid(c("x")), "pmcid": lambda: ID.pmcid(c("x")), "doi": lambda: ID.doi(c("x")), "of_pmid": lambda: ID.from_address(c("x"))["pmid"], "of_pmcid": lambda: ID.from_address(c("x"))["pmcid"], "of_doi": lambda: ID.from_address(c("x"))["doi"], "kind": lambda: ID.source_kind(c("x")), "flag": lambda: ID.flag(c("x"))},
        [
            (("00123",), ("123", None, None, None, None, None, "unknown", None)),
            (("PMC0123",), (None, None, None, None, None, None, "unknown", None)),
            (("pmc12.2",), (None, "PMC12", None, None, None, None, "unknown", None)),
            (("doi: 10.1000/Ab c",), (None, None, None, None, None, None, "unknown", None)),
            (("doi:10.1000/Ab",), (None, None, "10.1000/Ab", None, None, None, "unknown", None)),
            (("https://doi.org/10.1000/a%2Fb",), (None, None, "10.1000/a/b", None, None, "10.1000/a/b", "unknown", None)),
            (("https://pubmed.ncbi.nlm.nih.gov/77/",), (None, None, None, "77", None, None, "unknown", None)),
            (("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9.1/",), (None, None, None, None, "PMC9", None, "unknown", None)),
            (("https://u:p@doi.org/10.1000/x",), (None, None, None, None, None, None, "unknown", None)),
            (("pmc-1-2",), (None, None, None, None, None, None, "published_case_summary", None)),
            (("TREC-CDS-2016-3",), (None, None, None, None, None, None, "ehr_summary", None)),
            (("Yes",), (None, None, None, None, None, None, "unknown", True)),
            (("0",), (None, None, None, None, None, None, "unknown", False)),
        ],
    ),
    "identifier_claims": Cases(
        "pmid string, pmcid string, doi string, more string",
        {"pubmed_url": lambda: ID.addresses(c("pmid"), c("pmcid"), c("doi"))["pubmed_url"], "doi_url": lambda: ID.addresses(c("pmid"), c("pmcid"), c("doi"))["doi_url"], "value": lambda: ID.added_claim(c("pmid"), c("more"))["value"], "conflict": lambda: joined(ID.added_claim(c("pmid"), c("more"))["conflict"]), "one": lambda: ID.merged_claims([{"pmid": c("pmid")}, {"pmid": c("more")}])["pmid"], "clashes": lambda: joined(F.transform(ID.merged_claims([{"pmid": c("pmid")}, {"pmid": c("more")}])["conflicts"], lambda x: x["key"]))},
        [
            (("1", None, "10.1/a b", "1"), ("https://pubmed.ncbi.nlm.nih.gov/1/", "https://doi.org/10.1/a+b", "1", None, "1", "")),
            (("1", "PMC2", None, "3"), ("https://pubmed.ncbi.nlm.nih.gov/1/", None, "1", "1|3", None, "pmid")),
            ((None, None, "10.1/(x);y", "3"), (None, "https://doi.org/10.1/(x);y", "3", None, "3", "")),
            ((None, None, None, None), (None, None, None, None, None, "")),
        ],
    ),
    "licence_names": Cases(
        "x string",
        {"code": lambda: L.identity(c("x"))["code"], "version": lambda: L.identity(c("x"))["version"], "place": lambda: L.identity(c("x"))["jurisdiction"], "named": lambda: joined(F.transform(L.mentioned(c("x")), lambda i: i["code"])), "lane": lambda: F.when(L.normalized(c("x")).isNotNull(), L.lane(L.normalized(c("x")), L.identity(c("x"))["version"]))},
        [
            (("CC BY 4.0",), ("CC BY", "4.0", None, "CC BY", "noncommercial_compatible")),
            (("cc-by-nc-sa-3.0",), ("CC BY-NC-SA", "3.0", None, "CC BY-NC-SA", "noncommercial_compatible")),
            (("Creative Commons Attribution-NonCommercial-NoDerivatives License 4.0 International",), ("CC BY-NC-ND", "4.0", None, "CC BY-NC-ND", "noncommercial_compatible")),
            (("https://creativecommons.org/licenses/by-sa/3.0/de/legalcode",), ("CC BY-SA", "3.0", "de", "CC BY-SA", "sharealike_source_terms")),
            (("http://www.creativecommons.org/publicdomain/zero/1.0/",), ("CC0", "1.0", None, "CC0", "noncommercial_compatible")),
            (("https://spdx.org/licenses/MIT.html",), ("MIT", None, None, "MIT", "permissive_source_terms")),
            (("Apache License, Version 2.0",), ("Apache-2.0", "2.0", None, "Apache-2.0", "permissive_source_terms")),
            (("public domain mark 1.0",), ("PDM", "1.0", None, "PDM", "public_domain_mark")),
            (("All rights reserved",), (None, None, None, "", None)),
            (("Open access under the CC BY 4.0 license (https://creativecommons.org/licenses/by/4.0/).",), (None, None, None, "CC BY|CC BY", None)),
            (("https://evil@creativecommons.org/licenses/by/4.0/",), (None, None, None, "", None)),
            ((None,), (None, None, None, "", None)),
        ],
    ),
    "licence_decisions": Cases(
        "code string, retracted string, open string, text string",
        {"outcome": lambda: L.decision(c("code"), c("retracted"), c("open"), c("text"))["outcome"], "reason": lambda: L.decision(c("code"), c("retracted"), c("open"), c("text"))["reason"], "obligations": lambda: joined(L.decision(c("code"), c("retracted"), c("open"), c("text"))["obligations"]), "strict": lambda: L.open_only_decision(c("code"), c("retracted"), c("open"), c("text"))["reason"], "again": lambda: L.rechecked(L.decision(c("code"), c("retracted"), c("open"), c("text"))["outcome"], c("code"), c("text"))},
        [
            (("CC BY 4.0", "no", "yes", ""), ("accepted", "explicit_allowlist", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link", "explicit_allowlist", "accepted")),
            (("CC BY", "yes", "yes", ""), ("rejected", "retracted_or_retraction_status_unknown", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link|resolve_version_before_release", "retracted_or_retraction_status_unknown", "rejected")),
            (("CC BY", None, "yes", ""), ("rejected", "retracted_or_retraction_status_unknown", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link|resolve_version_before_release", "retracted_or_retraction_status_unknown", "rejected")),
            (("CC BY", "no", "no", ""), ("rejected", "not_verified_open_access", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link|resolve_version_before_release", "not_verified_open_access", "rejected")),
            (("CC BY-NC 4.0", "no", "yes", "This article is under CC BY 4.0."), ("review", "conflicting_license_statements", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link|noncommercial", "conflicting_license_statements", "review")),
            (("CC BY-ND 4.0", "no", "yes", ""), ("rejected", "license_disallows_adaptations", "preserve_source_citation_and_rights_evidence|check_asset_exceptions", "license_disallows_adaptations", "rejected")),
            (("TDM only", "no", "yes", ""), ("review", "unrecognized_metadata_terms_require_review", "preserve_source_citation_and_rights_evidence|check_asset_exceptions", "unrecognized_metadata_terms_require_review", "review")),
            ((None, "no", "yes", ""), ("review", "license_unknown_requires_review", "preserve_source_citation_and_rights_evidence|check_asset_exceptions", "license_unknown_requires_review", "review")),
            (("CC BY 9.9", "no", "yes", ""), ("review", "license_version_requires_review", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link", "license_version_requires_review", "review")),
            (("CC BY-NC 4.0", "0", "1", ""), ("accepted", "explicit_allowlist", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link|noncommercial", "license_not_permissive_only", "accepted")),
            (("CC BY 4.0", "no", "yes", "All rights reserved."), ("review", "restrictive_license_prose_requires_review", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link", "restrictive_license_prose_requires_review", "review")),
            (("CC BY 4.0", "no", "yes", "This article is licensed under CC BY 4.0. The Creative Commons Public Domain Dedication waiver (http://creativecommons.org/publicdomain/zero/1.0/) applies to the data made available in this article."), ("review", "conflicting_license_statements", "preserve_source_citation_and_rights_evidence|check_asset_exceptions|attribution|identify_changes|retain_license_link", "article_cc_by_with_cc0_data_waiver", "review")),
        ],
    ),
    "value_agreement": Cases(
        "rn double, rt string, pn double, pt string, t1 string, d1 string, t2 string, d2 string, cmp string",
        {"value": lambda: S.value_correct(c("rn"), c("rt"), c("pn"), c("pt")), "time": lambda: S.time_correct(c("t1"), c("d1"), c("t2"), c("d2")), "comparator": lambda: S.comparator(c("cmp"), c("rn")), "same": lambda: T.num_equal(c("rn"), c("pn"))},
        [
            ((5.0, None, 5.0000001, None, "day 3", None, "day 3", None, None), (True, True, "=", True)),
            ((5.0, None, None, "about 5 mg", "day 3", None, "day 4", None, "<"), (True, False, "<", False)),
            ((None, "high", None, "High", None, "2020-01-01", "x", "2020-01-01", None), (True, True, None, False)),
            ((None, "grade 2", 2.0, None, None, None, None, None, "unknown"), (True, None, None, False)),
            ((None, None, None, None, "unknown", None, "", None, None), (None, None, None, False)),
            ((None, None, 3.0, None, None, None, "today", None, None), (False, False, None, False)),
        ],
    ),
    "edge_spellings": Cases(
        "a string, b string, relation string",
        {"x": lambda: S.edge(c("a"), c("b"), c("relation"))["a"], "y": lambda: S.edge(c("a"), c("b"), c("relation"))["b"], "kind": lambda: S.edge(c("a"), c("b"), c("relation"))["relation"]},
        [(("e1", "e2", "after"), ("e2", "e1", "before")), (("e1", "e2", "Before"), ("e1", "e2", "before")), (("e9", "e2", "same time"), ("e2", "e9", "same_time")), (("e2", "e1", "overlaps"), ("e1", "e2", "overlaps")), (("e2", "e1", "during"), ("e2", "e1", "during"))],
    ),
    "fact_rules": Cases(
        "assertion string, verification string, n double, text string, reason string, unit string, age double, scope string, category string, status string, n_facts int",
        {"broken": lambda: joined(C.broken(C.fact_rules(c("assertion"), c("verification"), c("n"), c("text"), c("reason"), c("unit"), c("age"), c("scope"), c("category")) | C.documentation_rules(c("status"), c("n_facts"))))},
        [
            (("present", "confirmed", 1.0, None, None, None, None, None, None, "documented", 2), ("",)),
            (("present", "refuted", 1.0, None, "unknown", None, None, None, None, "documented", 1), ("refuted_but_not_absent",)),
            (("present", None, 1.0, None, "not_performed", None, None, None, None, "documented", 0), ("value_and_absent_reason|documented_without_facts",)),
            (("present", None, None, "", None, None, -1.0, None, None, "not_documented", 3), ("neither_value_nor_absent_reason|negative_age|unknown_age_unit|facts_without_documentation",)),
            (("present", None, None, "x", None, "years", 5.0, "class", None, "documented", 1), ("scope_without_category",)),
        ],
    ),
    "label_rules": Cases(
        "label string, title string, outcome string, assertion string, state string, reviewer string",
        {"label": lambda: C.label_error(c("label"), c("title")), "panel": lambda: C.panel_label_issue(c("label")), "death": lambda: C.death_conflict(c("outcome"), c("assertion"), c("state")), "stand_in": lambda: C.placeholder_name(c("reviewer"))},
        [
            (("A rare case of X", "A rare case of X.", "death", "present", "alive", "TODO"), ("label_repeats_title", None, True, True)),
            (("upper left panel", "T", "death", "absent", "deceased", "Ann Lee"), (None, "positional", True, False)),
            (("Patient 2", "T", "death", "present", "deceased", None), (None, "patient_name", False, True)),
            (("a very long label of more than thirty letters", "On a very long label of more than thirty letters today", None, None, None, "agent"), ("label_repeats_title", None, False, True)),
            (("case", "A case of fever", "cure", "present", "alive", "<name>"), (None, None, False, True)),
        ],
    ),
    "time_rules": Cases(
        "time string, quotes array<string>, labels array<string>, value string, errors array<string>",
        {"borrowed": lambda: C.borrowed_time(c("time"), c("quotes"), c("labels")), "bounded": lambda: C.upper_bound_printed(c("value"), c("quotes")), "only_times": lambda: C.time_only(c("errors")), "other_sentence": lambda: C.time_in_other_sentence(c("time"), F.get("quotes", F.lit(0)), c("labels"))},
        [
            (("day 3", ["Fever rose to 39.", "On day 3 nothing else."], ["fever"], "39", ["bad date"]), (True, False, True, False)),
            (("day 3", ["Fever rose on day 3 to 39."], ["fever"], "39", []), (False, False, False, False)),
            (("day 3", ["A fever came. It was below 39 on day 3."], ["fever"], "39", ["time", "name"]), (False, True, False, True)),
            ((None, ["less than 5 and 5"], ["x"], "5", ["time"]), (False, False, True, False)),
        ],
    ),
    "rewriting_rules": Cases(
        "time string, quotes array<string>, comparator string, value double, assertion string, verification string, flag string, text string, status string, reason string, anchor string, relation string",
        {
            "time_kept": lambda: N.without_unwritten_time(c("time"), c("time"), c("quotes"))["time"], "time_audit": lambda: N.without_unwritten_time(c("time"), c("time"), c("quotes"))["audit"],
            "quotes_kept": lambda: joined(N.quarantined_time(c("time"), c("quotes"))["quotes"]), "comparator": lambda: N.settled_comparator(c("comparator"), c("value"), c("quotes"))["comparator"],
            "verification": lambda: N.settled_absence(c("assertion"), c("verification"), c("quotes"))["verification"], "absence_review": lambda: N.settled_absence(c("assertion"), c("verification"), c("quotes"))["review"],
            "flag": lambda: N.settled_flag(c("flag"), c("text")), "use": lambda: N.settled_use(c("status"), c("assertion"), c("quotes"))["assertion"], "use_review": lambda: N.settled_use(c("status"), c("assertion"), c("quotes"))["review"],
            "performed": lambda: N.settled_performance(c("assertion"), c("reason")), "anchor": lambda: N.settled_anchor(c("anchor"), c("relation"), F.array_join("quotes", " "))["anchor"], "relation": lambda: N.settled_anchor(c("anchor"), c("relation"), F.array_join("quotes", " "))["relation"],
            "occurrence": lambda: N.mapped(c("status"), {"done": "occurred", "planned": "future"}),
        },
        [
            (("day 3", ["pain on day 3", "day 3"], "unknown", 5.0, "absent", "confirmed", None, "Normal study", "never", None, "Surgery", "after"), ("day 3", None, "pain on day 3", "=", "confirmed", "absent_but_confirmed", "normal", "absent", "never_without_cue", "absent", None, "unknown", "never")),
            (("day 4", ["tumour was ruled out after surgery"], "<", 5.0, "absent", "provisional", "high", "normal", "done", "not_performed", "Surgery", "after"), (None, "time_not_in_quotes", "tumour was ruled out after surgery", "<", "refuted", None, "high", "absent", None, "unknown", "Surgery", "after", "occurred")),
            ((None, ["never smoked, no history of asthma"], None, None, "absent", "differential", None, "mass", "never", None, None, "before"), (None, None, "never smoked, no history of asthma", None, "unknown", None, None, "present", None, "absent", None, "unknown", "never")),
        ],
    ),
    "file_types": Cases(
        "head binary, name string",
        {"type": lambda: ID.content_type(c("head"), c("name")), "width": lambda: ID.image_size(c("head"))["width"], "height": lambda: ID.image_size(c("head"))["height"], "class_": lambda: ID.media_class(c("name"))},
        [
            ((b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x00\x00\x00\x00\x40\x08\x02", "a.jpg"), ("png", 256, 64, "image")),
            ((b"GIF89a\x10\x00\x20\x00", "b.gif"), ("gif", 16, 32, "image")),
            ((b"%PDF-1.7", "c"), ("pdf", None, None, "other")),
            ((b"PK\x03\x04....", "t.XLSX"), ("xlsx", None, None, "table")),
            ((b"PK\x03\x04....", "t.zip"), ("zip", None, None, "other")),
            ((b"hello", "notes.txt"), ("txt", None, None, "document")),
            ((None, "noname"), (None, None, None, "other")),
        ],
    ),
    "json_differences": Cases(
        "a string, b string, p string",
        {"changed": lambda: joined(F.transform(N.changes(c("a"), c("b")), lambda x: x["pointer"])), "lost": lambda: joined(N.lost(c("a"), c("b"))), "guarded": lambda: joined(N.protected_changes(c("a"), c("b"), F.array(c("p")))), "at": lambda: N.pointed(c("a"), "/x/0"), "scrubbed": lambda: N.scrubbed(c("a"))},
        [
            (('{"x": [1, 2], "y": "a"}', '{"x": [1, 3], "y": "a"}', "/x"), ("/x/1", "", "", "1", '{"x":[1,2],"y":"a"}')),
            (('{"x": [1, 2], "y": "/tmp/q"}', '{"x": [1]}', "/x"), ("/x/1|/y", "/x/1|/y", "/y", "1", '{"x":[1,2]}')),
            (('{"b": null}', '{"b": 1}', "/c"), ("/b", "", "/b", None, '{"b":null}')),
            (("not json", "{}", "/c"), ("", "", "", None, None)),
        ],
    ),
    "model_outputs": Cases(
        "x string",
        {"value": lambda: E.model_output(c("x"))["value"], "method": lambda: E.model_output(c("x"))["method"], "error": lambda: E.model_output(c("x"))["error"], "coded": lambda: E.contains_coding(E.model_output(c("x"))["value"], F.lit('{"c":1}'))},
        [
            (('{"b": 1, "a": 2}',), ('{"a":2,"b":1}', "json", None, False)),
            (("Here it is: ```json\n{\"a\": {\"coding\": {\"c\": 1}}}\n``` done",), ('{"a":{"coding":{"c":1}}}', "embedded_json", None, True)),
            (("{'a': True}",), ('{"a":true}', "literal_object", None, False)),
            (('first {"a": 1} then {"a": 2}',), (None, None, "ambiguous", False)),
            (('twice {"a": 1} and {"a": 1}',), ('{"a":1}', "embedded_json", None, False)),
            (("[1, 2]",), (None, None, "not_an_object", False)),
            (('{"a": 1, "a": 2}',), (None, None, "repeated_key_or_number", False)),
            (("no object {",), (None, None, "no_object", False)),
            ((None,), (None, None, "missing", False)),
        ],
    ),
    "cells_and_items": Cases(
        "raw string, n double, x string, cmp string, unit string, legend string, status string",
        {"holds": lambda: E.cell_matches(c("raw"), c("n"), c("x"), c("cmp"), c("unit"))["holds"], "reason": lambda: E.cell_matches(c("raw"), c("n"), c("x"), c("cmp"), c("unit"))["reason"], "legend_error": lambda: E.legend_error(c("status"), c("raw"), c("legend"), "not done|missing")},
        [
            (("130 mmol/L", 130.0, None, "=", "mmol/L", None, None), (True, "scalar_result_corresponds_without_unit_conversion", None)),
            (("130", 130.0, "130", "=", "mmol/L", None, "missing"), (True, "scalar_result_corresponds_without_unit_conversion", "no_legend")),
            (("130 mmol/L", 131.0, None, "=", "mmol/L", None, None), (False, "cell_and_numeric_value_comparator_or_unit_disagree", None)),
            (("<5", 5.0, None, "=", None, None, None), (False, "cell_and_observation_comparator_disagree", None)),
            (("5 mg", 5.0, None, "=", "g", None, None), (False, "cell_and_observation_unit_disagree", None)),
            (("-", None, "-", None, None, "- not done", "not_done"), (False, "missing_cell_has_no_extractable_result_value", None)),
            (("positive", None, "positive", None, None, "positive: seen", "not_done"), (True, "exact_literal_nonscalar_result", "status_not_stated")),
            (("ND*", None, "ND*", None, None, "* not done", "not_done"), (False, "missing_cell_has_no_extractable_result_value", None)),
            (("12", None, None, "=", None, None, None), (False, "cell_value_not_represented_in_observation", None)),
        ],
    ),
    "panel_defaults": Cases(
        "kind string, modalities array<string>, charts array<struct<type:string,scope:string,clinical:boolean>>, owners array<string>, scopes array<string>, texts array<string>, description string",
        {"category": lambda: E.panel_default(c("kind"), c("modalities"), c("charts"), c("owners"), c("scopes"))["category"], "includable": lambda: E.panel_default(c("kind"), c("modalities"), c("charts"), c("owners"), c("scopes"))["includable"], "rule": lambda: E.panel_default(c("kind"), c("modalities"), c("charts"), c("owners"), c("scopes"))["rule"], "burned": lambda: E.privacy_hints(c("texts"), c("kind") == "clinical_photograph")["burned_in"], "face": lambda: E.privacy_hints(c("texts"), c("kind") == "clinical_photograph")["face"], "class_": lambda: E.suggested_class(c("kind"), c("description"))},
        [
            (("medical_imaging", ["ct"], [], ["p1"], ["individual"], ["A timestamp overlay is seen."], "CARE checklist"), ("clinical_imaging", True, "medical_imaging", "timestamps_or_device_text", False, "non_clinical")),
            (("microscopy", [], [], [], ["aggregate"], ["No patient name."], None), ("pathology", False, "microscopy+not_attributed_to_local_patient", "none", False, "unknown")),
            (("clinical_photograph", [], [], ["p1"], ["shared"], ["The face is shown.", "patient name visible"], ""), ("clinical_photo", True, "clinical_photograph", "direct_identifiers", True, "unknown")),
            (("graph", [], [("line", "individual", True)], ["p1"], ["individual"], [], ""), ("clinical_chart_of_patient_data", True, "graph_of_attributed_patient_data", "none", False, "unknown")),
            (("graph", [], [("bar", "aggregate", False)], ["p1"], ["individual"], [], ""), ("literature_or_aggregate", False, "graph_aggregate_or_unattributed", "none", False, "unknown")),
            (("graph", [], [("waveform", "individual", None)], [], [], [], ""), ("waveform", False, "waveform_chart+not_attributed_to_local_patient", "none", False, "unknown")),
            (("diagram", [], [], [], [], [], ""), ("diagram_or_schematic", False, "diagram", "none", False, "unknown")),
            (("mp4", [], [], [], [], [], "Video 1"), ("other", False, "image_kind_mp4", "none", False, "video")),
        ],
    ),
    "offsets_and_precision": Cases(
        "low double, high double, unit string, exact string, day string, age string, quotes array<string>, n double",
        {"error": lambda: E.offset_error(c("low"), c("high"), c("unit"), c("exact")), "seconds": lambda: E.offset_seconds(c("low"), c("unit")), "precision": lambda: E.calendar_precision(c("day")), "age_text": lambda: E.age_text(c("age"), c("quotes")), "mentions": lambda: E.own_mention(c("n"), c("quotes"))},
        [
            ((1.0, 2.0, "day", "bounded", "2020-02-29", None, ["A 13-year-old boy of 13"], 13.0), (None, 86400.0, "day", "13-year-old", 2)),
            ((2.0, 1.0, "week", "bounded", "2021-02-29", "12", ["x"], 5.0), ("reversed", 1209600.0, None, "12", 0)),
            ((1.0, 2.0, "month", "exact", "2020-13", None, ["aged 70 years, 70 kg"], 70.0), ("unequal_exact", None, None, "aged 70 years", 2)),
            ((None, None, "day", None, "2020-12", "unknown", [], 1.0), ("unbounded", None, "month", None, 0)),
            ((3.0, 3.0, "moons", "exact", "2020", None, ["3 and 3.0"], 3.0), ("unknown_unit", None, "year", None, 2)),
        ],
    ),
    "markup_fields": Cases(
        "x string",
        {"journal": lambda: E.markup_fields(c("x"))["journal"], "keywords": lambda: joined(E.markup_fields(c("x"))["keywords"]), "affiliations": lambda: joined(E.markup_fields(c("x"))["affiliations"])},
        [
            (("<journal-title>J <i>of</i> X</journal-title><kwd>a</kwd><kwd>b c</kwd><aff id='1'><label>1</label> Uni</aff>",), ("J of X", "a|b c", "1 Uni")),
            (("<p>none</p>",), (None, "", "")),
            ((None,), (None, "", "")),
        ],
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case.query for name, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql() for name, case in CASES.items()}
