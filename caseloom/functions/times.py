"""Written dates, calendar values and ages, as column expressions of built-in functions. Calendar values are strings of their own precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names with their short forms, number words, units of age and life stages below their limits in years.
MONTHS = (("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"))
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
AGE_UNITS = {"year": 1.0, "years": 1.0, "yr": 1.0, "yrs": 1.0, "month": 1 / 12, "months": 1 / 12, "week": 7 / 365.25, "weeks": 7 / 365.25, "day": 1 / 365.25, "days": 1 / 365.25}
LIFE_STAGES = ((28 / 365.25, "neonate"), (1.0, "infant"), (13.0, "child"), (18.0, "adolescent"), (65.0, "adult"))

_MONTH = "(" + "|".join(n for names in MONTHS for n in names) + r")\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"


def valid_date(c: Column) -> Column:
    """Whether a text is a YYYY-MM-DD date of the calendar; false for null."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def _month_number(name: Column) -> Column:
    """'sep', 'September' -> '09'."""
    return F.lpad(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substr(F.lower(name), F.lit(1), F.lit(3))) + 2) / 3).cast("int").cast("string"), 2, "0")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){pattern}"), F.lit(0))


def written_dates(text: Column) -> Column:
    """Sorted distinct dates that a text writes in full: ISO, 'May 20, 2025' or '20th of May 2025'; impossible ones left out."""

    def iso(x: Column) -> Column:
        day, month, year = F.regexp_extract(x, r"(?i)(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\b(?!\d)", 1), F.regexp_extract(x, r"(?i)[a-z]{3,}", 0), F.regexp_extract(x, r"(\d{4})$", 1)
        month = F.when(F.lower(month).isin("of"), "").otherwise(month)
        return F.concat_ws("-", year, _month_number(month), F.lpad(day, 2, "0"))

    named = F.transform(F.concat(_found(text, rf"\b{_MONTH}\s+{_DAY},?\s+\d{{4}}\b"), F.transform(_found(text, rf"\b{_DAY}\s+(?:of\s+)?{_MONTH},?\s+\d{{4}}\b"), lambda x: F.regexp_replace(x, r"(?i)\s+of\s+", " "))), iso)
    return F.array_sort(F.array_distinct(F.filter(F.concat(_found(text, r"\b\d{4}-\d{2}-\d{2}\b"), named), valid_date)))


def calendar_values(text: Column) -> Column:
    """Sorted distinct values at the text's own precision: full dates, YYYY-MM of a month with a year or in ISO form, and YYYY of 1800-2099."""
    months = F.transform(_found(text, rf"\b{_MONTH},?\s+\d{{4}}\b"), lambda x: F.concat(F.regexp_extract(x, r"\d{4}$", 0), F.lit("-"), _month_number(F.regexp_extract(x, "(?i)[a-z]+", 0))))
    iso = F.filter(_found(text, r"(?<![\d-])\d{4}-\d{2}(?![\d-])"), lambda x: F.substring(x, 6, 2).between("01", "12"))
    years = _found(text, r"(?<![\d-])(?:1[89]\d{2}|20\d{2})(?![\d-])")
    return F.array_sort(F.array_distinct(F.concat(written_dates(text), months, iso, years)))


def date_error(date: Column, text: Column, quotes: Column | None = None) -> Column:
    """Why a date isn't derivable from a literal time text, or null: not_a_date, text_not_quoted (quotes: array), not_written."""
    quoted = F.lit(True) if quotes is None else (F.coalesce(text, F.lit("")) == "") | F.exists(quotes, lambda q: F.contains(q, text))
    return F.when(F.coalesce(date, F.lit("")) == "", None).when(~valid_date(date), "not_a_date").when(~quoted, "text_not_quoted").when(~F.array_contains(written_dates(text), date), "not_written")


def age_years(value: Column, unit: Column, text: Column) -> Column:
    """Age in years of a number with a unit, or of phrases such as '13 years 1 month', 'two weeks', 'newborn', 'day of life 3' or '40s'; else null."""
    u, t = F.lower(F.coalesce(unit, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    for n, word in enumerate(NUMBER_WORDS):
        t = F.regexp_replace(t, rf"\b{word}\b", str(n))
    factor = F.coalesce(*(F.when(u == k, F.lit(v)) for k, v in AGE_UNITS.items()), F.when(u == "", F.lit(1.0)))
    life = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"(\d+)(?:st|nd|rd|th)? day of life", r"day of life (\d+)", r"\bdol\s*(\d+)")))
    # of parts of one unit the last counts
    part = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(t, F.lit(rf"(\d+(?:\.\d+)?)\s*-?\s*{name}"), F.lit(1))), -1).cast("double")
    parts = [part(n) for n in ("year", "month", "week", "day")]
    summed = sum((F.coalesce(p, F.lit(0.0)) * w for p, w in zip(parts[1:], (1 / 12, 7 / 365.25, 1 / 365.25), strict=True)), F.coalesce(parts[0], F.lit(0.0)))
    decade = F.regexp_extract(t, r"\b(\d)0['’]?s\b", 1).try_cast("double")
    phrase = F.when(t.rlike(r"\b(neonate|newborn|at birth)\b"), F.lit(0.0)).when(life.isNotNull(), life.cast("double") / 365.25).when(F.coalesce(*parts).isNotNull(), summed).otherwise(decade * 10 + 5)
    return F.coalesce(value.cast("double") * factor, phrase)


def age_group(years: Column) -> Column:
    """One of seven life stages, unknown for null."""
    out = F.when(years.isNull(), "unknown")
    for limit, name in LIFE_STAGES:
        out = out.when(years < limit, name)
    return out.otherwise("older_adult")


def wait_seconds(value: Column, now: Column, fallback: float) -> Column:
    """Seconds to wait from a header that holds seconds or an HTTP date, between 0 and 120; else the fallback."""
    by_date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    return F.least(F.lit(120.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), by_date.cast("double"), F.lit(float(fallback)))))


def frame_times(duration: Column, every: float, most: int) -> Column:
    """Seconds 0, every, 2 * every, ... below a duration, the first `most` of them."""
    n = F.least(F.ceil(duration / every), F.lit(most)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * F.lit(float(every)))).otherwise(F.array().cast("array<double>"))
