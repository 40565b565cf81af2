"""Scalar measurements from text, in built-in functions: comparator, mantissa, power of ten, exact magnitude and unit.

A text is read from the left: a comparator, a decimal number, a power of ten and a unit are taken off its front, one after the
other; if anything is left over or a part is malformed (ranges, dimensions, ratios, exponents that lost their mark), all is null.
Magnitudes are strings of digits, shifted by the power, since they may exceed what a decimal column holds. Units are respelled, never converted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lets import let

# Units, denominators, superscripts, markers, routes and words for a missing value that are recognised.
UNITS = ("mmol", "µmol", "umol", "nmol", "pmol", "mol", "mg", "µg", "ug", "ng", "pg", "g", "mEq", "IU", "U", "mmHg", "kPa", "bpm", "beats", "min", "mL", "ml", "L", "l", "dL", "dl", "fL", "fl", "mm", "cm", "m", "cells", "%")
DENOMINATORS = ("mL", "ml", "L", "l", "dL", "dl", "mm3", "mm^3", "mm^(3)", "kg", "h", "hr", "min", "s", "day")
BARE_DENOMINATORS = ("mL", "L", "l", "mm3")
SUPERSCRIPTS, PLAIN_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"
MARKERS = "*†‡§¶#"
ROUTES = "PO IM IV SC SQ SL PR INH IN TD NG PEG IO ID po im iv sc sq sl pr".split()
DOSE_UNITS = ("mg", "µg", "ug", "g", "mL", "ml", "IU", "U", "unit", "units", "mEq", "mmol")
MISSING = ("", "-", "–", "—", "na", "n/a", "nd", "not done", "not available", "missing")
LONGEST_TEXT, LARGEST_POWER = 1200, 30
FIELDS = "struct<comparator:string,mantissa:string,power_of_ten:int,magnitude:string,unit:string,notation:string>"


def explicit_notation(c: Column) -> Column:
    """Superscripts after a 10 as a written power: 10⁹ is 10^(9)."""
    raised = F.regexp_extract(c, f"10([{SUPERSCRIPTS}]+)", 1)
    return F.when(raised != "", F.replace(c, F.concat(F.lit("10"), raised), F.concat(F.lit("10^("), F.translate(raised, SUPERSCRIPTS, PLAIN_DIGITS), F.lit(")")))).otherwise(c)


def _without(text: Column, front: Column) -> Column:
    return F.ltrim(F.substr(text, F.length(front) + 1))


def _unit(text: Column) -> Column:
    """'' for none, the unit respelled, or null if it isn't known."""
    parts = F.split(text, "/")
    per = F.slice(parts, 2, 1000)
    bare = (F.get(parts, F.lit(0)) == "") & (F.size(parts) == 2) & F.get(parts, F.lit(1)).isin(*BARE_DENOMINATORS)
    known = F.get(parts, F.lit(0)).isin(*UNITS) & F.forall(per, lambda x: x.isin(*DENOMINATORS))
    liters = F.transform(per, lambda x: F.when(x == "hr", "h").when(x.rlike("^l"), F.concat(F.lit("L"), x.substr(2, 100))).otherwise(x))
    spelled = F.array_join(F.concat(F.slice(parts, 1, 1), liters), "/")
    return F.when(text == "", "").when(bare | known, F.replace(F.replace(spelled, F.lit("umol"), F.lit("µmol")), F.lit("ug"), F.lit("µg")))


def _shifted(mantissa: Column, power: Column) -> Column:
    """A decimal string times a power of ten, exactly: digits are kept, zeros are added at the end or the front."""
    sign = F.regexp_extract(mantissa, "^-", 0)
    whole, fraction = F.regexp_extract(mantissa, r"^-?(\d*)", 1), F.regexp_extract(mantissa, r"\.(\d+)$", 1)
    scale = F.length(fraction) + F.greatest(-power, F.lit(0))
    digits = F.concat(whole, fraction, F.repeat(F.lit("0"), F.greatest(power, F.lit(0))))
    digits = F.regexp_replace(F.lpad(digits, F.greatest(F.length(digits), scale + 1), "0"), r"^0+(?=\d)", "")
    digits = F.lpad(digits, F.greatest(F.length(digits), scale + 1), "0")
    cut = F.length(digits) - scale
    return F.concat(sign, F.substr(digits, F.lit(1), cut), F.when(scale > 0, F.concat(F.lit("."), F.substr(digits, cut + 1))).otherwise(""))


def _number(shown: Column) -> Column:
    """A printed number without sign for plus, thousands' commas and needless zeros; null if commas stand elsewhere."""
    grouped = shown.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$")
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(shown, r"^\+", ""), F.lit(","), F.lit("")), r"^(-?)0+(?=\d)", "$1"), r"^(-?)\.", "$10.")
    return F.when(grouped | shown.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)$"), bare)


def parsed_measurement(col: Column) -> Column:
    """A struct of FIELDS; null where the text is no scalar."""

    def from_power(than: Column, number: Column, rest: Column) -> Column:
        mark = F.regexp_extract(rest, r"^(?:[eE]\s*[+-]?\d{1,2}|[×x*]\s*10(?:\s*\^\s*(?:\([+-]?\d{1,2}\)|[+-]?\d{1,2}))?)", 0)
        exponent = F.regexp_extract(F.regexp_replace(mark, r"^[×x*]\s*10", ""), r"[+-]?\d+", 0)
        power = F.when(exponent == "", 0).otherwise(exponent.try_cast("int"))
        unit = _unit(_without(rest, mark))
        sound = number.isNotNull() & unit.isNotNull() & (F.abs(power) <= LARGEST_POWER) & ((exponent != "") | ~mark.rlike("^[eE]"))
        # a bare x 10 is a factor without its exponent, which counts as a plain number of power 0
        notation = F.when(exponent != "", "scientific").otherwise("decimal")
        return F.when(sound, F.struct(than.alias("comparator"), number.alias("mantissa"), power.alias("power_of_ten"), _shifted(number, power).alias("magnitude"), F.nullif(unit, F.lit("")).alias("unit"), notation.alias("notation")))

    def from_number(than: Column, rest: Column) -> Column:
        shown = F.regexp_extract(rest, r"^[+-]?[\d.,]*\d", 0)
        return let(F.struct(_number(shown).alias("n"), _without(rest, shown).alias("rest")), lambda v: from_power(than, v["n"], v["rest"]))

    def read(text: Column) -> Column:
        than = F.regexp_extract(text, "^(<=|>=|<|>)", 0)
        return let(F.struct(than.alias("than"), _without(text, than).alias("rest")), lambda v: from_number(F.when(v["than"] == "", "=").otherwise(v["than"]), v["rest"]))

    spelled = F.replace(F.replace(F.translate(F.trim(explicit_notation(col)), "−", "-"), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    return F.when(F.length(col) <= LONGEST_TEXT, let(spelled, read)).cast(FIELDS)


def without_markers(c: Column) -> Column:
    """struct<core, markers>: a table cell without footnote markers at its end (^(a), ^(b,c), ^a, *, †), and those in order."""
    one = rf"(?:\^\(\s*[A-Za-z0-9{MARKERS}]{{1,3}}(?:\s*,\s*[A-Za-z0-9{MARKERS}]{{1,3}})*\s*\)|\^[A-Za-z{MARKERS}]|[{MARKERS}])"
    text = F.trim(c)
    tail = F.regexp_extract(text, rf"^.+?((?:\s*{one})+)\s*$", 1)
    found = F.flatten(F.transform(F.regexp_extract_all(tail, F.lit(one), F.lit(0)), lambda m: F.split(F.regexp_replace(m, r"[\^()\s]", ""), ",")))
    return F.struct(F.rtrim(F.substr(text, F.lit(1), F.length(text) - F.length(tail))).alias("core"), F.filter(found, lambda x: x != "").alias("markers"))


def parsed_dose(c: Column) -> Column:
    """struct<components: array<struct<magnitude, unit, route>>, multiplicity>: '5 IM', '10 mg PO × 3', '5 IM + 5 PO'; null for others."""
    text = F.trim(c)
    times = F.regexp_extract(text, r"\s*[×x]\s*(\d{1,2})$", 1)
    body = F.regexp_replace(text, r"\s*[×x]\s*\d{1,2}$", "")
    shape = r"^([+-]?(?:\d+(?:\.\d+)?|\.\d+))\s*(.*?)\s*([A-Za-z]+)$"

    def component(part: Column) -> Column:
        # a unit may be glued to its route, so the longest route that leaves a known unit counts
        number = F.regexp_extract(part, r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)", 0)
        rest = F.trim(F.substr(part, F.length(number) + 1))
        route = F.get(F.filter(F.array(*map(F.lit, sorted(ROUTES, key=len, reverse=True))), lambda r: F.endswith(rest, r) & F.trim(F.substr(rest, F.lit(1), F.length(rest) - F.length(r))).isin("", *DOSE_UNITS)), F.lit(0))
        unit = F.trim(F.substr(rest, F.lit(1), F.length(rest) - F.length(route)))
        return F.struct(F.nullif(number, F.lit("")).alias("magnitude"), F.nullif(unit, F.lit("")).alias("unit"), route.alias("route"))

    parts = F.transform(F.split(body, r"\+"), lambda p: component(F.trim(p)))
    sound = text.rlike(shape) | (times != "")
    return F.when(sound & F.forall(parts, lambda p: p["magnitude"].isNotNull() & p["route"].isNotNull()), F.struct(parts.alias("components"), times.try_cast("int").alias("multiplicity")))


def parsed_cell(c: Column) -> Column:
    """struct<status, measurement, markers, dose>: missing_cell, parsed (as a scalar; without its markers; as a dose) or unparseable."""
    missing = lambda x: F.lower(F.trim(x)).isin(*MISSING)

    def read(v: Column) -> Column:
        scalar = F.coalesce(v["whole"], F.when(F.size(v["cut"]["markers"]) > 0, v["bare"]))
        blank = missing(v["text"]) | ((F.size(v["cut"]["markers"]) > 0) & missing(v["cut"]["core"]))
        status = F.when(blank, "missing_cell").when(scalar.isNotNull() | v["dose"].isNotNull(), "parsed").otherwise("unparseable")
        return F.struct(status.alias("status"), F.when(~blank, scalar).alias("measurement"), v["cut"]["markers"].alias("markers"), F.when(~blank & scalar.isNull(), v["dose"]).alias("dose"))

    cut = without_markers(c)
    return let(F.struct(c.alias("text"), parsed_measurement(c).alias("whole"), parsed_measurement(cut["core"]).alias("bare"), cut.alias("cut"), parsed_dose(cut["core"]).alias("dose")), read)
