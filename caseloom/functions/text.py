"""Text keys, word sets, similarities and spellings as column expressions.

Only case folding with compatibility forms and the ratio of matching characters need Python (in Arrow batches); all else is built in.
Null texts are empty unless a function says otherwise.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .lets import let

# Words without weight, signs that count as a hyphen, values that tell nothing, unit spellings in their order.
LIGHT_WORDS = "a an the of and or in on at to for with by from was were is are be been as this that".split()
HYPHENS = "−‒–—‐‑﹣－"
TELLS_NOTHING = ("", "unknown", "not_documented", "unspecified")
UNIT_SPELLINGS = (("mcg", "ug"), ("litre", "l"), ("liter", "l"), ("per", "/"), ("years", "year"), ("yrs", "year"), ("yr", "year"), ("×", "x"), ("^", ""), ("*", "x"))
CONTAINED, SHORT_QUOTE, OTHER_SEGMENT = 0.75, 0.5, 0.9


@F.pandas_udf(StringType())
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.arrow_udf(ArrayType(StringType()))
def _all_folded(texts: pa.Array) -> pa.Array:
    flat = pc.fill_null(texts.flatten(), "")
    if pc.all(pc.string_is_ascii(flat)).as_py() is not False:
        folds = pc.ascii_lower(flat)
    else:
        folds = pa.array([unicodedata.normalize("NFKC", x).casefold() for x in flat.to_pylist()], flat.type)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), folds, mask=texts.is_null())


@F.pandas_udf(DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def most_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Length of the longest common subsequence of ASCII texts of up to 64 signs, a bit for each sign of the first: no fewer than the signs that SequenceMatcher matches."""
    n, rows, one = len(a), np.arange(len(a)), np.uint64(1)
    x, y = (np.array(t, "S64").view(np.uint8).reshape(n, 64) for t in (a, b))
    sizes = np.array([len(t) for t in a])
    places, left = np.zeros((n, 128), np.uint64), np.full(n, ~np.uint64(0))
    for k in range(max(map(len, a))):
        places[rows, x[:, k]] |= one << np.uint64(k)
    places[:, 0] = 0  # the filling behind the end
    for k in range(max(map(len, b))):
        met = left & places[rows, y[:, k]]
        left = (left + met) | (left - met)
    return np.bitwise_count(~left & (~np.uint64(0) >> (64 - sizes).astype(np.uint64)))


@F.arrow_udf(DoubleType())
def _ratio_from(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    out: list[float | None] = [None] * len(a)
    asked = [(k, x, y, w) for k, (x, y, w) in enumerate(zip(a.to_pylist(), b.to_pylist(), least.to_pylist(), strict=True)) if x is not None and y is not None]
    short = [i for i in asked if i[3] > 0 and 0 < len(i[1]) <= 64 and 0 < len(i[2]) <= 64 and i[1].isascii() and i[2].isascii() and "\0" not in i[1] + i[2]]
    for at in range(0, len(short), 4096):
        own = short[at : at + 4096]
        found = most_common([x.encode() for _, x, _, _ in own], [y.encode() for _, _, y, _ in own]).tolist()
        for (k, x, y, w), m in zip(own, found, strict=True):
            out[k] = -1.0 if 2.0 * m / (len(x) + len(y)) < w else None
    for k, x, y, _ in asked:
        out[k] = None if out[k] is not None else SequenceMatcher(None, x, y, autojunk=False).ratio()
    return pa.array(out, pa.float64())


# The optimizer copies what is deterministic into every filter and column above it, and each copy has Python workers of its own on every core.
_ratio_once, _all_folded_once = (F.arrow_udf(f.func, f.returnType).asNondeterministic() for f in (_ratio_from, _all_folded))


@F.pandas_udf(StringType())
def _unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(html.unescape, na_action="ignore")


def folded(c: Column) -> Column:
    """Compatibility form in folded case."""
    return _folded(F.coalesce(c, F.lit("")))


def key_of(fold: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.replace(fold, F.lit("µ"), F.lit("u")), F.lit("μ"), F.lit("u")), "[^a-z0-9]+", " "))


def key(c: Column) -> Column:
    """ASCII words and numbers in folded case, one blank between; the micro sign as u."""
    return key_of(folded(c))


def folded_array(texts: Column) -> Column:
    """array<string>: folded() of each text, in one step of Python that stands in the plan once; for columns of their own, not for filters."""
    return _all_folded_once(texts)


def folded_unless_plain(texts: Column) -> Column:
    """folded_array(), null where all texts are plain ASCII, so that their folds are their lower(): these don't pass through Python."""
    whole = F.array_join(texts, "")
    return folded_array(F.when(F.octet_length(whole) != F.length(whole), texts))


def _signs(fold: Column) -> Column:
    return F.regexp_replace(F.translate(fold, HYPHENS, "-" * len(HYPHENS)), r"(?U)\s+", "")


def signs(c: Column) -> Column:
    """All that is no white space, in folded case, hyphens alike."""
    return _signs(folded(c))


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def _words(k: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(k, " "), lambda w: w != ""), singular))


def words(c: Column, weighty: bool = False) -> Column:
    """The set of singular words, in order of their first place; weighty: without the light ones."""
    own = _words(key(c))
    return F.array_except(own, F.array(*map(F.lit, LIGHT_WORDS))) if weighty else own


def informative(c: Column) -> Column:
    """Whether a text tells anything; false for null."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*TELLS_NOTHING), F.lit(False))


def dice(a: Column, b: Column) -> Column:
    """Of two sets: twice the common part over both sizes; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def text_dice(a: Column, b: Column) -> Column:
    return dice(words(a), words(b))


def parts(fold: Column) -> Column:
    """struct<key, signs, words> of a folded text: what similarity() compares; signs only of texts without words."""
    k = key_of(fold)
    own, less = _words(k), F.array_except(_words(k), F.array(*map(F.lit, LIGHT_WORDS)))
    return F.struct(k.alias("key"), F.when(k == "", _signs(fold)).alias("signs"), F.when(F.size(less) > 0, less).otherwise(own).alias("words"))


def ratio(a: Column, b: Column, where: Column, least: Column | None = None) -> Column:
    """Of two parts() the ratio of matching characters, in a step of Python that stands in the plan once; null where alike() doesn't ask for it or `where` fails.

    Null, too, where it is under `least` for certain; what isn't told apart that way is measured.
    """
    asked = where & (a["key"] != "") & (b["key"] != "") & (a["key"] != b["key"])
    return _ratio_once(F.when(asked, a["key"]), F.when(asked, b["key"]), F.coalesce(least, F.lit(0.0)) if least is not None else F.lit(0.0))


def alike_words(a: Column, b: Column) -> Column:
    """Of two parts() the part of similarity() that their words give."""
    wa, wb = a["words"], b["words"]
    common = F.size(F.array_intersect(wa, wb))
    some = (F.size(wa) > 0) & (F.size(wb) > 0)
    return F.when(some, F.greatest(2 * common / (F.size(wa) + F.size(wb)), CONTAINED * common / F.least(F.size(wa), F.size(wb)))).otherwise(F.lit(0.0))


def alike(a: Column, b: Column, ratio: Column, by_words: Column | None = None) -> Column:
    """similarity() of two parts() with the ratio of matching characters (by_words: their alike_words() where it is known)."""
    symbols = F.coalesce((a["signs"] != "") & (a["signs"] == b["signs"]), F.lit(False))  # equal signs, equally without words
    own = alike_words(a, b) if by_words is None else by_words
    return F.when((a["key"] == "") | (b["key"] == ""), symbols.cast("double")).when(a["key"] == b["key"], F.lit(1.0)).otherwise(F.greatest(own, ratio))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 for short labels: the largest of the weighty words' Dice, three quarters of their containment, and the ratio of matching characters.

    Labels without words are alike if their signs are equal and there are any.
    """
    pa, pb = parts(folded(a)), parts(folded(b))
    return alike(pa, pb, _ratio(pa["key"], pb["key"]))


def numbers(c: Column) -> Column:
    """All numbers of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def num_equal(a: Column, b: Column) -> Column:
    """Equal to a millionth of the first (or of 1); false for null."""
    return F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(a.cast("double"))), F.lit(False))


def texts_agree(a: Column, b: Column, threshold: float = 0.6, similar: Column | None = None) -> Column:
    """Numbers, where both texts have some, must be the same; then similarity decides (similar: where it is known)."""
    na, nb = F.array_sort(numbers(a)), F.array_sort(numbers(b))
    same = (F.size(na) == F.size(nb)) & F.forall(F.arrays_zip(na.alias("x"), nb.alias("y")), lambda p: num_equal(p["x"], p["y"]))
    return ((F.size(na) == 0) | (F.size(nb) == 0) | same) & ((similarity(a, b) if similar is None else similar) >= threshold)


def _quoted(evidence: Column) -> Column:
    return F.filter(F.coalesce(evidence, F.array().cast("array<struct<segment:string,quote:string>>")), lambda e: F.coalesce(e["quote"], F.lit("")) != "")


def quotes(evidence: Column) -> Column:
    """The quotes that spans() takes."""
    return F.transform(_quoted(evidence), lambda e: e["quote"])


def spans(evidence: Column, fold: Column | None = None) -> Column:
    """array<struct<segment, quote>> -> array<struct<segment, words, key>> of those with a quote; fold: folds of their quotes() where they are known."""
    segments = F.transform(_quoted(evidence), lambda e: e["segment"])
    keys = F.transform(_all_folded(quotes(evidence)) if fold is None else fold, key_of)
    return F.transform(F.arrays_zip(segments.alias("segment"), keys.alias("key")), lambda e: F.struct(e["segment"].alias("segment"), _words(e["key"]).alias("words"), e["key"].alias("key")))


def span_overlap(a: Column, b: Column, jaccard: bool = False) -> Column:
    """Of two spans() columns the best overlap of two quotes: common words over the smaller set (jaccard: over both).

    Quotes of under three words count half, those of other segments nine tenths; an equal quote gives 1.
    """

    def one(x: Column, y: Column) -> Column:
        small = F.least(F.size(x["words"]), F.size(y["words"]))
        over = F.size(F.array_union(x["words"], y["words"])) if jaccard else small
        part = F.size(F.array_intersect(x["words"], y["words"])) / over
        part = part * F.when(small < 3, SHORT_QUOTE).otherwise(1.0)
        part = part * F.when((x["segment"] != "") & (y["segment"] != "") & (x["segment"] != y["segment"]), OTHER_SEGMENT).otherwise(1.0)
        return F.when(x["key"] == y["key"], F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(part)

    best = lambda values: F.coalesce(F.array_max(values), F.lit(0.0))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: best(F.transform(v["a"], lambda x: best(F.transform(v["b"], lambda y: one(x, y))))))


def unit(c: Column, fold: Column | None = None) -> Column:
    """A unit respelled, never converted; null if it tells nothing (fold: folded() where it is known)."""
    out = F.translate(folded(c) if fold is None else fold, "µμ", "uu")
    for old, new in UNIT_SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(informative(c), F.regexp_replace(out, r"(?U)\s+", ""))


def figure_key(c: Column) -> Column:
    """'Figure 2A' and 'fig. 2a' are fig2a; other names keep their letters and digits."""
    own = F.replace(key(c), F.lit(" "), F.lit(""))
    number = F.regexp_extract(own, r"^(?:figure|fig|f)(\d+[a-z]?)$", 1)
    return F.when(number != "", F.concat(F.lit("fig"), number)).otherwise(own)


def panel_key(c: Column) -> Column:
    """Null, blank and whole figures are _whole; a single letter stands for itself; positions in common words."""
    own = F.trim(F.regexp_replace(key(c), r"^(?:fig(?:ure)?\s*\d*\s*)?(?:panel\s*)?", ""))
    letter = F.regexp_extract(own, r"^\d*\s*([a-z])$", 1)
    named = F.transform(F.filter(F.split(own, " "), lambda w: ~w.isin("image", "panel", "view")), lambda w: F.when(w == "top", "upper").when(w == "bottom", "lower").otherwise(w))
    plain = F.array_join(named, " ")
    return F.when(c.isNull() | own.isin("", "whole", "main", "whole figure"), "_whole").when(own == "main image", "main").when(letter != "", letter).when(plain != "", plain).otherwise(own)


def without_markup(c: Column) -> Column:
    """Text between tags, references resolved, white space squeezed."""
    return F.trim(F.regexp_replace(_unescaped(F.regexp_replace(c, "<[^>]+>", " ")), r"(?U)\s+", " "))


def extension(name: Column) -> Column:
    """The lower-case suffix with its dot; empty without one (a leading dot begins no suffix)."""
    return F.lower(F.regexp_extract(F.regexp_extract(F.coalesce(name, F.lit("")), "[^/]*$", 0), r"[^.].*?(\.[^.]+)$", 1))


def column_index(ref: Column) -> Column:
    """'AB12' -> 27, the zero-based place of a spreadsheet column; null without letters."""
    letters = F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1))
    place = F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))
    return F.when(letters != "", place - 1)


def column_letters(index: Column) -> Column:
    """27 -> 'AB'; up to three letters, null beyond and below 0."""
    letter = lambda n: F.char((F.lit(65) + n).cast("int"))
    i = index.cast("bigint")
    two = i - 26
    three = i - 702
    one_ = letter(i)
    two_ = F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26))))
    three_ = F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26))))
    return F.when((i >= 0) & (i < 26), one_).when((i >= 26) & (i < 702), two_).when((i >= 702) & (i < 18278), three_)


def all_places(text: Column, part: Column) -> Column:
    """Zero-based offsets of every occurrence of a literal, overlapping ones too; empty for an empty or null literal."""
    n = F.length(part)
    last = F.length(text) - n
    starts = F.when(F.coalesce(n, F.lit(0)).between(1, 1 << 30) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.substr(text, i + 1, n) == part)
    return F.when(F.contains(text, part), found).otherwise(F.array().cast("array<int>"))


def without_quoted(text: Column) -> Column:
    """Text outside double quotes of any kind."""
    return F.regexp_replace(text, "\"[^\"]*\"|“[^”]*”", "")


def number_forms(value: Column) -> Column:
    """Spellings in which a number may be printed: plain, with a fraction of zero, with a comma between thousands."""
    v = value.cast("double")
    whole = v == F.floor(v)
    plain = F.when(whole, F.format_string("%d", F.floor(v).cast("bigint"))).otherwise(value.cast("string"))
    return F.when(v.isNotNull(), F.array_distinct(F.filter(F.array(plain, F.when(whole, F.concat(plain, F.lit(".0"))), F.when(whole & (F.abs(v) >= 1000), F.format_number(v, 0))), lambda x: x.isNotNull())))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before white space and a capital, digit or bracket, but not after initials and common abbreviations."""
    guard = r"(?<!\b(?:[A-Z]|vs|Fig|Dr|Mr|Mrs|No|approx|i\.e|e\.g|et al)\.)"
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){guard}\s+(?=[A-Z0-9(\[])"), F.trim), lambda s: s != "")


def content_stems(text: Column, length: int = 5) -> Column:
    """The first letters of each weighty word of four letters and more."""
    return F.array_distinct(F.transform(F.filter(words(text, weighty=True), lambda w: w.rlike("^[a-z]{4,}$")), lambda w: w.substr(1, length)))


def abbreviations(text: Column) -> Column:
    """array<struct<short, long>> of 'some long form (SLF)' whose words begin with the letters of the short form."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:[A-Za-z-]+ ){1,8}\([A-Z]{2,8}\)"), F.lit(0))

    def entry(x: Column) -> Column:
        short = F.regexp_extract(x, r"\(([A-Z]+)\)$", 1)
        own = F.split(F.trim(F.regexp_replace(x, r"\([A-Z]+\)$", "")), " ")
        long = F.slice(own, F.greatest(F.size(own) - F.length(short) + 1, F.lit(1)), F.length(short))
        return F.struct(short.alias("short"), F.array_join(long, " ").alias("long"))

    return F.filter(F.transform(found, entry), lambda e: initials_match(e["short"], e["long"]))


def initials_match(short: Column, label: Column) -> Column:
    """Whether the first letters of a label's words are the short form."""
    return F.upper(F.array_join(F.transform(F.split(label, r"[\s-]+"), lambda w: w.substr(1, 1)), "")) == F.upper(short)


def british_to_american(word: Column) -> Column:
    """The American spelling of common British endings and vowels, in lower case."""
    out = F.lower(word)
    for old, new in (("aemia", "emia"), ("haem", "hem"), ("oedema", "edema"), ("oesoph", "esoph"), ("paed", "ped"), ("isation", "ization"), ("ising$", "izing"), ("ise(d|s)?$", "ize$1"), ("our$", "or"), ("tre$", "ter"), ("ogue$", "og"), ("yse(d|s)?$", "yze$1")):
        out = F.regexp_replace(out, old, new)
    return out


def inflection_stems(word: Column) -> Column:
    """Shorter forms that a word may be inflected from: without s, es, ies (y), ed, ing, ly."""
    w = F.lower(word)
    cut = lambda end, by="": F.when(w.rlike(f"...{end}$"), F.regexp_replace(w, f"{end}$", by))
    return F.array_distinct(F.filter(F.array(cut("s"), cut("es"), cut("ies", "y"), cut("ed"), cut("ed", "e"), cut("ing"), cut("ing", "e"), cut("ly")), lambda x: x.isNotNull()))


def literal_span(text: Column, part: Column) -> Column:
    """The source's own spelling of a part, found whatever its case, hyphens and white space; null if it isn't there."""
    return _literal(text, part)


@F.pandas_udf(StringType())
def _literal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def kept(x: str) -> list[tuple[str, int]]:
        return [(f, k) for k, ch in enumerate(x) if not ch.isspace() and ch != "-" and ch not in HYPHENS for f in ch.casefold()]

    def found(text: str | None, part: str | None) -> str | None:
        if not text or not part:
            return None
        own, want = kept(text), "".join(f for f, _ in kept(part))
        at = "".join(f for f, _ in own).find(want) if want else -1
        return None if at < 0 else text[own[at][1] : own[at + len(want) - 1][1] + 1]

    for a, b in batches:
        yield pd.Series([found(x, y) for x, y in zip(a, b, strict=True)], dtype="object")
