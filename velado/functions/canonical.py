"""Scalar functions on columns: keys under which spellings count as one value, and masks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import gazetteer as G
from .phone import digits

STRIPPED = ":,;.-– "


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Latin letters with marks -> without, by the rule of compatibility decomposition; those that become several apart."""
    one, to, many = [], [], {}
    for ch in map(chr, range(0xA0, 0x180)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != ch:
            one.append(ch)
            to.append(bare)
        elif len(bare) > 1:
            many[ch] = bare
    return "".join(one), "".join(to), many


_FROM, _TO, _MANY = _decomposed()


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column) -> Column:
    """Without accents, in capitals, without white space around; null becomes empty."""
    bare = F.translate(F.regexp_replace(F.coalesce(x, F.lit("")), r"\p{M}", ""), _FROM, _TO)
    for ch, letters in _MANY.items():
        bare = F.replace(bare, F.lit(ch), F.lit(letters))
    return strip(F.upper(bare))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def email_key(x: Column) -> Column:
    return F.lower(strip(x))


def rg_key(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))


def marker(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), n.cast("string"), F.lit("]"))


def mask_cpf(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) == 11, F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-**"))).otherwise("***.***.***-**")


def mask_seven_digits(x: Column) -> Column:
    return F.when(F.length(x) == 7, F.concat(F.lit("XXXXX"), F.right(x, F.lit(2)))).otherwise("XXXXXXX")


def clean_prefixes(x: Column) -> Column:
    """A captured name without the articles and roles in front of it."""
    w = words(x)
    kept = F.transform(w, lambda p: ~normalize_text(F.trim(p, F.lit(STRIPPED))).isin("", *G.PREFIXES))
    at = F.array_position(kept, True).cast("int")
    return F.when(at > 0, F.trim(F.array_join(F.slice(w, F.greatest(at, F.lit(1)), F.size(w)), " "), F.lit(STRIPPED))).otherwise("")


def has_any(normalized: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words(normalized), F.array(*(F.lit(v) for v in values)))


def known_first(normalized: Column, first_names: Column | Iterable[str]) -> Column:
    """Whether a normalized word is among the first names: an array column of normalized names, or names as anyone writes them.

    Names from Python become one hash set of the plan.
    """
    if isinstance(first_names, Column):
        return F.array_contains(first_names, normalized)
    return normalized.isin(*sorted({bare_upper(n) for n in first_names} - {""}))


def bare_upper(x: str | None) -> str:
    """normalize_text of one Python string."""
    return "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).upper().strip()


def is_name(x: Column, first_names: Column | Iterable[str]) -> Column:
    """Whether a candidate looks like a person's name: two words, nothing protected or institutional, a known first name."""
    bare = F.array_join(words(x), " ")
    n = normalize_text(bare)
    known = known_first(normalize_text(F.get(words(x), 0)), first_names)
    return F.coalesce((F.size(words(x)) >= 2) & (F.length(bare) > 4) & ~n.isin(*G.PROTECTED) & ~has_any(n, G.INSTITUTIONAL) & known, F.lit(False))


def initials(x: Column) -> Column:
    own = F.filter(words(x), lambda w: ~normalize_text(w).isin(*G.INITIAL_STOPWORDS))
    short = lambda w: (F.length(w) <= 2) & (w.endswith(".") | ((w == F.upper(w)) & (w != F.lower(w))))
    letter = lambda w: F.when(short(w), F.when(w.endswith("."), w).otherwise(F.concat(w, F.lit(".")))).when(F.length(w) > 1, F.concat(F.upper(F.left(w, F.lit(1))), F.lit(".")))
    found = F.filter(F.transform(own, letter), lambda p: p.isNotNull())
    return F.when(F.size(found) == 0, "[N.I.]").otherwise(F.array_join(found, " "))


def font_size(height: Column) -> Column:
    """The size of a mask's text in a box of this height; rounds half to even."""
    return F.greatest(F.bround(height * 0.75, 1), F.lit(6.0))
