"""Names of persons in a text: context anchors, shapes with known first names, and a negative filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gazetteer as G
from . import patterns as P
from .canonical import clean_prefixes, has_any, initials, is_name, normalize_text, words
from .segments import hits


def read_first_names(df: DataFrame, column: str = "name", most: int = 500_000) -> tuple[str, ...]:
    """Distinct first names of a table (a census list, say), normalized and sorted, to pass on as `first_names`.

    They become part of the plans that use them, so a table of more than `most` is refused rather than cut.
    """
    found = [r.n for r in df.select(normalize_text(F.col(column)).alias("n")).filter("n != ''").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} first names; is this a list of first names?")
    return tuple(sorted(found))


def extract_names(text: Column, first_names: Column | Iterable[str], more: Column | None = None) -> Column:
    """A sorted array of distinct names.

    first_names: what a name found by its shape alone must begin with, an array column or strings; () leaves the names
    that a phrase anchors. `more`: candidates of a model, as an array (cleaned like the anchors').
    """
    anchored = [hits(text, p, 1) for p in P.ANCHORS] + ([more] if more is not None else [])
    cleaned = F.filter(F.transform(F.flatten(F.array(*anchored)), clean_prefixes), lambda n: (F.size(words(n)) >= 2) & (F.length(n) > 4))
    shaped = F.transform(F.concat(hits(text, P.NAME_CAPS), hits(text, P.NAME_TITLE)), lambda n: F.array_join(words(n), " "))
    shaped = F.filter(shaped, lambda n: is_name(n, first_names))
    allowed = lambda n: ~normalize_text(n).isin(*G.PROTECTED) & ~has_any(normalize_text(n), G.FORBIDDEN)
    found = F.array_sort(F.array_distinct(F.filter(F.concat(cleaned, shaped), allowed)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(found)


def replace_names(text: Column, names: Column, mode: str = "iniciais") -> Column:
    """Longest names first, equally long ones in order of their letters; other modes than "iniciais" give [NOME]."""
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    sub = (lambda n: P.quoted(initials(n))) if mode == "iniciais" else (lambda n: F.lit("[NOME]"))
    return F.aggregate(longest, text, lambda acc, n: F.regexp_replace(acc, P.tolerant_col(n), sub(n)))
