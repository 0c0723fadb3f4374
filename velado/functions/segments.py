"""Rewriting hits that need their context: cut a text into gaps and hits, decide on each hit, put the text together.

gaps = split(text, P) has one element more than hits = all matches of P, which never match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often use names it: inside a lambda nothing else shares what is used twice."""
    return F.get(F.transform(F.array(x), use), 0)


#: Stands where a text is to be cut. Java builds a pattern anew at each split, unless it is one plain character.
CUT = "\uffff"


def gaps(text: Column, pattern: str) -> Column:
    return F.when(text.contains(CUT), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, CUT), CUT, -1))


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def joined(gaps_: Column, pieces: Column) -> Column:
    """gap, piece, gap, piece ... gap."""
    return once(F.struct(gaps_.alias("g"), pieces.alias("p")), lambda c: F.concat(F.array_join(F.zip_with(F.slice(c["g"], 1, F.size(c["p"])), c["p"], lambda g, p: F.concat(g, p)), ""), F.element_at(c["g"], -1)))


def before(gaps_: Column, hits_: Column, i: Column, n: int, back: int) -> Column:
    """The last n characters before hit i; `back` hits and the gaps around them are sure to hold that many."""
    low = F.greatest(i - back, F.lit(0))
    earlier = F.zip_with(F.slice(gaps_, low + 1, i - low), F.slice(hits_, low + 1, i - low), lambda g, h: F.concat(g, h))
    return F.right(F.concat(F.array_join(earlier, ""), F.get(gaps_, i)), F.lit(n))


def after(gaps_: Column, hits_: Column, i: Column, n: int, ahead: int) -> Column:
    """The first n characters after hit i."""
    later = F.zip_with(F.slice(hits_, i + 2, ahead), F.slice(gaps_, i + 3, ahead), lambda h, g: F.concat(F.coalesce(h, F.lit("")), F.coalesce(g, F.lit(""))))
    return F.left(F.concat(F.get(gaps_, i + 1), F.array_join(later, "")), F.lit(n))


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like these that df does not have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rewrite(df: DataFrame, column: str, pattern: str, piece: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """df with each hit in its text column replaced by piece(hit, index, gaps, hits).

    Gaps and hits are columns of their own meanwhile, so that each is computed once.
    """
    g, h = spare(df, "_gaps", "_hits")
    cut = df.withColumn(g, gaps(F.col(column), pattern)).withColumn(h, hits(F.col(column), pattern))
    pieces = F.transform(F.col(h), lambda x, i: piece(x, i, F.col(g), F.col(h)))
    return cut.withColumn(column, F.when(F.size(h) > 0, joined(F.col(g), pieces)).otherwise(F.col(column))).drop(g, h)
