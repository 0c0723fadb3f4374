"""Which telephone-like hits are telephones: not public numbers, amounts, acts, years, dates or process numbers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .segments import after, before, once


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def starts_with_any(x: Column, values: tuple[str, ...]) -> Column:
    return reduce(or_, (x.startswith(v) for v in values))


def is_phone(hit: Column, i: Column, gaps: Column, hits: Column) -> Column:
    """hit i of a text cut into gaps and hits. A hit has nine characters at least, so three cover the 25 before it."""
    bare, context = F.regexp_replace(hit, r"(?U)^\s+|\s+$", ""), before(gaps, hits, i, 25, 3)

    def of(c: Column) -> Column:
        d, n = c["digits"], F.length(c["digits"])
        bad = starts_with_any(c["bare"], P.PUBLIC_NUMBERS) | starts_with_any(d, P.PUBLIC_DIGITS) | c["context"].rlike(P.MONEY_BEFORE) | c["context"].rlike(P.ACT_BEFORE) | c["bare"].rlike(P.YEARS)
        near = F.concat(F.right(c["context"], F.lit(10)), hit, after(gaps, hits, i, 10, 2))
        return ~bad & ~once(near, lambda x: x.rlike(P.DATE_NEAR) | x.contains("/")) & n.between(8, 13) & ~((n == 8) & starts_with_any(d, ("19", "20")))

    return once(F.struct(bare.alias("bare"), digits(hit).alias("digits"), context.alias("context")), of)


def phone_key(hit: Column) -> Column:
    d = digits(hit)
    return F.when(d.startswith("55") & (F.length(d) > 10), F.substring(d, 3, 99)).otherwise(d)
