"""Reversible anonymisation: values become numbered markers, the same value the same marker within a scope.

calls: rows of (scope_id, seq, text, ...), a scope's texts in the order of seq. Passes run in a fixed order (e-mail,
telephone, CPF, RG), each on what the one before left. Only a telephone looks at what stands around it, so only the length
of an e-mail's marker can decide on a later hit; the passes after the e-mails therefore see each other's hits as
placeholders, and one round of numbering serves them all.

Texts without any hit stay where they are: they are neither shuffled nor written. Of the others, hits are exploded and
shuffled; distinct values of a scope are reduced before the shuffle, so a value that recurs a million times is one row a
task, and a scope's values are numbered in ranges.

Nulls and edges: rows are known by a number of their own, so null or repeated scope_id and seq lose nothing. Rows of null
scope_id are one scope; null seq comes before all numbers; of hits at one place of equal seq the lesser value comes first.
Null and empty texts pass through. Further columns of any name are kept. `calls` is read twice and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.canonical import email_key, marker, rg_key
from ..functions.phone import digits, is_phone, phone_key
from ..functions.segments import gaps, hits, joined, once
from ..plans.cut import Tables

TYPES = ("email", "telefone", "cpf", "rg")
VAULT = "scope_id string, type string, ordinal long, marker string, original string, canonical string"


def _phone(v: Column, i: Column, g: Column, h: Column) -> Column:
    return F.when(is_phone(v, i, g, h), phone_key(v))


#: kind -> its marker's type, and a list of (pattern, group that holds the value, key of a value or null where it is none).
_PASSES = {
    "email": ("EMAIL", [(P.EMAIL, 0, lambda v, i, g, h: email_key(v))]),
    "telefone": ("TELEFONE", [(P.PHONE, 0, _phone)]),
    "cpf": ("CPF", [(P.CPF, 0, lambda v, i, g, h: digits(v)), (P.CPF_BARE, 1, lambda v, i, g, h: v)]),
    "rg": ("RG", [(P.RG, 1, lambda v, i, g, h: F.when(F.length(rg_key(v)) >= 4, rg_key(v)))]),
}
#: Kinds that are numbered in one round.
_ROUNDS = (("email",), ("telefone", "cpf", "rg"))


def _values(text: Column, pattern: str, group: int, key) -> Column:
    """An array of (value, key), in order; key null where the hit is left alone."""
    values = lambda v, g, h: F.transform(v, lambda x, i: F.struct(x.alias("value"), key(x, i, g, h).alias("key")))
    if key is not _phone:
        return values(hits(text, pattern, group), None, None)
    return once(F.struct(gaps(text, pattern).alias("g"), hits(text, pattern).alias("h")), lambda c: values(c["h"], c["g"], c["h"]))


def _rewritten(text: Column, pattern: str, group: int, marker_at) -> Column:
    """marker_at: a hit's position -> its marker, or null where it is left alone. The value is the end of its hit."""
    if group == 0:
        return joined(gaps(text, pattern), F.transform(hits(text, pattern), lambda x, i: F.coalesce(marker_at(i), x)))

    def of(v: Column) -> Column:
        return F.transform(hits(text, pattern), lambda x, i: F.coalesce(F.concat(F.left(x, F.length(x) - F.length(F.get(v, i))), marker_at(i)), x))

    return joined(gaps(text, pattern), once(hits(text, pattern, group), of))


def _placeholder(values: str, marker_: str):
    """A hit's position -> the placeholder if the column of values has a key there."""
    return lambda i: F.when(F.get(F.col(values), i)["key"].isNotNull(), F.lit(marker_))


def _labelled(values: str, name: str, form: int) -> Column:
    return F.transform(values, lambda x, i: F.struct(F.lit(name).alias("type"), F.lit(form).alias("form"), i.alias("pos"), x["value"].alias("value"), x["key"].alias("key")))


def _of_form(form: int) -> Column:
    """A map from position to marker of one form's marks."""
    return F.map_from_entries(F.transform(F.filter("marks", lambda x: x["form"] == form), lambda x: F.struct(x["pos"], x["marker"])))


def _at(markers: str):
    return lambda i: F.try_element_at(F.col(markers), i)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _numbered(first: DataFrame, tables: Tables, name: str) -> DataFrame:
    """first (type, scope, key, first) with `ordinal`: 1, 2, ... in each type and scope, in the order of first occurrence.

    A scope may hold a large part of all values, so no task numbers a whole scope: values are sorted into ranges, numbered
    within each range, and moved on by what the ranges before hold of their scope.
    """
    place = ["type", "scope", "first.seq", "first.form", "first.pos", "first.value", "key"]
    ranged = tables.write(first.repartitionByRange(*(F.col(c) for c in place)).withColumn("part", F.spark_partition_id()), name)
    sizes = ranged.groupBy("type", "scope", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("type", "scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("type").alias("o_type"), F.col("scope").alias("o_scope"), F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("type", "scope", "part").orderBy(*place[2:]))
    moved = ranged.withColumn("within", within).join(offsets, (F.col("type") == F.col("o_type")) & (F.col("part") == F.col("o_part")) & _same(F.col("scope"), F.col("o_scope")))
    return moved.withColumn("ordinal", (F.col("before") + F.col("within")).cast("long")).select("type", "scope", "key", "first", "ordinal")


def _vault(found: DataFrame, known: DataFrame | None, tables: Tables, name: str) -> DataFrame:
    """The vault rows of the values found: those that `known` has, with its markers, and new ones numbered after them."""
    first = found.groupBy("type", "scope", "key").agg(F.min(F.struct("seq", "form", "pos", "value")).alias("first"))
    own = lambda df: df.select(F.col("scope").alias("scope_id"), "type", "ordinal", marker(F.col("type"), F.col("ordinal")).alias("marker"), F.col("first.value").alias("original"), F.col("key").alias("canonical"))
    if known is None:
        return tables.write(own(_numbered(first, tables, f"{name}-ranges")), f"{name}-vault")
    k = known.toDF(*(f"k_{c}" for c in known.columns))
    match = (F.col("type") == F.col("k_type")) & (F.col("key") == F.col("k_canonical")) & _same(F.col("scope"), F.col("k_scope_id"))
    last = k.groupBy("k_type", "k_scope_id").agg(F.max("k_ordinal").alias("last"))
    new = _numbered(first.join(k, match, "left_anti"), tables, f"{name}-ranges")
    new = new.join(last, (F.col("type") == F.col("k_type")) & _same(F.col("scope"), F.col("k_scope_id")), "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("last", F.lit(0)))
    old = k.join(first, match, "left_semi").toDF(*known.columns).select("scope_id", "type", "ordinal", "marker", "original", "canonical")
    return tables.write(old.unionByName(own(new)), f"{name}-vault")


def anonymize(calls: DataFrame, types: Iterable[str] = TYPES, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls with their texts rewritten, vault). Unknown type names are ignored.

    known: the vault of earlier calls; its values keep their markers, new ones are numbered after them, and the vault
    returned holds both. Keep the vault apart from the texts: it holds the values.
    """
    spark, wanted = calls.sparkSession, {t.strip().lower() for t in types}
    rounds = [r for r in (tuple(t for t in kinds if t in wanted) for kinds in _ROUNDS) if r]
    if not rounds:
        return calls, known if known is not None else spark.createDataFrame([], VAULT)
    tables = Tables(spark, "text-mode")
    own = calls.toDF(*(f"c{k}" for k in range(len(calls.columns))))
    scope, seq, text = (F.col(f"c{calls.columns.index(c)}") for c in ("scope_id", "seq", "text"))
    may = F.coalesce(reduce(or_, (text.rlike(p) for kinds in rounds for t in kinds for p, *_ in _PASSES[t][1])), F.lit(False))
    rows = tables.write(own.filter(may).select("*", scope.alias("scope"), seq.alias("seq"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "rows-0")
    vaults = []
    for n, kinds in enumerate(rounds):
        forms = [(_PASSES[t][0], *form) for t in kinds for form in _PASSES[t][1]]
        seen = rows.select("scope", "seq", "row", F.col("text").alias("t"))
        for k, (name, pattern, group, key) in enumerate(forms):
            seen = seen.withColumn(f"v{k}", _values(F.col("t"), pattern, group, key))
            if k + 1 < len(forms):
                seen = seen.withColumn("t", _rewritten(F.col("t"), pattern, group, _placeholder(f"v{k}", f"[{name}_0]")))
        each = F.concat(*(_labelled(f"v{k}", name, k) for k, (name, *_) in enumerate(forms)))
        found = seen.select("scope", "seq", "row", F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("hit"))
        found = tables.write(found.select("scope", "seq", "row", "hit.*"), f"hits-{n}")
        vault = _vault(found, known, tables, f"round-{n}")
        vaults.append(vault)
        v = vault.select(F.col("scope_id").alias("v_scope"), F.col("type").alias("v_type"), F.col("canonical").alias("v_key"), "marker")
        marked = found.join(v, (F.col("type") == F.col("v_type")) & (F.col("key") == F.col("v_key")) & _same(F.col("scope"), F.col("v_scope")))
        marked = marked.groupBy("row").agg(F.collect_list(F.struct("form", "pos", "marker")).alias("marks")).withColumnRenamed("row", "m_row")
        done = rows.join(marked, F.col("row") == F.col("m_row"), "left").drop("m_row")
        for k, (_, pattern, group, _) in enumerate(forms):
            done = done.withColumn(f"m{k}", _of_form(k))
            done = done.withColumn("text", F.when(F.size(f"m{k}") > 0, _rewritten(F.col("text"), pattern, group, _at(f"m{k}"))).otherwise(F.col("text")))
        rows = tables.write(done.select(*rows.columns), f"rows-{n + 1}")
        tables.drop(f"rows-{n}", f"hits-{n}", f"round-{n}-ranges")
    out = rows.select(*(F.col("text") if c == f"c{calls.columns.index('text')}" else F.col(c) for c in own.columns))
    out = own.filter(~may).union(out).toDF(*calls.columns)
    if known is not None:
        k = known.select("scope_id", "type", "ordinal", "marker", "original", "canonical")
        used = reduce(DataFrame.unionByName, vaults).select(F.col("scope_id").alias("u_scope"), F.col("type").alias("u_type"), F.col("ordinal").alias("u_ordinal"))
        vaults.append(k.join(used, (F.col("type") == F.col("u_type")) & (F.col("ordinal") == F.col("u_ordinal")) & _same(F.col("scope_id"), F.col("u_scope")), "left_anti"))
    return out, reduce(DataFrame.unionByName, vaults)


def counts(vault: DataFrame) -> DataFrame:
    """(scope_id, type, n): distinct values of each type; types without any are left out."""
    return vault.groupBy("scope_id", "type").agg(F.count("*").alias("n"))


def has_personal_data(calls: DataFrame, vault: DataFrame) -> DataFrame:
    """(scope_id, found) of every scope."""
    known = vault.select(F.col("scope_id").alias("v_scope")).distinct().withColumn("found", F.lit(True))
    return calls.select("scope_id").distinct().join(known, _same(F.col("scope_id"), F.col("v_scope")), "left").select("scope_id", F.coalesce("found", F.lit(False)).alias("found"))


#: A marker as models write it: any case, spaces inside the brackets, or no brackets.
_LOOSE = r"(?iU)\[\s*(?:EMAIL|TELEFONE|CPF|RG)_\d+\s*\]|\b(?:EMAIL|TELEFONE|CPF|RG)_\d+\b"


def restore(replies: DataFrame, vault: DataFrame) -> DataFrame:
    """replies (scope_id, seq, text, ...) with markers turned back into the first-seen values; unknown markers stay.

    One pass over each text: a restored value is never searched again. The values a reply needs come by a join on the
    markers it has, not on its scope's whole vault; replies without a marker stay where they are. Null scopes are one scope,
    as in `anonymize`; of several values of one marker the least counts; further columns of any name are kept.
    """
    own = replies.toDF(*(f"c{k}" for k in range(len(replies.columns))))
    scope, seq, text = (F.col(f"c{replies.columns.index(c)}") for c in ("scope_id", "seq", "text"))
    may = F.coalesce(text.rlike(_LOOSE), F.lit(False))
    tokens = hits(text, _LOOSE)
    named = lambda x: F.concat(F.lit("["), F.upper(F.regexp_replace(x, r"(?U)[\[\]\s]", "")), F.lit("]"))
    some = own.filter(may)
    needed = some.select(scope.alias("scope"), seq.alias("seq"), F.explode(F.array_distinct(F.transform(tokens, named))).alias("marker"))
    v = vault.select(F.col("scope_id").alias("v_scope"), F.col("marker").alias("v_marker"), "original")
    values = needed.distinct().join(v, (F.col("marker") == F.col("v_marker")) & _same(F.col("scope"), F.col("v_scope"))).groupBy("scope", "seq", "marker").agg(F.min("original").alias("original"))
    values = values.groupBy("scope", "seq").agg(F.map_from_entries(F.collect_list(F.struct("marker", "original"))).alias("values"))
    cut = some.join(values, _same(scope, F.col("scope")) & _same(seq, F.col("seq")), "left").withColumn("gaps", gaps(text, _LOOSE)).withColumn("hits", tokens)
    new = F.when(F.col("values").isNull(), text).otherwise(joined(F.col("gaps"), F.transform(F.col("hits"), lambda x: F.coalesce(F.col("values")[named(x)], x))))
    at = f"c{replies.columns.index('text')}"
    done = cut.select(*(new.alias(c) if c == at else F.col(c) for c in own.columns))
    return own.filter(~may).union(done).toDF(*replies.columns)


def reserved_markers(calls: DataFrame) -> DataFrame:
    """Audit: calls whose text already holds a marker before anonymisation, which a new value may come to share."""
    return calls.filter(F.col("text").rlike(P.MARKER)).select("scope_id", "seq", hits(F.col("text"), P.MARKER).alias("markers"))


def cache_keys(calls: DataFrame) -> DataFrame:
    """calls with `cache_key`, the SHA-256 of the text. Of anonymised calls it serves as the key of an embedding or answer
    cache: texts that differ in their values only share it within a scope, and no value can be read from it."""
    return calls.withColumn("cache_key", F.sha2(F.coalesce("text", F.lit("")), 256))
