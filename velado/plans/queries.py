"""The engine's queries over the driver's tables, and the same in SQL that DuckDB runs.

The tables hold few values of the kinds that the engine looks for, so most queries derive their texts from keys, by one
expression that both engines read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import gazetteer as G
from ..functions import patterns as P
from ..functions.names import extract_names
from ..functions.phone import is_phone
from ..functions.segments import gaps, hits
from ..operators import batch, layout, text_mode
from ..operators import document_mode as D
from ..operators.document_mode import DocOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt to two tasks a core: their file has few bytes, and so few tasks, for the work done on a row."""
    return table(spark, sf_dir, "customer").repartition(2 * spark.sparkContext.defaultParallelism, K)


def re2(pattern: str) -> str:
    """The pattern as RE2 writes it; Unicode classes make no difference on the texts here."""
    for java, other in (("(?iUd)", "(?i)"), ("(?iU:", "(?i:"), ("(?Ud)", ""), ("(?iU)", "(?i)"), ("(?U)", "")):
        pattern = pattern.replace(java, other)
    pattern = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)
    return "'" + pattern.replace("'", "''") + "'"


def pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


EMAIL, PHONE = re2(P.EMAIL), re2(P.PHONE)
K = "c_custkey"
CPF = f"{pad(K + ' % 1000', 3)} || '.' || {pad(K + ' * 7 % 1000', 3)} || '.' || {pad(K + ' * 13 % 1000', 3)} || '-' || {pad(K + ' % 100', 2)}"
BARE = f"{pad(K + ' * 7919 % 1000000', 6)} || {pad(K + ' % 100000', 5)}"

# E-mails in documents ------------------------------------------------------------------------------------------------


@query(f"select doc_id, regexp_replace(text, {EMAIL}, '[E-MAIL]', 'g') as text_masked, len(regexp_extract_all(text, {EMAIL}))::bigint as n_emails from documents")
def mask_email(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", D.mask_emails(t).alias("text_masked"), F.size(hits(t, P.EMAIL)).cast("long").alias("n_emails"))


@query(f"select lang, count(*) as n_docs, sum(len(regexp_extract_all(text, {EMAIL})))::bigint as n_emails from documents group by lang")
def count_email_by_lang(spark, sf_dir):
    n = F.size(hits(F.col("text"), P.EMAIL))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).cast("long").alias("n_emails"))


@query(f"select doc_id, regexp_matches(text, {EMAIL}) or regexp_matches(text, {re2(P.CPF)}) or regexp_matches(text, {re2(P.CPF_BARE)}) as has_pii from documents")
def flag_docs_with_pii(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (t.rlike(P.EMAIL) | t.rlike(P.CPF) | t.rlike(P.CPF_BARE)).alias("has_pii"))


@query(f"select doc_id, len(regexp_extract_all(text, {PHONE}))::bigint as n_hits from documents where contains(text, '+1 (')")
def negative_us_phones(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").contains("+1 (")).select("doc_id", F.size(hits(F.col("text"), P.PHONE)).cast("long").alias("n_hits"))


# Masks on texts from keys --------------------------------------------------------------------------------------------


def masked(name: str, source: str, key: str, text: str, mask: Callable, pattern: str, replacement: str) -> None:
    def f(spark, sf_dir):
        return table(spark, sf_dir, source).selectExpr(key, f"{text} as text").select(key, mask(F.col("text")).alias("masked"))

    f.__name__ = name
    query(f"select {key}, regexp_replace({text}, {pattern}, '{replacement}', 'g') as masked from {source}")(f)


masked("mask_cpf_formatted", "customer", K, f"'titular ' || {CPF} || ', outro x' || {CPF}", lambda t: F.regexp_replace(t, P.CPF_PARTS, "***.$1.$2-**"), re2(P.CPF_PARTS), r"***.\1.\2-**")
masked("mask_cpf_bare", "customer", K, f"case {K} % 3 when 0 then 'CPF ' when 1 then 'cpf: ' else 'n. ' end || {BARE} || ' e CPF n.' || {BARE}", lambda t: F.regexp_replace(t, P.CPF_BARE_PARTS, "$1***.$2.$3-**"), re2(P.CPF_BARE_PARTS), r"\1***.\2.\3-**")
masked("mask_rg_doc", "orders", "o_orderkey", f"case o_orderkey % 4 when 0 then 'RG: ' when 1 then 'Identidade ' when 2 then 'rg n. ' else 'ref ' end || {pad('o_orderkey % 100', 2)} || '.345.678-9 SSP, fim'", D.mask_rgs, re2(P.RG_PARTS), r"\1XXXXXX")
masked("mask_issue_date", "orders", "o_orderkey", f"'Data de Expedição:  ' || {pad('o_orderkey % 28 + 1', 2)} || '/' || {pad('o_orderkey % 12 + 1', 2)} || '/2020 e 01/02/2020'", D.mask_issue_dates, re2(P.ISSUE_DATE), r"\1 XX/XX/XXXX")
masked("mask_sei_number", "orders", "o_orderkey", f"'SEI ' || {pad('o_orderkey * 37 % 10000000', 7)} || ' lote ' || {pad('o_orderkey % 1000000', 6)} || ' x' || {pad('o_orderkey % 10000000', 7)}", D.mask_sei_numbers, re2(P.SEVEN_DIGITS), r"XXXXX\1")
masked("mask_crc", "orders", "o_orderkey", f"'codigo ' || {pad('o_orderkey % 100000', 5)} || 'aF0 e ' || {pad('o_orderkey % 10000', 4)} || 'GGGG e ' || {pad('o_orderkey * 7919 % 100000000', 8)}", D.mask_crcs, re2(P.CRC), "XXXXXXXX")

#: One telephone-like hit a row; what stands around it decides.
NUMBER = f"'9' || {pad(K + ' * 7919 % 10000', 4)} || '-' || {pad(K + ' * 31 % 10000', 4)}"
PHONES = f"""case {K} % 12
  when 0 then 'Ligue (61) ' || {NUMBER} || ' hoje' when 1 then '0800 ' || '72' || {pad(K + ' % 100', 2)} || '-' || {pad(K + ' % 10000', 4)}
  when 2 then 'valor R$ ' || {NUMBER} when 3 then 'conforme Chamada n. ' || {pad(K + ' % 9000 + 1000', 4)} || '-' || {pad(K + ' % 10000', 4)}
  when 4 then 'periodo 20' || {pad(K + ' % 100', 2)} || '-19' || {pad(K + ' * 3 % 100', 2)} || ' fim' when 5 then 'em 01/09/2026 ou ' || {NUMBER}
  when 6 then 'proc. ' || {NUMBER} || '/2026' when 7 then 'ramal 19' || {pad(K + ' % 100', 2)} || ' ' || {pad(K + ' % 9000 + 1000', 4)} || ' ok'
  when 8 then '+55 (61) ' || {NUMBER} when 9 then 'tel 61 ' || {NUMBER} || '.'
  when 10 then 'fixo 3' || {pad(K + ' % 1000', 3)} || '-' || {pad(K + ' * 31 % 10000', 4)} else 'nenhum numero ' || {pad(K, 5)} end"""
_VALID = f"""
with t as (select {K}, {PHONES} as text from customer),
h as (select {K}, text, regexp_extract(text, {PHONE}) as hit from t),
c as (select *, strpos(text, hit) as p, regexp_replace(hit, '\\D', '', 'g') as d, trim(hit) as bare from h),
w as (select *, substr(text, greatest(p - 25, 1)::bigint, least(25, p - 1)::bigint) as ctx, substr(text, greatest(p - 10, 1)::bigint, (least(10, p - 1) + length(hit) + 10)::bigint) as near from c),
v as (select *, hit <> '' and not regexp_matches(bare, '^(0800|0300|\\(0800|\\(0300|\\+55 0800|\\+55 \\(0800)') and not regexp_matches(d, '^(0800|0300|550800|550300)')
    and not regexp_matches(ctx, {re2(P.MONEY_BEFORE)}) and not regexp_matches(ctx, {re2(P.ACT_BEFORE)}) and not regexp_matches(bare, {re2(P.YEARS)})
    and not regexp_matches(near, {re2(P.DATE_NEAR)}) and not contains(near, '/') and length(d) between 8 and 13 and not (length(d) = 8 and regexp_matches(d, '^(19|20)')) as valid from w)
"""


def phone_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(K, f"{PHONES} as text")


@query(f"{_VALID} select {K}, case when valid then 1 else 0 end::bigint as n_valid, case when hit <> '' then 1 else 0 end::bigint as n_hits from v")
def phone_validity(spark, sf_dir):
    t = phone_texts(spark, sf_dir).withColumn("g", gaps(F.col("text"), P.PHONE)).withColumn("h", hits(F.col("text"), P.PHONE))
    ok = F.filter(F.transform("h", lambda x, i: is_phone(x, i, F.col("g"), F.col("h"))), lambda b: b)
    return t.select(K, F.size(ok).cast("long").alias("n_valid"), F.size("h").cast("long").alias("n_hits"))


@query(f"{_VALID} select {K}, case when valid then replace(text, hit, '[TEL]') else text end as masked from v")
def mask_phone(spark, sf_dir):
    return D.mask_phones(phone_texts(spark, sf_dir), "text").withColumnRenamed("text", "masked")


_TERMS = ("Confidencial XYZ", "  ", "sigilo-a.b")
_FULL = f"""'Sr. u' || cast({K} % 211 as string) || '@ex.com tem fone (61) ' || {NUMBER} || ', CPF ' || {BARE} || ', ou ' || {CPF} || '; RG: 12.345.' || {pad(K + ' % 1000', 3)}
  || ' e Data de Expedição: 01/02/2003; doc ' || {pad(K + ' * 37 % 10000000', 7)} || ' cod ' || {pad(K + ' % 100000', 5)} || 'aF0. C o n f i d e n c i a l XYZ, sigilo -a.b'"""
_steps = f"regexp_replace(regexp_replace({_FULL}, {re2(P.tolerant(_TERMS[0]))}, '[REMOVIDO]', 'g'), {re2(P.tolerant(_TERMS[2]))}, '[REMOVIDO]', 'g')"
for _p, _r in ((P.EMAIL, "[E-MAIL]"), (P.PHONE, "[TEL]"), (P.CPF_PARTS, r"***.\1.\2-**"), (P.CPF_BARE_PARTS, r"\1***.\2.\3-**"), (P.RG_PARTS, r"\1XXXXXX"), (P.ISSUE_DATE, r"\1 XX/XX/XXXX"), (P.SEVEN_DIGITS, r"XXXXX\1"), (P.CRC, "XXXXXXXX")):
    _steps = f"regexp_replace({_steps}, {re2(_p)}, '{_r}', 'g')"


@query(f"select {K}, {_steps} as masked from customer")
def doc_mode_full(spark, sf_dir):
    texts = customers(spark, sf_dir).selectExpr(K, f"{_FULL} as masked")
    return D.mask(texts, "masked", DocOptions(termos_customizados=_TERMS))


_SPACED = f"case {K} % 5 when 0 then 'Alberto Silva' when 1 then 'A l b e r t o   S i l v a' when 2 then 'Alber-' || chr(10) || 'to Silva' when 3 then 'ALBERTO' || chr(10) || 'SILVA' else 'Alberta Silva' end || ' n. ' || cast({K} as string)"


@query(f"select {K}, regexp_replace({_SPACED}, {re2(P.tolerant('Alberto Silva'))}, '[REMOVIDO]', 'g') as masked from customer")
def custom_terms_tolerant(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_SPACED} as text").select(K, D.remove_terms(F.col("text"), ("Alberto Silva",)).alias("masked"))


# Names ---------------------------------------------------------------------------------------------------------------
#: First names as a caller passes them.
FIRST = ("Ana", "Antônio", "Carlos", "Érica", "João", "José", "Juliana", "Marcos", "Maria")
CANDIDATES = ("O proponente MARCOS ANTONIO", "A servidora Juliana Costa", "Relator: Carlos Eduardo", "São Paulo", "Universidade Maria", "José da Silva", "ana lima", "Maria", "Zoroastro Pereira", "Antônio C. de Souza", "  João   Pessoa ", "João Pessoa Neto", "Processo Ana Lima", "Érica de", "e")


def _pick(values: tuple[str, ...], key: str) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_NAME = _pick(CANDIDATES, K)
_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_NORM = "upper(strip_accents(trim({})))"
_SPLIT = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"


@query(f"select {K}, {_NORM.format(_NAME)} as normalized from customer")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_NAME} as x").select(K, C.normalize_text(F.col("x")).alias("normalized"))


@query(f"""
with t as (select {K}, {_SPLIT.format(_NAME)} as w from customer),
k as (select {K}, w, list_position(list_transform(w, lambda p: {_NORM.format("trim(p, ':,;.-– ')")} not in ('', {", ".join(f"'{x}'" for x in G.PREFIXES)})), true) as place from t)
select {K}, case when coalesce(place, 0) > 0 then trim(array_to_string(list_slice(w, place, len(w)), ' '), ':,;.-– ') else '' end as cleaned from k
""")
def clean_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_NAME} as x").select(K, C.clean_prefixes(F.col("x")).alias("cleaned"))


_IS_NAME = f"""len(w) >= 2 and length(bare) > 4 and norm not in ({", ".join(f"'{x}'" for x in G.PROTECTED)})
  and not list_has_any(string_split(norm, ' '), {_list(G.INSTITUTIONAL)}) and upper(strip_accents(w[1])) in ({", ".join(f"'{C.bare_upper(x)}'" for x in FIRST)})"""


@query(f"""
with t as (select {K}, {_SPLIT.format(_NAME)} as w from customer), b as (select {K}, w, array_to_string(w, ' ') as bare from t), n as (select *, upper(strip_accents(bare)) as norm from b)
select {K}, {_IS_NAME} as is_name from n
""")
def validate_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_NAME} as x").select(K, C.is_name(F.col("x"), FIRST).alias("is_name"))


_LONE = _pick(("JOSE MARIA", "Carlos Eduardo", "SAO PAULO", "Ana Processo", "MARIA EDITAL", "Zoroastro Lima"), K)


@query(f"""
with t as (select {K}, {_LONE} as x from customer), n as (select {K}, string_split(x, ' ') as w, x as bare, upper(x) as norm from t)
select {K}, case when {_IS_NAME} and not list_has_any(string_split(norm, ' '), {_list(G.FORBIDDEN)}) then bare else '' end as names from n
""")
def extract_names_by_shape(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"'em 2024, ' || {_LONE} || ', presente' as x").select(K, F.array_join(extract_names(F.col("x"), FIRST), ";").alias("names"))


_ANCHORED = _pick(("Interessado: O proponente Zeno Prates", "Dr. Ulisses Prado", "À consideração de Irma Vale", "assinado eletronicamente por Otto Reis", "Relatora: Brasil", "nada"), K)


@query(f"""
with t as (select {K}, {_ANCHORED} as x from customer),
m as (select {K}, coalesce(nullif(regexp_extract(x, {re2(P.ANCHORS[0])}, 1), ''), nullif(regexp_extract(x, {re2(P.ANCHORS[1])}, 1), ''), nullif(regexp_extract(x, {re2(P.ANCHORS[3])}, 1), ''), regexp_extract(x, {re2(P.ANCHORS[4])}, 1)) as c from t),
k as (select {K}, regexp_replace(c, '^O proponente ', '') as c from m)
select {K}, case when contains(c, ' ') and length(c) > 4 then c else '' end as names from k
""")
def extract_names_by_context(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_ANCHORED} as x").select(K, F.array_join(extract_names(F.col("x"), FIRST), ";").alias("names"))


_BEFORE_ID = _pick(("Otto Reis, portador do CPF 1", "Irma Vale, CPF nº 2", "Zeno Prates, matrícula 3", "Ada Luz, SIAPE 4", "Rio Branco, SIAPE 5", "Otto Reis, cargo 6"), K)


@query(f"""
with t as (select {K}, 'Em 2024. ' || {_BEFORE_ID} as x from customer), m as (select {K}, trim(regexp_extract(x, {re2(P.ANCHORS[2])}, 1)) as c from t)
select {K}, case when c <> '' and upper(c) not in ({", ".join(f"'{x}'" for x in G.PROTECTED)}) then c else '' end as names from m
""")
def extract_names_before_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"'Em 2024. ' || {_BEFORE_ID} as x").select(K, F.array_join(extract_names(F.col("x"), FIRST), ";").alias("names"))


_NAMED = f"{_pick(('Ana', 'JOSE', 'Carlos', 'Zoroastro'), K)} || ' ' || case when {K} % 4 = 1 then 'LIMA' else 'Lima' end || ' n. ' || cast({K} as string) || '; Dr. Ulisses Prado.'"


@query(f"select {K}, replace(replace(replace(replace({_NAMED}, 'Ana Lima', 'A. L.'), 'JOSE LIMA', 'J. L.'), 'Carlos Lima', 'C. L.'), 'Ulisses Prado', 'U. P.') as masked from customer")
def mask_names(spark, sf_dir):
    texts = customers(spark, sf_dir).selectExpr(K, f"{_NAMED} as masked")
    return D.mask(texts, "masked", DocOptions(nomes=True, email_tel=False, cpf=False, rg=False, doc_sei=False), FIRST)


@query(f"""
with t as (select {K}, list_filter({_SPLIT.format(_NAME)}, lambda w: upper(strip_accents(w)) not in ({", ".join(f"'{x}'" for x in G.INITIAL_STOPWORDS)})) as w from customer),
i as (select {K}, list_filter(list_transform(w, lambda p: case when length(p) <= 2 and (p[-1] = '.' or (p = upper(p) and p <> lower(p))) then case when p[-1] = '.' then p else p || '.' end when length(p) > 1 then upper(p[1]) || '.' end), lambda q: q is not null) as w from t)
select {K}, case when len(w) = 0 then '[N.I.]' else array_to_string(w, ' ') end as initials from i
""")
def initials(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(K, f"{_NAME} as x").select(K, C.initials(F.col("x")).alias("initials"))


# Reversible text mode ------------------------------------------------------------------------------------------------
#: Fifty scopes; one e-mail (in capitals on odd keys), telephone, CPF and RG a row, each recurring within a scope.
_CALL = f"""'De ' || case {K} % 2 when 0 then 'u' || cast({K} % 211 as string) || '@ex.com' else 'U' || cast({K} % 211 as string) || '@EX.COM' end || ', tel (61) 98' || {pad(K + ' % 89', 3)} || '-' || {pad(K + ' % 7', 4)}
  || '; doc ' || {pad(K + ' % 53', 3)} || '.222.333-44 e RG: ' || {pad(K + ' % 503', 7)}"""
_CALLS = f"select cast({K} % 50 as string) as scope_id, {K} as seq, {_CALL} as text from customer"
_KINDS = (("EMAIL", f"regexp_extract(text, {EMAIL})", "lower(v)"), ("TELEFONE", f"regexp_extract(text, {PHONE})", "regexp_replace(v, '\\D', '', 'g')"), ("CPF", f"regexp_extract(text, {re2(P.CPF)})", "regexp_replace(v, '\\D', '', 'g')"), ("RG", f"regexp_extract(text, {re2(P.RG)}, 1)", "upper(regexp_replace(v, '[^A-Za-z0-9]', '', 'g'))"))


def _text_mode_sql(calls: str, kinds=_KINDS) -> str:
    hits_ = " union all ".join(f"select scope_id, seq, '{k}' as type, v, {key} as canonical from (select scope_id, seq, {v} as v from calls) where v <> ''" for k, v, key in kinds)
    return f"""
with calls as ({calls}), hit as ({hits_}),
firsts as (select scope_id, type, canonical, min(seq) as f, arg_min(v, seq) as original from hit group by all),
vault as (select scope_id, type, row_number() over (partition by scope_id, type order by f) as ordinal, '[' || type || '_' || (row_number() over (partition by scope_id, type order by f)) || ']' as marker, original, canonical from firsts),
of_row as (select scope_id, seq, {", ".join(f"max(case when type = '{k}' then v end) as v_{k}, max(case when type = '{k}' then marker end) as m_{k}" for k, *_ in kinds)} from hit join vault using (scope_id, type, canonical) group by all),
done as (select calls.scope_id, calls.seq, {"".join("replace(" for _ in kinds)}text{"".join(f", coalesce(v_{k}, chr(1)), coalesce(m_{k}, ''))" for k, *_ in kinds)} as text from calls left join of_row using (scope_id, seq))
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).selectExpr(f"cast({K} % 50 as string) as scope_id", f"{K} as seq", f"{_CALL} as text")


@query(f"{_text_mode_sql(_CALLS)} select * from vault")
def text_mode_vault(spark, sf_dir):
    return text_mode.anonymize(_calls(spark, sf_dir))[1]


@query(f"{_text_mode_sql(_CALLS)} select * from done")
def text_mode_anonymize(spark, sf_dir):
    return text_mode.anonymize(_calls(spark, sf_dir))[0]


@query(f"{_text_mode_sql(_CALLS)}, r as (select of_row.scope_id, of_row.seq, {', '.join(f'(select original from vault where vault.scope_id = of_row.scope_id and marker = m_{k}) as o_{k}' for k, *_ in _KINDS)} from of_row) select scope_id, seq, 'De ' || o_EMAIL || ', tel ' || o_TELEFONE || '; doc ' || o_CPF || ' e RG: ' || o_RG as text from r")
def text_mode_restore(spark, sf_dir):
    rows, vault = text_mode.anonymize(_calls(spark, sf_dir))
    return text_mode.restore(rows, vault)


_VARIANTS = "case seq % 5 when 0 then '[EMAIL_1]' when 1 then '[email_1]' when 2 then '[ Email_1 ]' when 3 then 'EMAIL_1' else 'email_1' end || ' e [EMAIL_0]'"


@query(f"{_text_mode_sql(_CALLS)} select done.scope_id, seq, original || ' e [EMAIL_0]' as text from done join vault on vault.scope_id = done.scope_id and marker = '[EMAIL_1]'")
def text_mode_restore_llm_variants(spark, sf_dir):
    rows, vault = text_mode.anonymize(_calls(spark, sf_dir))
    return text_mode.restore(rows.selectExpr("scope_id", "seq", f"{_VARIANTS} as text"), vault)


@query(f"{_text_mode_sql(_CALLS)} select scope_id, type, count(*) as n from vault group by all")
def marker_counts(spark, sf_dir):
    return text_mode.counts(text_mode.anonymize(_calls(spark, sf_dir))[1])


@query(f"{_text_mode_sql(_CALLS)} select scope_id, true as found from done group by scope_id")
def personal_data_found(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return text_mode.has_personal_data(calls, text_mode.anonymize(calls)[1])


@query(f"{_text_mode_sql(_CALLS)} select scope_id, seq, text, true as same from done")
def idempotence_check(spark, sf_dir):
    """Anonymised texts, once more: no hit is left, so nothing changes (RG takes the marker's own text for no value)."""
    once = text_mode.anonymize(_calls(spark, sf_dir))[0]
    twice = text_mode.anonymize(once)[0]
    return once.join(twice.withColumnRenamed("text", "again"), ["scope_id", "seq"]).select("scope_id", "seq", "text", (F.col("text") == F.col("again")).alias("same"))


_NULL_SCOPES = f"select case when {K} % 3 = 0 then 'none' else cast({K} % 50 as string) end as scope_id, {K} as seq, {_CALL} as text from customer"


@query(f"{_text_mode_sql(_NULL_SCOPES)} select nullif(scope_id, 'none') as scope_id, seq, text from done")
def text_mode_null_scopes(spark, sf_dir):
    """A third of the calls without a scope: they are one scope, and none passes unmasked."""
    calls = customers(spark, sf_dir).selectExpr(f"case when {K} % 3 <> 0 then cast({K} % 50 as string) end as scope_id", f"{K} as seq", f"{_CALL} as text")
    return text_mode.anonymize(calls)[0]


@query(f"{_text_mode_sql(_CALLS)} select * from done")
def text_mode_resumed(spark, sf_dir):
    """The calls in two lots, the second with the vault of the first: markers as if they had been one."""
    calls = _calls(spark, sf_dir)
    half = table(spark, sf_dir, "customer").agg(F.expr(f"max({K}) div 2")).first()[0]
    first, vault = text_mode.anonymize(calls.filter(F.col("seq") <= half))
    second, _ = text_mode.anonymize(calls.filter(F.col("seq") > half), known=vault)
    return first.unionByName(second)


@query(f"{_text_mode_sql(_CALLS, _KINDS[:1])} select * from done")
def types_subset(spark, sf_dir):
    return text_mode.anonymize(_calls(spark, sf_dir), ("email", "nothing"))[0]


@query(f"{_text_mode_sql(_CALLS)} select sha256(text) as cache_key, count(*) as n from done group by all")
def cache_key_groups(spark, sf_dir):
    rows = text_mode.anonymize(_calls(spark, sf_dir))[0]
    return text_mode.cache_keys(rows).groupBy("cache_key").agg(F.count("*").alias("n"))


_TURNS = "select cast(conv_id as string) as scope_id, turn as seq, text || ' contato a' || cast((conv_id + turn) % 3 as string) || '@ex.com' as text from conversations"


@query(f"{_text_mode_sql(_TURNS, (('EMAIL', f'regexp_extract(text, {EMAIL})', 'lower(v)'),))} select * from done")
def multi_turn_scope(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as scope_id", "turn as seq", "text || ' contato a' || cast((conv_id + turn) % 3 as string) || '@ex.com' as text")
    return text_mode.anonymize(turns)[0]


# Layout --------------------------------------------------------------------------------------------------------------
#: A page for each order: a signature line on even keys, the authenticity phrase on keys that 3 divides, a number, a code.
_PAGES = "select cast(o_orderkey as string) as doc_id, 1 as page, 600.0::double as width, 800.0::double as height, o_orderkey as k from orders"
_PAGES_SPARK = ("cast(o_orderkey as string) as doc_id", "1 as page", "cast(600 as double) as width", "cast(800 as double) as height", "o_orderkey as k")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_PAGES_SPARK)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 20 points apart, words 10 points a letter; line and height follow from the key."""
    pages = _pages(spark, sf_dir)
    line = lambda no, y, text, keep="true": pages.filter(keep).selectExpr("doc_id", "page", f"{no} as line_no", f"cast({y} as double) as y", f"{text} as line")
    lines = line(1, "100", f"'numero ' || {pad('k * 37 % 10000000', 7)}")
    lines = lines.unionByName(line(2, "400 + k % 10", f"'{layout.SIGNED} X'", "k % 2 = 0"))
    lines = lines.unionByName(line(3, "500 + k % 10", f"'{layout.AUTHENTIC}'", "k % 3 = 0"))
    lines = lines.unionByName(line(4, "700", f"'ref ' || {pad('k * 41 % 10000000', 7)} || ' codigo ' || {pad('k % 100000', 5)} || 'aF0'"))
    w = lines.select("doc_id", "page", "line_no", "y", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    x0 = 50.0 + 100.0 * F.col("word_no")
    return w.select("doc_id", "page", "line_no", "word_no", x0.alias("x0"), F.col("y").alias("y0"), (x0 + 10.0 * F.length("text")).alias("x1"), (F.col("y") + 12.0).alias("y1"), "text")


@query(f"select doc_id, page, width - 25 as x0, 0::double as y0, width as x1, height as y1, 'barra_sei' as tipo from ({_PAGES})")
def layout_sidebar(spark, sf_dir):
    return layout.side_bars(_pages(spark, sf_dir)).drop("rotulo", "fill")


@query(f"select doc_id, page, 50::double - 60 as x0, (500 + k % 10 - 10)::double as y0, 50::double as x1, (500 + k % 10 + 52)::double as y1, 'qr_code' as tipo from ({_PAGES}) where k % 3 = 0")
def layout_qr(spark, sf_dir):
    return layout.qr_boxes(layout.page_texts(_words(spark, sf_dir))).drop("rotulo", "fill")


@query(f"""select doc_id, page, 150::double as x0, 700::double as y0, 220::double as x1, 712::double as y1, 'XXXXX' || right({pad('k * 41 % 10000000', 7)}, 2) as rotulo from ({_PAGES}) where (case when k % 2 = 0 then 400 + k % 10 else 680 end) < 700""")
def layout_sei_gate(spark, sf_dir):
    return layout.sei_numbers(layout.page_texts(_words(spark, sf_dir), _pages(spark, sf_dir))).select("doc_id", "page", "x0", "y0", "x1", "y1", "rotulo")


@query(f"select doc_id, page, 350::double as x0, 700::double as y0, 430::double as x1, 712::double as y1, 'XXXXXXXX' as rotulo from ({_PAGES}) where k % 3 = 0")
def layout_crc_gate(spark, sf_dir):
    return layout.crc_codes(layout.page_texts(_words(spark, sf_dir))).select("doc_id", "page", "x0", "y0", "x1", "y1", "rotulo")


_SEI = f"select doc_id, page, 150::double as x0, 700::double as y0, 220::double as x1, 712::double as y1, 'doc_sei' as tipo, 'XXXXX' || right({pad('k * 41 % 10000000', 7)}, 2) as rotulo, '' as fill from ({_PAGES}) where (case when k % 2 = 0 then 400 + k % 10 else 680 end) < 700"
_BARS = f"select doc_id, page, width - 25 as x0, 0::double as y0, width as x1, height as y1, 'barra_sei' as tipo, 'Barra Lateral SEI' as rotulo, '0,0,0' as fill from ({_PAGES})"
_QRS = f"select doc_id, page, 50::double - 60 as x0, (500 + k % 10 - 10)::double as y0, 50::double as x1, (500 + k % 10 + 52)::double as y1, 'qr_code' as tipo, 'QR Code SEI' as rotulo, '1,1,1' as fill from ({_PAGES}) where k % 3 = 0"
_CRCS = f"select doc_id, page, 350::double as x0, 700::double as y0, 430::double as x1, 712::double as y1, 'crc_sei' as tipo, 'XXXXXXXX' as rotulo, '0,0,0' as fill from ({_PAGES}) where k % 3 = 0"


def _plain_fill(fill):
    return F.coalesce(F.array_join(F.transform(fill, lambda x: x.cast("int").cast("string")), ","), F.lit("")).alias("fill")


@query(f"{_BARS} union all {_QRS} union all {_SEI} union all {_CRCS}")
def layout_plan(spark, sf_dir):
    """Every box of the plan, with its label and colour."""
    boxes, _ = layout.plan(_pages(spark, sf_dir), _words(spark, sf_dir))
    return boxes.select("doc_id", "page", "x0", "y0", "x1", "y1", "tipo", "rotulo", _plain_fill(F.col("fill")))


@query(f"""select doc_id, page, 49.5::double as x0, 99.5::double as y0, width + 0.5 as x1, 100.5 + h as y1, case when k % 2 = 0 then '1,1,1' else '0,0,0' end as fill, case when k % 2 = 0 then '***' end as text,
  case when k % 2 = 0 then case when h * 0.75 < 6 then 6 else round_even(h * 0.75, 1) end::double end as font_size from (select *, (1 + k % 20)::double / 2 + 4 as h from ({_PAGES}))""")
def layout_redactions(spark, sf_dir):
    """What a writer draws where masks are text: a label in white, or, on odd keys, a box of its own colour without text."""
    h = "cast(1 + k % 20 as double) / 2 + 4"
    boxes = _pages(spark, sf_dir).selectExpr("doc_id", "page", "cast(50 as double) as x0", "cast(100 as double) as y0", "width as x1", f"100 + {h} as y1", "'cpf' as tipo", "'***' as rotulo", "case when k % 2 = 1 then array(0D, 0D, 0D) end as fill")
    drawn = layout.redactions(boxes, "texto")
    return drawn.select("doc_id", "page", "x0", "y0", "x1", "y1", _plain_fill(F.col("fill")), "text", "font_size")


@query(f"select doc_id, page, k % 4 as kind from ({_PAGES}) where k % 4 = 3")
def annotation_cleanup(spark, sf_dir):
    """Kind 0 touches a box, kind 1 names a term, kind 2 does both, kind 3 neither."""
    p = _pages(spark, sf_dir).withColumn("kind", F.col("k") % 4)
    annots = p.selectExpr("doc_id", "page", "kind", "cast(case when kind in (0, 2) then 90 else 300 end as double) as x0", "cast(90 as double) as y0", "cast(case when kind in (0, 2) then 120 else 330 end as double) as x1", "cast(120 as double) as y1", "case when kind in (1, 2) then 'nota sobre FULANO ' || doc_id else 'publica' end as content", "'' as title", "cast(null as string) as subject")
    boxes = p.selectExpr("doc_id", "page", "cast(100 as double) as x0", "cast(100 as double) as y0", "cast(150 as double) as x1", "cast(110 as double) as y1")
    terms = p.selectExpr("doc_id", "'Fulano ' || doc_id as term")
    return layout.kept_annotations(annots, boxes, terms).select("doc_id", "page", "kind")


@query(f"select doc_id, '' as author, 'Relatorio de []' as title, 'v' || (k % 10) as producer from ({_PAGES})")
def metadata_scrub(spark, sf_dir):
    p = _pages(spark, sf_dir)
    meta = p.selectExpr("doc_id", "map('author', 'Fulano', 'title', 'Relatorio de Fulano, ' || doc_id || '@ex.com;', 'subject', cast(null as string), 'producer', 'v' || cast(k % 10 as string)) as meta")
    # Of the term [E-MAIL] its bare word goes, the brackets stay.
    clean = layout.scrubbed_metadata(meta, p.selectExpr("doc_id", "'Fulano de Tal' as term").unionByName(p.selectExpr("doc_id", "'[E-MAIL]' as term")))
    return clean.select("doc_id", *(F.col("meta")[k].alias(k) for k in ("author", "title", "producer")))


_EXT = _pick(("pdf", "txt", "docx", "odt", "TXT"), K)


@query(f"select status, count(*) as n from (select case {_EXT} when 'odt' then 'failed' when 'pdf' then 'skipped' else 'ok' end as status from customer) group by status")
def batch_status(spark, sf_dir):
    from ..sources import files as S

    paths = table(spark, sf_dir, "customer").selectExpr(f"'/lote/a.b/' || cast({K} as string) || '.' || {_EXT} as path").withColumn("ext", S.extension(F.col("path"))).withColumn("supported", F.col("ext").isin(*S.SUPPORTED))
    return batch.summary(batch.statuses(paths))


# Files and streams ---------------------------------------------------------------------------------------------------


@query(f"select 'f' || {K} || '.txt' as path, 'linha ' || {K} || chr(10) || 'cpf ' || regexp_replace({CPF}, {re2(P.CPF_PARTS)}, '***.\\1.\\2-**') || chr(10) || 'fim' as text from customer")
def txt_files(spark, sf_dir):
    """Bytes with mixed line ends, read as TXT files and masked."""
    from ..sources import files as S

    raw = f"encode('linha ' || {K} || chr(13) || chr(10) || 'cpf ' || {CPF} || chr(13) || 'fim', 'UTF-8')"
    files = table(spark, sf_dir, "customer").selectExpr(f"'f' || {K} || '.txt' as path", f"{raw} as content", "'txt' as ext")
    return D.mask(S.txt(files), "text")


@query(f"select 'f' || {K} || '.docx' as path, n::integer as para_no, n = 1 as in_table, case n when 0 then 'u' || {K} || ' [E-MAIL]' else 'celula ' || {K} end as text from customer, unnest([0, 1]) as x(n)")
def docx_paragraphs(spark, sf_dir):
    """A DOCX file for each customer, made on the fly: a body paragraph and a table cell, each masked on its own."""
    import io
    import zipfile

    import pandas as pd

    from ..sources import files as S

    w = S.W.strip("{}")

    def make(parts):
        for part in parts:
            rows = []
            for k in part[K]:
                p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
                xml = f'<w:document xmlns:w="{w}"><w:body>{p(f"u{k} u{k}@ex.com")}<w:tbl><w:tr><w:tc>{p(f"celula {k}")}</w:tc></w:tr></w:tbl></w:body></w:document>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", xml)
                rows.append((f"f{k}.docx", out.getvalue(), "docx"))
            yield pd.DataFrame(rows, columns=["path", "content", "ext"])

    files = table(spark, sf_dir, "customer").select(K).mapInPandas(make, "path string, content binary, ext string")
    return D.mask(S.docx(files), "text")


@query(f"{_text_mode_sql(_CALLS)} select * from done")
def stream_sessions(spark, sf_dir):
    """The calls as a stream, in one run of all that is there; markers as in the batch form."""
    from ..streaming.sessions import anonymize_stream
    from .cut import scratch

    at = scratch(spark, "stream")
    _calls(spark, sf_dir).selectExpr("scope_id", "cast(seq as long) as seq", "text").write.parquet(f"{at}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        calls = spark.readStream.schema("scope_id string, seq long, text string").parquet(f"{at}/in")
        q = anonymize_stream(calls).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("scope_id string, seq long, text string").parquet(f"{at}/out")
