"""Irreversible masking of whole texts: one chain of column expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.names import extract_names, replace_names
from ..functions.phone import is_phone
from ..functions.segments import rewrite, spare


@dataclass(frozen=True)
class DocOptions:
    """What to mask, and how. `mode` of PDF boxes is "tarja_preta", "tarja_branca", or anything else for masking text."""

    cpf: bool = True
    rg: bool = True
    email_tel: bool = True
    doc_sei: bool = True
    qr_code: bool = True
    links: bool = True
    nomes: bool = False
    modo_nomes: str = "iniciais"
    termos_customizados: tuple[str, ...] = field(default=())
    modo_redacao_pdf: str = "tarja_preta"
    sanitizar_metadados: bool = True
    redigir_imagens: bool = False
    limpar_anotacoes: bool = True

    @classmethod
    def of(cls, options: dict | None) -> DocOptions:
        """From a dictionary; unknown keys are ignored."""
        given = {k: tuple(v or ()) if k == "termos_customizados" else v for k, v in (options or {}).items() if k in cls.__dataclass_fields__}
        return cls(**given)


def term_list(lines: str) -> tuple[str, ...]:
    """Terms as users type them: one a line, blanks dropped."""
    return tuple(t for t in map(str.strip, lines.split("\n")) if t)


def remove_terms(text: Column, terms: tuple[str, ...]) -> Column:
    for pattern in filter(None, map(P.tolerant, terms)):
        text = F.regexp_replace(text, pattern, "[REMOVIDO]")
    return text


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, P.EMAIL, "[E-MAIL]")


def mask_phones(df: DataFrame, column: str) -> DataFrame:
    return rewrite(df, column, P.PHONE, lambda hit, i, gaps, hits: F.when(is_phone(hit, i, gaps, hits), "[TEL]").otherwise(hit))


def mask_cpfs(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, P.CPF_PARTS, "***.$1.$2-**"), P.CPF_BARE_PARTS, "$1***.$2.$3-**")


def mask_rgs(text: Column) -> Column:
    return F.regexp_replace(text, P.RG_PARTS, "$1XXXXXX")


def mask_issue_dates(text: Column) -> Column:
    return F.regexp_replace(text, P.ISSUE_DATE, "$1 XX/XX/XXXX")


def mask_sei_numbers(text: Column) -> Column:
    return F.regexp_replace(text, P.SEVEN_DIGITS, "XXXXX$1")


def mask_crcs(text: Column) -> Column:
    return F.regexp_replace(text, P.CRC, "XXXXXXXX")


def mask(df: DataFrame, text_col: str = "text", options: DocOptions = DocOptions(), first_names: Column | Iterable[str] | None = None) -> DataFrame:
    """df with its text column masked: terms, names, e-mails, telephones, CPFs, RGs and issue dates, seven-digit numbers and
    codes, in this order, each on what the one before left. Null stays null, blank texts stay as they are, and so do all
    other columns, whatever their names.

    first_names must be given where `nomes` is set: names found by shape alone begin with one of them; () leaves the names
    that a phrase anchors. Each step is a column, not one nested expression, which would repeat what it uses more than once.
    No shuffle.
    """
    own, found = spare(df, "_text", "_names")
    out = df.withColumn(own, remove_terms(df[text_col], options.termos_customizados))
    text = F.col(own)
    if options.nomes:
        if first_names is None:
            raise ValueError("masking names needs first_names; () masks only those that a phrase anchors")
        out = out.withColumn(found, extract_names(text, first_names)).withColumn(own, replace_names(text, F.col(found), options.modo_nomes)).drop(found)
    if options.email_tel:
        out = mask_phones(out.withColumn(own, mask_emails(text)), own)
    if options.cpf:
        out = out.withColumn(own, mask_cpfs(text))
    if options.rg:
        out = out.withColumn(own, mask_issue_dates(mask_rgs(text)))
    if options.doc_sei:
        out = out.withColumn(own, mask_crcs(mask_sei_numbers(text)))
    blank = F.col(text_col).rlike(r"(?U)^\s*$")
    return out.withColumn(text_col, F.when(blank, F.col(text_col)).otherwise(text)).drop(own)
