"""The scalar rules as SQL functions of a session, so that SQL users need no Python. Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import patterns as P

_BODIES = {
    "mask_email": ("regexp_replace(x, {0}, '[E-MAIL]')", P.EMAIL),
    "mask_cpf": ("regexp_replace(x, {0}, '***.$1.$2-**')", P.CPF_PARTS),
    "mask_cpf_bare": ("regexp_replace(x, {0}, '$1***.$2.$3-**')", P.CPF_BARE_PARTS),
    "mask_rg": ("regexp_replace(x, {0}, '$1XXXXXX')", P.RG_PARTS),
    "mask_issue_date": ("regexp_replace(x, {0}, '$1 XX/XX/XXXX')", P.ISSUE_DATE),
    "mask_sei_number": ("regexp_replace(x, {0}, 'XXXXX$1')", P.SEVEN_DIGITS),
    "mask_crc": ("regexp_replace(x, {0}, 'XXXXXXXX')", P.CRC),
    "digits_of": ("regexp_replace(x, {0}, '')", r"(?U)\D"),
}


def register(spark: SparkSession, prefix: str = "velado_") -> list[str]:
    """Creates temporary functions of one string each and returns their names."""
    for name, (body, pattern) in _BODIES.items():
        literal = "r'" + pattern.replace("'", "''") + "'"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS STRING RETURN {body.format(literal)}")
    return [prefix + name for name in _BODIES]
