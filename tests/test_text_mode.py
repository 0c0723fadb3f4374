import random

import pytest
from pyspark.sql import functions as F

from velado.operators import text_mode as T
from velado.plans.cut import Tables
from velado.streaming.python_rules import Session


def calls(spark, rows):
    return spark.createDataFrame([(s, q, t) for s, q, t in rows], "scope_id string, seq long, text string")


def run(spark, rows, types=T.TYPES):
    out, vault = T.anonymize(calls(spark, rows), types)
    return {(r.scope_id, r.seq): r.text for r in out.collect()}, {(r.scope_id, r.marker): r.original for r in vault.collect()}


def test_one_marker_a_value(spark):
    texts, vault = run(spark, [("a", 1, "joao.silva@cnpq.br ou JOAO.SILVA@CNPQ.BR e maria@cnpq.br e joao.silva@cnpq.br"), ("b", 1, "outro@x.org")])
    assert texts["a", 1] == "[EMAIL_1] ou [EMAIL_1] e [EMAIL_2] e [EMAIL_1]"
    assert vault == {("a", "[EMAIL_1]"): "joao.silva@cnpq.br", ("a", "[EMAIL_2]"): "maria@cnpq.br", ("b", "[EMAIL_1]"): "outro@x.org"}


@pytest.mark.parametrize(
    "text",
    ["Processo 01300.012345/2026-11", "no periodo 2026-2030", "valor de R$ 1.234,56", "Chamada 10/2026", "em 01/09/2026", "dia 2026-09-30", "ligue 0800 722 7222", "ligue 0800-722-7222", "numero 98765432100 sem contexto"],
)
def test_false_positives_stay(spark, text):
    assert run(spark, [("a", 1, text)]) == ({("a", 1): text}, {})


def test_cpfs_number_formatted_ones_first(spark):
    texts, vault = run(spark, [("a", 1, "CPF 55566677788 e 111.222.333-44, de novo CPF: 11122233344")])
    assert texts["a", 1] == "CPF [CPF_2] e [CPF_1], de novo CPF: [CPF_1]"
    assert vault["a", "[CPF_2]"] == "55566677788"


def test_phones_and_rg(spark):
    texts, _ = run(spark, [("a", 1, "+55 (61) 98765-4321 e 61 98765-4321, fixo 3333-4444. RG do solicitante: RG: 12.345.678-9 SSP.")])
    assert texts["a", 1] == "[TELEFONE_1] e [TELEFONE_1], fixo [TELEFONE_2]. RG [RG_1]: RG: [RG_2]."


def test_restore_takes_what_models_write(spark):
    out, vault = T.anonymize(calls(spark, [("a", 1, "carlos@empresa.com, (61) 99888-7777")]))
    reply = "[EMAIL_1] [email_1] [ Email_1 ] EMAIL_1 email_1 [EMAIL_99] [TELEFONE_1] XEMAIL_1"
    got = T.restore(calls(spark, [("a", 2, reply), ("b", 1, "[EMAIL_1]"), ("a", 3, None)]), vault)
    found = {(r.scope_id, r.seq): r.text for r in got.collect()}
    assert found["a", 2] == "carlos@empresa.com " * 5 + "[EMAIL_99] (61) 99888-7777 XEMAIL_1"
    assert found["b", 1] == "[EMAIL_1]" and found["a", 3] is None


def test_types_nulls_and_empty(spark):
    texts, vault = run(spark, [("a", 1, "x@y.com 111.222.333-44"), ("a", 2, None), ("a", 3, "")], ("email",))
    assert texts == {("a", 1): "[EMAIL_1] 111.222.333-44", ("a", 2): None, ("a", 3): ""} and len(vault) == 1
    assert run(spark, [("a", 1, "x@y.com")], ()) == ({("a", 1): "x@y.com"}, {})
    assert run(spark, []) == ({}, {})


def test_reserved_markers(spark):
    assert [r.markers for r in T.reserved_markers(calls(spark, [("a", 1, "ja [EMAIL_1] e [ rg_2 ]"), ("a", 2, "nada")])).collect()] == [["[EMAIL_1]", "[ rg_2 ]"]]


PIECES = ["a@b.co", "A@B.CO", "u_1@x.org", " ", "  ", "\n", ", ", "/", "61 ", "(61) ", "+55 ", "91234-5678", "3456 7890", "2020-1999", "R$ ", "Lei ", "Edital nº ", "CPF ", "CPF: ", "cpf n. ", "12345678901", "123.456.789-01", "RG ", "RG: ", "Identidade ", "12.345", "x9", "fim", "é", "[EMAIL_1]", "0800 ", "12/03/2024", "٣٤٥٦-1234"]


def test_columns_equal_plain_python(spark):
    """Random texts in several scopes: the set-oriented passes give what one text after another gives."""
    rnd = random.Random(7)
    rows = [(f"s{k % 7}", k, "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14)))) for k in range(400)]
    texts, vault = run(spark, rows)
    sessions = {}
    want = {(s, q): sessions.setdefault(s, Session()).anonymize(t) for s, q, t in rows}
    assert {k: (texts[k], want[k]) for k in want if texts[k] != want[k]} == {}
    assert vault == {(s, m): v for s, x in sessions.items() for m, v in x.known.values()}
    restored = T.restore(calls(spark, [(s, q, t) for (s, q), t in texts.items()]), T.anonymize(calls(spark, rows))[1])
    assert restored.filter(F.col("text").rlike(r"\[CPF_\d+\]")).count() == 0


def test_numbering_across_ranges(spark):
    """One scope in several sorted ranges: its values are still 1, 2, 3 ... in order."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        first = spark.range(500).selectExpr("'EMAIL' as type", "case when id < 450 then 'hot' else cast(id % 3 as string) end as scope", "cast(id as string) as key", "named_struct('seq', (id * 7919) % 500, 'form', 0, 'pos', 0, 'value', 'v') as first")
        got = T._numbered(first, Tables(spark, "t"), "ranges")
        rows = got.collect()
    finally:
        spark.conf.set(key, before)
    for scope in ("hot", "0", "1", "2"):
        own = sorted((r.first.seq, r.ordinal) for r in rows if r.scope == scope)
        assert [o for _, o in own] == list(range(1, len(own) + 1))


def test_null_and_repeated_keys(spark):
    """Rows of null scope, null seq or a repeated place are masked like any other, and restored."""
    rows = [(None, 1, "a@b.co CPF 111.222.333-44"), (None, None, "z@b.co e A@B.CO"), ("s", None, "x@y.co"), ("s", 1, "w@y.co"), ("s", 1, "v@y.co, x@y.co"), ("s", 1, "v@y.co, x@y.co"), ("s", 2, None)]
    out, vault = T.anonymize(calls(spark, rows))
    got = sorted((r.scope_id or "", r.seq or 0, r.text or "") for r in out.collect())
    assert got == sorted([("", 1, "[EMAIL_2] CPF [CPF_1]"), ("", 0, "[EMAIL_1] e [EMAIL_2]"), ("s", 0, "[EMAIL_1]"), ("s", 1, "[EMAIL_3]"), ("s", 1, "[EMAIL_2], [EMAIL_1]"), ("s", 1, "[EMAIL_2], [EMAIL_1]"), ("s", 2, "")])
    assert {(r.scope_id, r.marker): r.original for r in vault.filter("scope_id is null").collect()} == {(None, "[EMAIL_1]"): "z@b.co", (None, "[EMAIL_2]"): "A@B.CO", (None, "[CPF_1]"): "111.222.333-44"}
    back = sorted((r.scope_id or "", r.seq or 0, (r.text or "").lower()) for r in T.restore(out, vault).collect())
    assert back == sorted((s or "", q or 0, (t or "").lower()) for s, q, t in rows)
    assert {(r.scope_id, r.found) for r in T.has_personal_data(calls(spark, [*rows, ("q", 1, "nada")]), vault).collect()} == {(None, True), ("s", True), ("q", False)}


def test_clashing_columns_stay(spark):
    names = ["_gaps", "_hits", "_values", "_m0", "_text", "row", "scope", "marks", "c0", "m0", "values", "marker"]
    df = spark.createDataFrame([("s", 1, "a@b.co", *names)], "scope_id string, seq long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out, vault = T.anonymize(df)
    assert out.columns == df.columns and tuple(out.first()) == ("s", 1, "[EMAIL_1]", *names)
    back = T.restore(out, vault)
    assert back.columns == df.columns and tuple(back.first()) == ("s", 1, "a@b.co", *names)


def test_numbering_goes_on_from_a_vault(spark):
    _, vault = T.anonymize(calls(spark, [("s", 1, "a@b.co c@d.co"), (None, 1, "n@b.co")]))
    out, both = T.anonymize(calls(spark, [("s", 1, "e@f.co C@D.CO (61) 3211-1234"), (None, 1, "m@b.co"), ("t", 1, "a@b.co")]), known=vault)
    assert {(r.scope_id, r.text) for r in out.collect()} == {("s", "[EMAIL_3] [EMAIL_2] [TELEFONE_1]"), (None, "[EMAIL_2]"), ("t", "[EMAIL_1]")}
    assert sorted((r.scope_id or "", r.marker, r.original) for r in both.collect()) == [("", "[EMAIL_1]", "n@b.co"), ("", "[EMAIL_2]", "m@b.co"), ("s", "[EMAIL_1]", "a@b.co"), ("s", "[EMAIL_2]", "c@d.co"), ("s", "[EMAIL_3]", "e@f.co"), ("s", "[TELEFONE_1]", "(61) 3211-1234"), ("t", "[EMAIL_1]", "a@b.co")]


def test_rg_takes_a_space_behind(spark):
    texts, vault = run(spark, [("a", 1, "RG 1234 .")])
    assert texts["a", 1] == "RG [RG_1]." and vault["a", "[RG_1]"] == "1234 "


def test_texts_without_hits_are_not_shuffled(spark):
    out, _ = T.anonymize(calls(spark, [("a", k, f"nada {k}") for k in range(20)]))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
