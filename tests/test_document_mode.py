import random

import pytest
from pyspark.sql import functions as F

from velado.functions import canonical as C
from velado.functions import names as N
from velado.functions import patterns as P
from velado.functions.sql import register
from velado.operators.document_mode import DocOptions, mask, term_list


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*(F.col(n) for n in names)).alias("x")).first().x


#: First names as a caller passes them.
NAMES = ["José", "MARIA", "Ana", "ana ", "", None]


def masked(spark, text, **options):
    """Beside columns that are named like the operator's own, which stay."""
    names = ["_text", "_gaps", "_hits", "_names", "_GAPS_"]
    df = spark.createDataFrame([(text, *names)], "text string, " + ", ".join(f"`{n}` string" for n in names))
    out = mask(df, "text", DocOptions.of(options), NAMES)
    assert out.columns == df.columns and tuple(out.first())[1:] == tuple(names)
    return out.first().text


def test_every_rule(spark):
    text = "Sr. Zé z@x.org (61) 3211-1234, CPF: 123.456.789-00 e CPF 12345678900, RG: 12.345.678-9 SSP Data de Expedição:  01/02/2003 doc 1234567 cod 12AbCdEf"
    assert masked(spark, text) == "Sr. Zé [E-MAIL] [TEL], CPF: ***.456.789-** e CPF ***.456.789-**, RG: XXXXXX Data de Expedição: XX/XX/XXXX doc XXXXX67 cod XXXXXXXX"
    assert masked(spark, text, cpf=False, rg=False, email_tel=False, doc_sei=False, unknown=1) == text


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_blank_stays(spark, text):
    assert masked(spark, text, nomes=True, termos_customizados=["x"]) == text


def test_known_leaks_are_kept_as_they_are(spark):
    assert masked(spark, "RG nº: 1234", doc_sei=False) == "RG XXXXXXº: 1234"
    assert masked(spark, "CPF nº: 12345678901", doc_sei=False) == "CPF nº: 12345678901"


def test_term_list():
    assert term_list(" a b \n\n  \nc\r") == ("a b", "c")


def test_terms_and_names(spark):
    text = "Termo: C o n f i d e n c i a l XYZ\nInteressado: O proponente MARCOS ANTONIO\nA l b e r t o Silva; Brasília"
    got = masked(spark, text, nomes=True, termos_customizados=["Confidencial XYZ", " ", ""])
    assert got == "Termo: [REMOVIDO]\nInteressado: O proponente M. A.\nA l b e r t o Silva; Brasília"
    assert "[NOME]" in masked(spark, text, nomes=True, modo_nomes="total")


@pytest.mark.parametrize("text", ["A  l  b  e  r  t  o   S  i  l  v  a", "Alber-\nto Silva", "ALBERTO\nSILVA", "Alberto Silva"])
def test_tolerant_term(spark, text):
    pattern = P.tolerant("Alberto Silva")
    assert one(spark, lambda t: F.regexp_replace(t, pattern, "#"), f"x {text} y") == "x # y"
    assert one(spark, lambda t, n: F.regexp_replace(t, P.tolerant_col(n), F.lit("#")), f"x {text} y", "Alberto Silva") == "x # y"


def test_tolerant_quotes(spark):
    assert P.tolerant("  ") is None and P.tolerant(None) is None
    for term in ("Nota Técnica nº 123/2026", "a.b*c [x] $1 \\d"):
        assert one(spark, lambda t: F.regexp_replace(t, P.tolerant(term), "#"), f"({term})") == "(#)"  # noqa: B023
        assert one(spark, lambda t, n: F.regexp_replace(t, P.tolerant_col(n), F.lit("#")), f"({term})", term) == "(#)"


@pytest.mark.parametrize(("raw", "want"), [("O proponente MARCOS ANTONIO", "MARCOS ANTONIO"), ("A servidora Juliana Costa", "Juliana Costa"), ("Relator: Carlos Eduardo", "Carlos Eduardo"), ("À do de", ""), ("", ""), ("Porto Ana Lima.", "Ana Lima")])
def test_prefixes(spark, raw, want):
    # "À" and its like are compared without accents, so they are "A".
    assert one(spark, C.clean_prefixes, raw) == want


@pytest.mark.parametrize("name", ["São Paulo", "Rio de Janeiro", "Universidade Maria", "Maria", "Zoroastro Pereira", "Edital José Silva", "", None])
def test_no_names(spark, name):
    assert one(spark, lambda n: C.is_name(n, NAMES), name) is False


def test_names_and_own_list(spark):
    assert one(spark, lambda n: C.is_name(n, NAMES), " José  da Silva ") is True
    assert one(spark, lambda n: C.is_name(n, F.array(F.lit("ZOROASTRO"))), "Zoroastro Pereira") is True
    text = "Assinado eletronicamente por Otto Reis, em 3/4\nRelatora: Universidade Federal\nANA MARIA LIMA chegou\nDr. Ulisses Prado. Maria Clara Souza"
    assert one(spark, lambda t: F.array_join(N.extract_names(t, NAMES), "|"), text) == "ANA MARIA LIMA|Maria Clara Souza|Otto Reis|Ulisses Prado"


@pytest.mark.parametrize(("name", "want"), [("Ana Clara de Souza", "A. C. S."), ("J. R Tolkien", "J. R. T."), ("de da", "[N.I.]"), ("x ana", "A."), ("Érica e Íris", "É. Í.")])
def test_initials(spark, name, want):
    assert one(spark, C.initials, name) == want


def test_normalize(spark):
    assert one(spark, C.normalize_text, "  ação nº ½ ªé ") == "ACAO NO 1⁄2 AE"
    assert one(spark, C.normalize_text, None) == ""


def test_cpf_and_number_masks(spark):
    assert one(spark, C.mask_cpf, "123.456.789-00") == "***.456.789-**" and one(spark, C.mask_cpf, "12") == "***.***.***-**"
    assert one(spark, C.mask_seven_digits, "1234567") == "XXXXX67" and one(spark, C.mask_seven_digits, "1") == "XXXXXXX"


def test_sql_functions(spark):
    names = register(spark)
    assert "velado_mask_cpf" in names
    r = spark.sql("select velado_mask_cpf('x 123.456.789-00') a, velado_mask_email('a@b.co!') b, velado_digits_of('1a2') c, velado_mask_rg('RG: 12x') d").first()
    assert tuple(r) == ("x ***.456.789-**", "[E-MAIL]!", "12", "RG: XXXXXX")


def test_plan_has_no_shuffle(spark):
    df = spark.range(5).selectExpr("concat('a@b.co ', id) as text")
    plan = mask(df, "text", DocOptions(nomes=True), NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_random_phones_equal_plain_python(spark):
    from velado.operators.document_mode import mask_phones
    from velado.streaming import python_rules as R

    rnd = random.Random(3)
    pieces = ["91234-5678", "3456 7890", "(61) ", "61 ", "+55 ", "/", " ", "R$ ", "Lei nº ", "2020-1999", "19", "x", ".", "1-2-33", "0300 "]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(10))) for _ in range(1500)]
    got = [r.text for r in mask_phones(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()]
    want = [R.PHONE.sub(lambda m: "[TEL]" if R.is_phone(t, m.start(), m.end()) else m[0], t) for t in texts]  # noqa: B023
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_names_need_a_list(spark):
    df = spark.createDataFrame([("Dr. Ulisses Prado viu Ana Lima",)], "text string")
    with pytest.raises(ValueError, match="first_names"):
        mask(df, "text", DocOptions(nomes=True))
    assert mask(df, "text", DocOptions(nomes=True), ()).first().text == "Dr. U. P. V. A. L."
    table = spark.createDataFrame([("Ana",), ("ANA",), (" Érica ",), (None,), ("",)], "name string")
    assert N.read_first_names(table) == ("ANA", "ERICA")
    with pytest.raises(ValueError, match="more than 1"):
        N.read_first_names(table, most=1)


def test_anchor_before_an_id(spark):
    for tail in (", portador do CPF", ", CPF nº", ", matrícula", ", SIAPE"):
        assert one(spark, lambda t: F.array_join(N.extract_names(t, ()), "|"), f"Em 1999. Otto Reis{tail} 123") == "Otto Reis"


def test_rg_takes_a_space_behind(spark):
    assert masked(spark, "RG 1234 .", doc_sei=False) == "RG XXXXXX."
