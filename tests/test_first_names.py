import pytest
from pyspark.sql import functions as F

from velado.functions import canonical as C
from velado.functions import names as N
from velado.operators.document_mode import DocOptions, mask

OTHERS = ["Sebastião Alves", "Raimundo Nonato", "Geraldo Pires", "Cristina Rocha", "Isabel Prado", "Natália Reis", "TEREZINHA LOPES", "Érica de Sá", "Yuri Lima", "Zuleica Paz"]
LIST = [x.split()[0] for x in OTHERS]


def test_names_of_the_list_and_no_others(spark):
    df = spark.createDataFrame([(x,) for x in OTHERS], "x string")
    assert [r[0] for r in df.select(C.is_name(F.col("x"), LIST)).collect()] == [True] * len(OTHERS)
    assert [r[0] for r in df.select(C.is_name(F.col("x"), ["Ana"])).collect()] == [False] * len(OTHERS)
    as_column = F.array(*(F.lit(C.bare_upper(n)) for n in LIST))
    assert [r[0] for r in df.select(C.is_name(F.col("x"), as_column)).collect()] == [True] * len(OTHERS)


def test_a_long_list_is_one_set(spark):
    many = [f"Nome{k}" for k in range(20_000)]
    df = spark.createDataFrame([("Nome19999 Silva",), ("Nome20000 Silva",)], "x string")
    assert [r[0] for r in df.select(C.is_name(F.col("x"), many)).collect()] == [True, False]


@pytest.mark.parametrize("name", ["Sebastião Alves", "TEREZINHA LOPES"])
def test_found_by_shape_and_masked(spark, name):
    df = spark.createDataFrame([(f"em 2024, {name}, presente",)], "text string")
    assert df.select(N.extract_names(F.col("text"), LIST)).first()[0] == [name]
    assert name not in mask(df, "text", DocOptions(nomes=True), LIST).first()["text"]
