"""Small files give few tasks; queries whose work is on a row's text deal the rows out."""

import pytest
from pyspark.sql import functions as F

from velado.functions import patterns as P
from velado.operators import text_mode as T
from velado.plans.queries import QUERIES, _calls


@pytest.mark.parametrize("name", ["doc_mode_full", "mask_names"])
def test_rows_are_dealt_out(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_calls_are_dealt_out(spark, sf_dir):
    assert _calls(spark, sf_dir).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_a_lambda_cuts_the_text_once(spark):
    """What a lambda names twice is computed twice, so gaps and hits are made outside of it."""
    made = str(T._values(F.col("t"), P.PHONE, 0, T._phone))
    assert made.count("regexp_extract_all") == 1 and made.count("split(") <= 2
