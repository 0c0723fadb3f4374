"""Rows less those of some ids."""

from velado.llm.common import without


def test_nulls_repeats_empty_sides_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (None, "c", 2), (3, "d", 3), (2, "e", 4)], "doc_id long, maybe string, loser int")
    lost = spark.createDataFrame([(2,), (2,), (None,), (9,)], "x long")
    kept = without(docs, lost, "doc_id")
    assert kept.columns == docs.columns
    assert sorted(r.maybe for r in kept.collect()) == ["a", "c", "d"]  # a null id is no id, so it is never lost
    assert without(docs, lost.limit(0), "doc_id").count() == 5
    assert without(docs.limit(0), lost, "doc_id").count() == 0
