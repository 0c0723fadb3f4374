from velado.api import DocumentAnonymizer, TextAnonymizer

CALLS = "scope_id string, seq long, text string"


def test_calls_accumulate(spark):
    a = TextAnonymizer(spark)
    assert not a.has_personal_data()
    one = a.anonymize(spark.createDataFrame([("s", 5, "x@y.co"), ("t", 1, "x@y.co")], CALLS)).collect()
    assert {(r.scope_id, r.seq, r.text) for r in one} == {("s", 5, "[EMAIL_1]"), ("t", 1, "[EMAIL_1]")}
    two = a.anonymize(spark.createDataFrame([("s", 1, "z@y.co X@Y.CO 111.222.333-44")], CALLS)).collect()
    assert [r.text for r in two] == ["[EMAIL_2] [EMAIL_1] [CPF_1]"]
    assert {(r.scope_id, r.type, r.n) for r in a.counts().collect()} == {("s", "EMAIL", 2), ("s", "CPF", 1), ("t", "EMAIL", 1)}
    assert a.restore(spark.createDataFrame([("s", 1, "email_2")], CALLS)).first().text == "z@y.co" and a.has_personal_data()


def test_document_engine(spark):
    d = DocumentAnonymizer({"nomes": True, "modo_redacao_pdf": "texto", "limpar_anotacoes": False}, ["Ana"])
    df = spark.createDataFrame([("Dr. Ulisses Prado, a@b.co",)], "text string")
    assert d.mask(df).first().text == "Dr. U. P., [E-MAIL]" and d.names(df).first().names == ["Ulisses Prado"]
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    words = spark.createDataFrame([("d", 1, 0, 0, 1.0, 1.0, 50.0, 13.0, "a@b.co")], "doc_id string, page int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes, terms = d.plan(pages, words)
    annots = spark.createDataFrame([("d", 1, 0.0, 0.0, 9.0, 9.0, "x", "", "")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, content string, title string, subject string")
    meta = spark.createDataFrame([("d", {"author": "x"})], "doc_id string, meta map<string,string>")
    links = spark.createDataFrame([("d", 1, "http://x")], "doc_id string, page int, uri string")
    images = spark.createDataFrame([("d", 1, 40.0, 0.0, 90.0, 9.0, "i"), ("d", 2, 0.0, 0.0, 9.0, 9.0, "j")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, c0 string")
    out = d.apply(boxes, terms, annots, meta, links, images)
    assert out["links"].count() == 0 and DocumentAnonymizer({"links": False}).apply(boxes, terms, links=links)["links"].count() == 1
    assert {r.c0: [tuple(c) for c in r.cuts] for r in out["images"].collect()} == {"i": [(40.0, 1.0, 50.0, 9.0)], "j": []}
    assert {r.c0: r.cuts for r in DocumentAnonymizer({"qr_code": False}).apply(boxes, terms, images=images)["images"].collect()} == {"i": [], "j": []}
    assert {r.tipo: r.text for r in out["redactions"].collect()} == {"email": "[E-MAIL]", "barra_sei": None}
    assert out["annotations"].count() == 1 and out["metadata"].first().meta == {"author": ""}


def test_a_later_session_goes_on(spark):
    a = TextAnonymizer(spark)
    a.anonymize(spark.createDataFrame([("s", 1, "x@y.co")], CALLS))
    b = TextAnonymizer(spark, vault=a.vault)
    assert b.anonymize(spark.createDataFrame([("s", 1, "w@y.co x@y.co")], CALLS)).first().text == "[EMAIL_2] [EMAIL_1]"
