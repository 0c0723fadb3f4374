import os
import zipfile

import pytest
from pyspark.sql import functions as F

from velado.operators import batch, layout
from velado.operators.document_mode import DocOptions
from velado.sources import files as S
from velado.streaming.sessions import anonymize_stream

DOCX = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>CPF: 123.456</w:t></w:r><w:r><w:t>.789-00</w:t></w:r></w:p><w:p><w:r><w:t>nada</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>mail a@b.co</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


@pytest.fixture
def lot(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("CPF: 123.456.789-00\r\nfim \xff".encode("latin-1"))
    (tmp_path / "sub" / "b.TXT").write_text("x@y.org")
    (tmp_path / "c.odt").write_text("?")
    (tmp_path / "d.pdf").write_text("?")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7 trailer << /Encrypt 5 0 R >>")
    (tmp_path / "old_anonimizado.txt").write_text("a@b.co")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
        z.writestr("other.bin", b"\0\1")
    (tmp_path / "g.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "h.docx", "w") as z:
        z.writestr("other.bin", b"")
    (tmp_path / "i.pdf").write_bytes(b"%PDF-1.7 (the word /Encrypt in a text) trailer << /Root 1 0 R >>")
    (tmp_path / "k.pdf").write_bytes(b"%PDF-1.7 9 0 obj << /Type /XRef /Encrypt 5 0 R >> stream")
    return tmp_path


def test_batch(spark, lot):
    report = {os.path.basename(r.path): (r.status, r.error) for r in batch.run(spark, str(lot)).collect()}
    assert report == {"a.txt": ("ok", None), "b.TXT": ("ok", None), "c.odt": ("failed", "unsupported: odt"), "d.pdf": ("skipped", "needs a page table"), "f.pdf": ("failed", "encrypted"), "e.docx": ("ok", None), "g.docx": ("failed", "BadZipFile"), "h.docx": ("failed", "KeyError"), "i.pdf": ("skipped", "needs a page table"), "k.pdf": ("failed", "encrypted")}
    assert (lot / "a_anonimizado.txt").read_text() == "CPF: ***.456.789-**\nfim �"
    assert (lot / "sub" / "b_anonimizado.TXT").read_text() == "[E-MAIL]"
    again = S.docx(S.scan(spark, str(lot / "e.docx")).unionByName(spark.read.format("binaryFile").load(str(lot / "e_anonimizado.docx")).selectExpr("path", "content", "'docx' as ext", "true as supported")))
    texts = {(os.path.basename(r.path), r.para_no): (r.in_table, r.text) for r in again.collect()}
    assert texts["e.docx", 0] == (False, "CPF: 123.456.789-00") and texts["e_anonimizado.docx", 0] == (False, "CPF: ***.456.789-**")
    assert texts["e_anonimizado.docx", 2] == (True, "mail [E-MAIL]") and texts["e_anonimizado.docx", 1] == (False, "nada")
    assert {r.status: r.n for r in batch.summary(batch.run(spark, str(lot / "sub"))).collect()} == {"ok": 1}


WORDS = "doc_id string, page int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"


def page(spark, *lines):
    rows = [("d", 1, n, k, 100.0 * k, y, 100.0 * k + 50, y + 12, w) for n, (y, line) in enumerate(lines) for k, w in enumerate(line.split(" "))]
    return spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double"), spark.createDataFrame(rows, WORDS)


def test_plan_covers_hits_across_lines(spark):
    pages, words = page(spark, (10.0, "Alberto de"), (30.0, "Campos x@y.org"), (50.0, "RG: 123456 SSP"), (70.0, "CPF 12345678901"))
    boxes, terms = layout.plan(pages, words, DocOptions(qr_code=False, termos_customizados=("Alberto de Campos",)))
    got = sorted((r.tipo, r.x0, r.y0, r.x1, r.y1, r.rotulo) for r in boxes.collect())
    assert got == [
        ("cpf", 100.0, 70.0, 150.0, 82.0, "***.456.789-**"), ("custom", 0.0, 10.0, 150.0, 22.0, "[REMOVIDO]"), ("custom", 0.0, 30.0, 50.0, 42.0, "[REMOVIDO]"),
        ("email", 100.0, 30.0, 150.0, 42.0, "[E-MAIL]"), ("rg", 100.0, 50.0, 250.0, 62.0, "RG: XXXXXX"),
    ]
    assert {r.term for r in terms.collect()} == {"12345678901", "123456 SSP", "Alberto de Campos", "x@y.org"}


def test_gates_and_bars(spark):
    pages, words = page(spark, (10.0, "1234567"), (500.0, layout.SIGNED), (600.0, layout.AUTHENTIC), (650.0, "1234567 12345aF0"))
    boxes, _ = layout.plan(pages, words, DocOptions(cpf=False, rg=False, email_tel=False))
    assert sorted((r.tipo, r.y0) for r in boxes.collect()) == [("barra_sei", 0.0), ("crc_sei", 650.0), ("doc_sei", 650.0), ("qr_code", 590.0)]
    none, _ = layout.plan(pages, words, DocOptions(cpf=False, rg=False, email_tel=False, doc_sei=False, qr_code=False))
    assert none.count() == 0


def test_name_boxes_redactions_and_manual(spark):
    pages, words = page(spark, (10.0, "Dr. Ulisses Prado."), (30.0, "ULISSES"))
    boxes, terms = layout.plan(pages, words, DocOptions(qr_code=False, nomes=True, rg=False, doc_sei=False), ())
    assert [(r.tipo, r.rotulo, r.x0, r.x1) for r in boxes.collect()] == [("nome", "U. P.", 100.0, 250.0)]
    manual = boxes.limit(0).unionByName(spark.createDataFrame([("d", 1, 0.0, 0.0, 9.0, 9.0, "manual", "x", [0.0, 1.0, 0.0])], boxes.schema))
    drawn = {r.tipo: r for r in layout.redactions(boxes.unionByName(manual), "texto").collect()}
    assert drawn["manual"].fill == [0.0, 1.0, 0.0] and drawn["manual"].text is None and drawn["manual"].x0 == -0.5
    assert drawn["nome"].text == "U. P." and drawn["nome"].font_size == 9.0 and drawn["nome"].fill == [1.0, 1.0, 1.0]
    assert {r.fill[0] for r in layout.redactions(boxes, "tarja_preta").collect()} == {0.0}


def test_metadata_and_annotations(spark):
    terms = spark.createDataFrame([("d", "Alberto da Silva"), ("d", "x")], "doc_id string, term string")
    meta = spark.createDataFrame([("d", {"author": "A", "title": "De ALBERTO, CPF 123.456.789-00; da  casa", "x": "Silva", "subject": None}), ("e", {})], "doc_id string, meta map<string,string>")
    got = {r.doc_id: r.meta for r in layout.scrubbed_metadata(meta, terms).collect()}
    assert got == {"d": {"author": "", "title": "De CPF ***.456.789-** da casa", "x": "Silva"}, "e": {}}
    annots = spark.createDataFrame([("d", 1, 0.0, 0.0, 5.0, 5.0, "ok", None, None), ("d", 1, 50.0, 50.0, 55.0, 55.0, "alberto DA silva", "", ""), ("d", 2, 0.0, 0.0, 5.0, 5.0, "ok", None, "x")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, content string, title string, subject string")
    boxes = spark.createDataFrame([("d", 1, 4.0, 4.0, 9.0, 9.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.page for r in layout.kept_annotations(annots, boxes, terms).collect()] == [2]


def test_stream_keeps_markers_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "scope_id string, seq long, text string"
    spark.createDataFrame([("a", 1, "x@y.co"), ("b", 1, "z@y.co"), ("a", 2, "w@y.co X@Y.CO")], schema).coalesce(1).write.parquet(str(src / "1"))
    out = anonymize_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src)))

    def go():
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    spark.createDataFrame([("a", 3, "n@y.co e w@y.co"), ("a", 4, None)], schema).coalesce(1).write.parquet(str(src / "2"))
    go()
    got = {(r.scope_id, r.seq): r.text for r in spark.read.parquet(str(tmp_path / "out")).select("scope_id", "seq", F.col("text")).collect()}
    assert got == {("a", 1): "[EMAIL_1]", ("a", 2): "[EMAIL_2] [EMAIL_1]", ("b", 1): "[EMAIL_1]", ("a", 3): "[EMAIL_3] e [EMAIL_2]", ("a", 4): None}


def test_a_value_is_covered_wherever_it_stands(spark):
    """Also without the context that gave it away, over lines, and with a null word; a page twice, and without words."""
    pages, words = page(spark, (10.0, "RG: 55443 ."), (30.0, "ref 554-"), (50.0, "43 fim"), (70.0, "CPF 12345678901"), (90.0, "n. 12345678901"))
    words = words.unionByName(spark.createDataFrame([("d", 1, 9, 0, 0.0, 99.0, 1.0, 99.0, None)], WORDS))
    pages = pages.unionByName(pages).unionByName(pages.withColumn("page", F.lit(2)))
    boxes, terms = layout.plan(pages, words, DocOptions(email_tel=False, doc_sei=False))
    got = sorted((r.tipo, r.page, r.x0, r.y0, r.x1) for r in boxes.collect())
    assert got == [("barra_sei", 1, 575.0, 0.0, 600.0), ("barra_sei", 2, 575.0, 0.0, 600.0), ("cpf", 1, 100.0, 70.0, 150.0), ("cpf", 1, 100.0, 90.0, 150.0), ("rg", 1, 0.0, 50.0, 50.0), ("rg", 1, 100.0, 10.0, 150.0), ("rg", 1, 100.0, 30.0, 150.0)]
    assert {r.term for r in terms.collect()} == {"55443", "12345678901"}


def test_plan_shuffles_each_page_once(spark):
    pages, words = page(spark, (10.0, "Dr. Ulisses Prado."), (30.0, "ULISSES x@y.co"))
    boxes, _ = layout.plan(pages, words, DocOptions(qr_code=False, doc_sei=False, nomes=True), ())
    assert boxes._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 1


def test_annotations_with_clashing_columns(spark):
    annots = spark.createDataFrame([("d", 1, 0.0, 0.0, 5.0, 5.0, "ok", None, None, "q")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, content string, title string, subject string, t string")
    boxes = spark.createDataFrame([("d", 2, 4.0, 4.0, 9.0, 9.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    terms = spark.createDataFrame([("d", "Alberto")], "doc_id string, term string")
    assert layout.kept_annotations(annots, boxes, terms).first().t == "q"


def test_stream_forgets_after_its_time(spark, tmp_path):
    """With a time to live, markers still agree within it, and numbers are never given twice."""
    schema = "scope_id string, seq long, text string"
    spark.createDataFrame([("a", 1, "x@y.co"), ("a", 2, "w@y.co X@Y.CO")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = anonymize_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl_ms=3_600_000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()  # a time to live makes batches without data, and availableNow waits for their end
    assert q.awaitTermination(60)
    assert {(r.seq, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "[EMAIL_1]"), (2, "[EMAIL_2] [EMAIL_1]")}
