import random

from pyspark.sql import functions as F

from velado.functions import patterns as P
from velado.operators import layout
from velado.operators.document_mode import DocOptions

PIECES = ["1234567", "12345aF0", "12345AF0", "ab.c-d", "a@b.co", " ", "\n", "-\n", "-", ".", "​", "1 2", "k", "K", "K", "sſ", "İi", "ı", "é", "￿", "RG", "1"]
TERMS = ["1234567", "12345aF0", "ab.c-d", "a@b.co", "k", "iS", "11", "é", ".1", "1.", "RG 1", "K k", "a@b"]


def test_spans_equal_the_pattern(spark):
    """Random texts: where a term stands by its letters is where its pattern finds it."""
    rnd = random.Random(5)
    rows = [("".join(rnd.choice(PIECES) for _ in range(rnd.randrange(9))) + t + rnd.choice(PIECES), t) for t in TERMS for _ in range(150)]
    df = spark.createDataFrame(rows, "text string, term string").withColumn("folded", P.folded(F.col("text"))).withColumn("squeezed", F.regexp_replace("folded", P.SQUEEZED, ""))
    got = df.select("text", "term", layout._term_spans(F.col("term")).alias("a"), F.regexp_extract_all("text", P.tolerant_col(F.col("term")), F.lit(0)).alias("b")).collect()
    assert [(r.text, r.term) for r in got if [r.text[x.begin : x.end] for x in r.a] != r.b] == []


def test_touched_words(spark):
    """Words with white space or the sign between words in them, empty words, spans that begin or end between words."""
    rnd = random.Random(6)
    rows = [("d", p, n, 0, float(n), 0.0, n + 1.0, 1.0, rnd.choice(["", "a b", "￿", "x￿y", "abc", "\n", "é", None])) for p in range(60) for n in range(rnd.randrange(1, 8))]
    texts = layout.page_texts(spark.createDataFrame(rows, "doc_id string, page int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.length("text")), lambda b: F.transform(F.sequence(b, F.length("text")), lambda e: F.struct(b.alias("b"), e.alias("e")))))
    for r in texts.select("text", "words", F.transform(F.filter(spans, lambda s: s["b"] < s["e"]), lambda s: F.struct(s["b"], s["e"], layout._touched(s["b"], s["e"]).alias("t"))).alias("s")).collect():
        at, places = 0, []
        for n, w in enumerate(r.words):
            begin = at + (n > 0)
            at = begin + len(w.word)
            places.append((begin, at, w.x0))
        assert at == len(r.text)
        for s in r.s:
            assert [w.x0 for w in s.t] == [x for begin, end, x in places if begin < s.e and end > s.b]


def test_default_plan_reads_words_once(spark):
    """Boxes, QR areas and heights from one row a page: one shuffle for the words, one for the side bars, and no window."""
    words = spark.createDataFrame([("d", 1, 0, 0, 0.0, 0.0, 9.0, 9.0, "1234567")], "doc_id string, page int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    boxes, _ = layout.plan(pages, words, DocOptions())
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 2 and "Window" not in plan
