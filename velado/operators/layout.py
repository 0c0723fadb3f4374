"""Redaction plans for pages given as tables: what to cover, where, and with what.

pages (doc_id, page, width, height); words (doc_id, page, line_no, word_no, x0, y0, x1, y1, text): a page's words in
reading order. A page's text is its words with spaces between and a line feed between lines. Boxes come out as
(doc_id, page, x0, y0, x1, y1, tipo, rotulo, fill); a caller may add rows of their own (tipo "manual") before applying.
Rules see the page's original text, unlike those of whole texts, which see what the rule before left.

Words meet their page in one shuffle; then everything of a page happens within its row: all rules' values, their places,
the lines that each touches, and the position gates. A value that a rule finds is covered wherever the page has it, with or
without the context that gave it away, despite spaces between letters, line breaks and hyphens: a box for each line that an
occurrence touches, whole words. As the words are where the text comes from, every occurrence has its words, and there is
nothing to fall back to.

Nulls and edges: a word of null text is empty; null ids are one document; a page without words gets its side bar only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.canonical import initials, mask_cpf, mask_seven_digits
from ..functions.gazetteer import METADATA_STOPWORDS
from ..functions.names import extract_names
from ..functions.phone import is_phone
from ..functions.segments import CUT, gaps, hits, once
from .document_mode import DocOptions, mask

# The phrases that place codes on a page.
SIGNED = "Documento assinado eletronicamente por"
AUTHENTIC = "A autenticidade do documento pode ser conferida no site"
BOX = ["doc_id", "page", "x0", "y0", "x1", "y1", "tipo", "rotulo", "fill"]
_WANTED = "array<struct<tipo: string, term: string, rotulo: string, fill: array<double>>>"


def page_texts(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, words, text, apart[, height]): words as an array, and the text with another sign between words.

    A page is one row, not a document. With pages, also the height of each; of a page given twice, the greatest. Words and
    heights meet in one shuffle, and a page's words are put in order within its row.
    """
    word = F.struct("line_no", "word_no", "x0", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("word"))
    w, more = words.select("doc_id", "page", word.alias("w")), []
    if pages is not None:
        none = F.lit(None).cast(w.schema["w"].dataType)
        w = w.withColumn("height", F.lit(None).cast(pages.schema["height"].dataType)).unionByName(pages.select("doc_id", "page", none.alias("w"), "height"))
        more = [F.max("height").alias("height")]
    w = w.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("w")).alias("w"), *more).filter(F.size("w") > 0)
    above = lambda i: F.get(F.col("w"), i - 1)["line_no"]
    parts = F.transform("w", lambda x, i: F.concat(F.when(i == 0, "").when(above(i).eqNullSafe(x["line_no"]), " ").otherwise("\n"), x["word"]))
    apart, own = F.array_join(F.col("w")["word"], CUT), F.transform(F.col("w")["word"], lambda x: F.translate(x, CUT, " "))
    apart = F.when(_count(apart) == F.size("w") - 1, apart).otherwise(F.array_join(own, CUT))
    placed = [F.col("w").alias("words"), F.array_join(parts, "").alias("text"), apart.alias("apart")]
    return w.select("doc_id", "page", *placed, *(["height"] if more else []))


def _count(apart: Column) -> Column:
    return F.length(apart) - F.length(F.replace(apart, F.lit(CUT), F.lit("")))


def _spans(text: Column, pattern: Column) -> Column:
    """An array of (begin, end) of a pattern's matches."""
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<begin: int, end: int>>").alias("found"))

    def add(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.when(acc["hit"], F.array_append(acc["found"], F.struct(acc["at"].alias("begin"), end.alias("end")))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), found.alias("found"))

    # Gap, hit, gap ... gap; a text that has the sign itself is cut by the pattern.
    plain = F.split(F.regexp_replace(text, pattern, F.lit(f"{CUT}$0{CUT}")), CUT, -1)
    alike = once(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), lambda c: F.flatten(F.transform(c["gaps"], lambda g, i: F.when(i < F.size(c["hits"]), F.array(g, F.get(c["hits"], i))).otherwise(F.array(g)))))
    return F.aggregate(F.when(text.contains(CUT), alike).otherwise(plain), none, add)["found"]


def _term_spans(term: Column) -> Column:
    """The spans of P.tolerant_col(term) in `text`, of which `folded` is P.folded and `squeezed` that without what may stand
    between letters.

    Each occurrence has the term's squeezed letters in `squeezed`. Where those come once, and the term itself stands in the
    text, that is the only occurrence, and no pattern needs to be built. Terms of other than plain characters, or with a
    sign at an end that may be between letters, take the pattern.
    """

    def of(t: Column) -> Column:
        letters = F.regexp_replace(t, P.SQUEEZED, "")

        def placed(x: Column) -> Column:
            at = x["at"] - 1
            found = F.array(F.struct(at.cast("int").alias("begin"), (at + F.length(t)).cast("int").alias("end")))
            return F.when((x["at"] > 0) & (x["again"] == 0), found).otherwise(_spans(F.col("text"), P.tolerant_col(term)))

        again = once(letters, lambda s: F.position(s, F.col("squeezed"), F.position(s, F.col("squeezed")) + 1))
        return once(F.struct(F.position(t, F.col("folded")).alias("at"), again.alias("again")), placed)

    return F.when(term.rlike(P.PLAIN), once(P.folded(term), of)).otherwise(_spans(F.col("text"), P.tolerant_col(term)))


def _lines(begin: Column, end: Column) -> Column:
    """An array of boxes (x0, y0, x1, y1): of each line, around the words that a span touches."""
    box = ("x0", "y0", "x1", "y1")

    def of(touched: Column) -> Column:
        def line(n: Column) -> Column:
            return once(F.filter(touched, lambda w: w["line_no"].eqNullSafe(n)), lambda own: F.struct(*(f(F.transform(own, lambda w: w[c])).alias(c) for c, f in zip(box, (F.array_min, F.array_min, F.array_max, F.array_max), strict=True))))  # noqa: B023

        several = F.transform(F.array_distinct(F.transform(touched, lambda w: w["line_no"])), line)
        return F.when(F.size(touched) == 1, F.transform(touched, lambda w: F.struct(*(w[c].alias(c) for c in box)))).otherwise(several)

    return once(_touched(begin, end), of)


def _touched(begin: Column, end: Column) -> Column:
    """The words that a span touches.

    Words end where a sign between words stands: a span's first word has as many before it as the text up to and with the
    span's first letter, its last word as many as the text before the span's last letter.
    """
    upto = lambda n: _count(F.left(F.col("apart"), n))
    return once(upto(begin + 1), lambda low: F.slice("words", low + 1, upto(end - 1) - low + 1))


def _places(spans: Column) -> Column:
    """The boxes of spans in a row of page_texts."""
    return F.flatten(F.transform(spans, lambda s: _lines(s["begin"], s["end"])))


def _fill(rgb: Iterable[float] | None) -> Column:
    return (F.array(*(F.lit(float(x)) for x in rgb)) if rgb is not None else F.lit(None).cast("array<double>")).alias("fill")


class Rule:
    """Values that a pattern finds on a page, or that stand in a column, and how their boxes look.

    keep: (hit, i, gaps, hits) -> whether it counts; guard: a pattern that every page with a hit has, cheaper than its own
    if there is one; "" where most pages have a hit.
    """

    def __init__(self, tipo: str, pattern: str, group: int = 0, label: Callable[[Column], Column] | str = "", fill: Iterable[float] | None = None, keep: Callable | None = None, guard: str | None = None):
        self.tipo, self.pattern, self.group, self.fill, self.keep, self.guard = tipo, pattern, group, fill, keep, pattern if guard is None else guard
        self.label = label if callable(label) else lambda _: F.lit(label)

    def values(self, texts: DataFrame, at: str) -> DataFrame:
        """texts with a column `at` of this rule's (tipo, term, rotulo, fill), each term once."""
        none = F.array().cast(_WANTED)
        if self.keep is None:
            found = self.wanted(hits(F.col("text"), self.pattern, self.group))
        else:
            cut = lambda h: F.struct(gaps(F.col("text"), self.pattern).alias("g"), h.alias("h"))
            kept = lambda c: F.transform(c["h"], lambda x, i: F.when(self.keep(x, i, c["g"], c["h"]), x))
            found = self.wanted(once(cut(hits(F.col("text"), self.pattern)), kept))
        return texts.withColumn(at, F.when(F.col("text").rlike(self.guard), found).otherwise(none) if self.guard else found)

    def wanted(self, terms: Column) -> Column:
        own = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != ""))
        return F.transform(own, lambda t: F.struct(F.lit(self.tipo).alias("tipo"), t.alias("term"), self.label(t).alias("rotulo"), _fill(self.fill))).cast(_WANTED)


EMAIL_RULE, PHONE_RULE = Rule("email", P.EMAIL, 0, "[E-MAIL]", guard="@"), Rule("telefone", P.PHONE, 0, "[TEL]", keep=is_phone, guard=P.PHONE_CORE)
CPF_RULES = (Rule("cpf", P.CPF, 0, mask_cpf), Rule("cpf", P.CPF_BARE, 1, mask_cpf))
RG_RULES = (Rule("rg", P.RG, 1, "RG: XXXXXX"), Rule("data_exp", P.ISSUE_DATE, 0, "Data de Expedição: XX/XX/XXXX"))
SEI_RULE, CRC_RULE = Rule("doc_sei", r"(?U)\b\d{7}\b", 0, mask_seven_digits, guard=""), Rule("crc_sei", P.CRC, 0, "XXXXXXXX", (0, 0, 0), guard="")


def _boxed(texts: DataFrame, rules: Iterable[Rule], more: Iterable[Column] = ()) -> DataFrame:
    """texts with `boxes`: (x0, y0, x1, y1, tipo, rotulo, fill, term) of every rule's values and of `more` (arrays of wanted
    terms), wherever the page has them, less those outside their gates."""
    names = []
    for k, rule in enumerate(rules):
        texts = rule.values(texts, f"rule{k}")
        names.append(f"rule{k}")
    phrases = {"signed": P.tolerant(SIGNED), "authentic": P.tolerant(AUTHENTIC)}
    for name, phrase in phrases.items():
        found = _places(_spans(F.col("text"), F.lit(phrase)))
        texts = texts.withColumn(name, F.when(F.col("text").rlike(phrase), found).otherwise(F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")))
    height = F.col("height") if "height" in texts.columns else F.lit(None).cast("double")
    top = lambda c: F.array_min(F.transform(c, lambda b: b["y0"]))
    cuts = F.struct(F.coalesce(top("signed"), height * 0.85).alias("sei"), top("authentic").alias("crc"))
    folded = P.folded(F.col("text"))
    # Where a gate has no place on the page, nothing passes it.
    open_ = lambda w, cut: F.coalesce(F.when(w["tipo"] == SEI_RULE.tipo, cut["sei"].isNotNull()).when(w["tipo"] == CRC_RULE.tipo, cut["crc"].isNotNull()).otherwise(True), F.lit(True))
    wanted = F.concat(F.array().cast(_WANTED), *(F.col(n) for n in names), *more)

    def of(w: Column, cut: Column) -> Column:
        gate = lambda b: F.coalesce(F.when(w["tipo"] == SEI_RULE.tipo, b["y0"] > cut["sei"]).when(w["tipo"] == CRC_RULE.tipo, b["y0"] >= cut["crc"]).otherwise(True), F.lit(False))
        return F.transform(F.filter(_places(_term_spans(w["term"])), gate), lambda b: F.struct(*(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")), w["tipo"].alias("tipo"), w["rotulo"].alias("rotulo"), w["fill"].alias("fill"), w["term"].alias("term")))

    texts = texts.withColumn("wanted", wanted).drop(*names).withColumn("folded", folded).withColumn("squeezed", F.regexp_replace("folded", P.SQUEEZED, ""))
    boxes = once(cuts, lambda cut: F.flatten(F.transform(F.filter("wanted", lambda w: open_(w, cut)), lambda w: of(w, cut))))
    return texts.withColumn("boxes", F.array_distinct(boxes))


def _of(boxed: DataFrame, more: Iterable[Column] = ()) -> DataFrame:
    """A row a box, each once, and a row for each of `more` (arrays of boxes)."""
    bare = F.array_distinct(F.transform("boxes", lambda b: F.struct(*(b[c].alias(c) for c in BOX[2:]))))
    bare = F.concat(bare, *more) if more else bare
    return boxed.select("doc_id", "page", F.explode(bare).alias("b")).select("doc_id", "page", "b.*")


def side_bars(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", (F.col("width") - 25).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.lit("barra_sei").alias("tipo"), F.lit("Barra Lateral SEI").alias("rotulo"), _fill([0, 0, 0]))


def _qr() -> Column:
    """An array of boxes: beside the authenticity phrase."""
    own = lambda a: F.struct((a["x0"] - 60).alias("x0"), (a["y0"] - 10).alias("y0"), a["x0"].alias("x1"), (a["y1"] + 40).alias("y1"), F.lit("qr_code").alias("tipo"), F.lit("QR Code SEI").alias("rotulo"), _fill([1, 1, 1]))
    return F.transform(F.array_distinct("authentic"), own)


def qr_boxes(texts: DataFrame) -> DataFrame:
    return _boxed(texts, ()).select("doc_id", "page", F.explode(_qr()).alias("b")).select("doc_id", "page", "b.*")


def with_height(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """texts with the height of their pages; of a page given twice, the greatest."""
    p = pages.groupBy(F.col("doc_id").alias("p_doc"), F.col("page").alias("p_page")).agg(F.max("height").alias("height"))
    return texts.join(p, F.col("doc_id").eqNullSafe(F.col("p_doc")) & F.col("page").eqNullSafe(F.col("p_page")), "left").drop("p_doc", "p_page")


def sei_numbers(texts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Seven-digit numbers below the signature line, or in the last 15 % of a page without one; pages if texts have no height."""
    return _of(_boxed(texts if pages is None else with_height(texts, pages), (SEI_RULE,)))


def crc_codes(texts: DataFrame) -> DataFrame:
    """Codes level with or below the authenticity phrase."""
    return _of(_boxed(texts, (CRC_RULE,)))


def plan(pages: DataFrame, words: DataFrame, options: DocOptions = DocOptions(), first_names: Column | Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes, terms): every rule's boxes, each once, and the terms found, by document. first_names as in document_mode.mask."""
    rules = [EMAIL_RULE, PHONE_RULE] * options.email_tel + [*CPF_RULES] * options.cpf + [*RG_RULES] * options.rg + [SEI_RULE, CRC_RULE] * options.doc_sei
    custom = tuple(t for t in options.termos_customizados if P.tolerant(t))
    more = [F.array(*(F.struct(F.lit("custom").alias("tipo"), F.lit(t).alias("term"), F.lit("[REMOVIDO]").alias("rotulo"), _fill(None)) for t in custom)).cast(_WANTED)] if custom else []
    texts = page_texts(words, pages if options.doc_sei else None)
    if options.nomes:
        if first_names is None:
            raise ValueError("names need first_names; () takes only those that a phrase anchors")
        label = initials if options.modo_nomes == "iniciais" else "[NOME]"
        texts = texts.withColumn("names", extract_names(F.col("text"), first_names))
        more.append(Rule("nome", "", 0, label).wanted(F.col("names")))
    boxed = _boxed(texts, rules, more)
    boxes = _of(boxed, [_qr()] if options.qr_code else [])
    if options.qr_code:
        boxes = boxes.unionByName(side_bars(pages.select("doc_id", "page", "width", "height").distinct()))
    terms = boxed.select("doc_id", F.explode(F.array_distinct(F.transform("boxes", lambda b: b["term"]))).alias("term"))
    if custom:
        terms = terms.unionByName(pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(t) for t in custom))).alias("term")))
    return boxes, terms.distinct()


def redactions(boxes: DataFrame, mode: str = "tarja_preta") -> DataFrame:
    """What a writer draws: boxes half a point wider, their colour, and text with its size where the mode masks by text."""
    black, white = F.array(*(F.lit(0.0),) * 3), F.array(*(F.lit(1.0),) * 3)
    colour = {"tarja_preta": black, "tarja_branca": white}.get(mode, white)
    shown = F.lit(None).cast("string") if mode in ("tarja_preta", "tarja_branca") else F.when(F.col("fill").isNull(), F.col("rotulo"))
    size = F.greatest(F.bround((F.col("y1") - F.col("y0")) * 0.75, 1), F.lit(6.0))
    return boxes.select("doc_id", "page", (F.col("x0") - 0.5).alias("x0"), (F.col("y0") - 0.5).alias("y0"), (F.col("x1") + 0.5).alias("x1"), (F.col("y1") + 0.5).alias("y1"), "tipo", F.coalesce("fill", colour).alias("fill"), shown.alias("text"), F.when(shown.isNotNull(), size).alias("font_size"))


def kept_annotations(annots: DataFrame, boxes: DataFrame, terms: DataFrame) -> DataFrame:
    """Annotations that touch no box and mention no term of three letters or more. Errors are raised, not passed over."""
    b = boxes.select(*(F.col(c).alias(f"b_{c}") for c in ("doc_id", "page", "x0", "y0", "x1", "y1")))
    a = lambda c: annots[c]
    touch = a("doc_id").eqNullSafe(b.b_doc_id) & a("page").eqNullSafe(b.b_page) & (F.greatest(a("x0"), b.b_x0) < F.least(a("x1"), b.b_x1)) & (F.greatest(a("y0"), b.b_y0) < F.least(a("y1"), b.b_y1))
    said = F.lower(F.concat_ws(" ", *(F.coalesce(a(c), F.lit("")) for c in ("content", "title", "subject"))))
    t = terms.filter(F.length("term") >= 3).select(F.col("doc_id").alias("t_doc"), F.lower("term").alias("t_term"))
    return annots.join(b, touch, "left_anti").join(t, a("doc_id").eqNullSafe(t.t_doc) & said.contains(t.t_term), "left_anti")


def kept_links(links: DataFrame, options: DocOptions = DocOptions()) -> DataFrame:
    """links (doc_id, page, ...): none where the option removes them, all otherwise."""
    return links.filter(F.lit(not options.links))


def image_cuts(images: DataFrame, boxes: DataFrame, options: DocOptions = DocOptions()) -> DataFrame:
    """images (doc_id, page, x0, y0, x1, y1, ...) with `cuts`: the parts of each that a writer blanks, an array of boxes in
    page coordinates. Pixels go under every box if the options say so for images or for QR codes, else none does."""
    pick = ("x0", "y0", "x1", "y1")
    own = images.toDF(*(f"c{k}" for k in range(len(images.columns))))
    i = {c: F.col(f"c{images.columns.index(c)}") for c in ("doc_id", "page", *pick)}
    none = F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")
    if not (options.redigir_imagens or options.qr_code):
        return own.withColumn("cuts", none).toDF(*images.columns, "cuts")
    page_boxes = boxes.groupBy(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page")).agg(F.array_sort(F.collect_set(F.struct(*(F.col(c).cast("double").alias(c) for c in pick)))).alias("b"))
    met = own.join(page_boxes, i["doc_id"].eqNullSafe(F.col("b_doc")) & i["page"].eqNullSafe(F.col("b_page")), "left")
    part = F.transform("b", lambda b: F.struct(*(f(b[c], i[c].cast("double")).alias(c) for c, f in zip(pick, (F.greatest, F.greatest, F.least, F.least), strict=True))))
    cuts = F.coalesce(F.filter(part, lambda p: (p["x0"] < p["x1"]) & (p["y0"] < p["y1"])), none)
    return met.select(*own.columns, cuts.alias("cuts")).toDF(*images.columns, "cuts")


def scrubbed_metadata(metadata: DataFrame, terms: DataFrame, options: DocOptions = DocOptions(), first_names: Column | Iterable[str] | None = None) -> DataFrame:
    """metadata (doc_id, meta map): no author; title, subject, keywords and creator masked and rid of sensitive words.

    A document's sensitive words are its terms and their words, of three letters or more; null values go.
    """
    own = terms.select("doc_id", F.trim("term").alias("term"))
    parts = own.select("doc_id", F.explode(F.transform(F.split("term", r"(?U)\s+"), lambda w: F.trim(w, F.lit(".,;:\"'()[]{}")))).alias("w")).filter((F.length("w") >= 3) & ~F.upper("w").isin(*METADATA_STOPWORDS))
    words = own.filter(F.length("term") >= 3).select("doc_id", F.lower("term").alias("w")).unionByName(parts.select("doc_id", F.lower("w").alias("w"))).groupBy("doc_id").agg(F.collect_set("w").alias("_w"))
    entry = metadata.select("doc_id", F.explode("meta").alias("k", "text")).filter("text is not null")
    masked = entry.filter(F.col("k").isin("title", "subject", "keywords", "creator"))
    rest = entry.filter(~F.col("k").isin("title", "subject", "keywords", "creator")).withColumn("text", F.when(F.col("k") == "author", "").otherwise(F.col("text")))
    masked = mask(masked, "text", options, first_names).join(words, "doc_id", "left")
    longest = F.array_sort(F.coalesce("_w", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    without = F.aggregate(longest, F.col("text"), lambda acc, w: F.regexp_replace(acc, F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(w, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b")), F.lit("")))
    masked = masked.withColumn("text", F.trim(F.regexp_replace(without, r"(?U)[\s,;]+", " "), F.lit(" ,;"))).drop("_w")
    clean = masked.unionByName(rest).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "text"))).alias("meta"))
    return metadata.select("doc_id").join(clean, "doc_id", "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))
