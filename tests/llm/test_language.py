import random
import zlib

import numpy as np
from common import AWKWARD, frame

from velado.llm import language as L
from velado.llm.features import in_fold

SYLLABLES = {"en": "the ing er on an re".split(), "fr": "eau que é la ou ê".split(), "de": "ung sch ü ein keit ß".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def labelled(n=240, seed=1):
    rnd = random.Random(seed)
    return [(k, text(rnd, lang, rnd.randrange(3, 60)), lang) for k in range(n) for lang in [("en", "fr", "de")[k % 3]]]


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(2)
    m = L.CRF(["a", "b", "c"])
    m.moves, m.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [1, 5, 130, 2, 700, 1]
    e = rng.random((sum(lengths), 3)) + 0.01
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got = np.split(m.marginals(e, first, steps=16), np.cumsum(lengths)[:-1])
    t, s = np.exp(m.moves), np.exp(m.start)
    for p, x in zip(got, np.split(e, np.cumsum(lengths)[:-1]), strict=True):
        a, b = [s * x[0]], [np.ones(3)]
        for row in x[1:]:
            v = (a[-1] / a[-1].sum()) @ t * row
            a.append(v)
        for row in x[:0:-1]:
            v = t @ (row * b[-1])
            b.append(v / v.sum())
        want = np.array([u * w for u, w in zip(a, b[::-1], strict=True)])
        assert np.allclose(p, want / want.sum(1, keepdims=True))


def test_held_out_and_code_switched(spark):
    rows = labelled()
    docs = frame(spark, [*rows, *((5000 + k, t, None) for k, t in enumerate(AWKWARD))])
    model = L.train(docs.filter(~in_fold("doc_id", 5, 0)), rows=150)
    assert model.labels == ["de", "en", "fr"]
    got = {r.id: r for r in L.predict(docs, model, block_bytes=3000).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].lang_pred == lang for k, lang in held]) > 0.97 and len(held) > 30
    for k, t in enumerate(AWKWARD):
        r = got[5000 + k]
        assert (r.lang_pred == "und" and r.score == 0) if not any(c.isalpha() for c in t or "") else (r.lang_pred in model.labels and 0 < r.score <= 1)
    assert L.predict(frame(spark, [(1, "½ ² 12")]), model).first().lang_pred == "und"
    rnd = random.Random(9)
    mixed = text(rnd, "fr", 40) + " " + text(rnd, "de", 60)
    p, letters, n = L.Labeller(model)([mixed.encode()])
    own = p.argmax(1)
    assert (own[:40] == 2).mean() > 0.9 and (own[40:] == 0).mean() > 0.9
    r = L.predict(frame(spark, [(1, mixed)]), model).first()
    assert r.lang_pred == "de" and 0.4 < r.score < 0.85 and 1 <= r.n_switches <= 8


def test_blocks_do_not_matter(spark):
    docs = frame(spark, labelled(60))
    model = L.train(docs, rows=60)
    a, b = ({r.id: (r.lang_pred, round(r.score, 6)) for r in L.predict(docs, model, block_bytes=n).collect()} for n in (200, 10**6))
    assert a == b


def test_keep_and_empty(spark):
    docs = frame(spark, labelled(30))
    model = L.train(docs)
    kept = L.predict(docs, model, keep=True)
    assert kept.count() == 30 and kept.columns[-2:] == ["lang_pred", "score"] and len(kept.columns) == len(docs.columns) + 2
    none = L.train(frame(spark, [(1, "a b"), (None, "x", "en")]))
    assert none.labels == [] and L.predict(docs, none).filter("lang_pred = 'und' and score = 0").count() == 30
    assert L.predict(frame(spark, []), model).count() == 0


def test_repeated_ids_keep_the_bound(spark, monkeypatch):
    """Ids that occur many times train once: never more documents than asked for."""
    seen = []
    monkeypatch.setattr(L.CRF, "fit", lambda self, docs: seen.append(docs) or self)
    rows = [(k % 2, f"text {k}", ("en", "fr")[k % 2]) for k in range(100)] + [(7, "seven", "en"), (7, "sept", "fr"), (None, "x", "en")]
    L.train(frame(spark, rows), rows=60)
    L.train(frame(spark, sorted(rows, key=str)).repartition(3), rows=60)
    assert seen[0] == seen[1] and 1 <= len(seen[0]) <= 3
