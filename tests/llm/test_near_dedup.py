import random

import numpy as np
import pytest
from common import bag, brute_classes, corpus, frame, invented, similarity
from pyspark.sql import functions as F

from velado.llm import near_dedup as N


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(4)
    for n, c in ((3, 0), (12, 0.1), (60, 0.03), (400, 0.02), (400, 0.1)):
        base = invented(rnd, n).split()
        base += base[: n // 3] * 2
        other = [w if rnd.random() > c else "zz" + w for w in base]
        raws = [" ".join(base).encode(), " ".join(other).encode(), b"..."]
        h, k, d = N.Bags()(raws)
        sig = N.bag_min_hash(h, k, d, 4096)
        exact = similarity(bag(raws[0].decode()), bag(raws[1].decode()))
        assert N.overlap((h[: d[0]], k[: d[0]]), (h[d[0] : d[0] + d[1]], k[d[0] : d[0] + d[1]])) == pytest.approx(exact)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04 and not sig[2].any()


def test_signature_of_a_text_is_its_own():
    rnd = random.Random(8)
    raws = [invented(rnd, n).encode() for n in (1, 4, 5, 6, 30, 500)]
    together = N.bag_min_hash(*N.Bags()(raws))
    assert all((N.bag_min_hash(*N.Bags()([r]))[0] == together[i]).all() for i, r in enumerate(raws))


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 1000), (2, 3)])
def test_classes_equal_brute_force(spark, seed, block_rows):
    rows = corpus(seed)
    got = sorted((r.id, r.class_id) for r in N.classes(frame(spark, rows), block_rows=block_rows).collect())
    assert got == sorted((k, c) for (k, _), c in zip(rows, brute_classes(rows), strict=True))


def test_chains_and_crowded_buckets(spark):
    """Texts each a little further from the first: neighbours link, the ends do not; and many that share a passage but no link."""
    rnd = random.Random(6)
    w = invented(rnd, 80).split()
    rows = []
    for k in range(14):
        rows.append((k, " ".join(w)))
        w[k * 5] = f"new{k}"
    passage = invented(rnd, 60)
    rows += [(100 + k, passage + " " + invented(rnd, 35)) for k in range(60)]
    got = {r.id: r.class_id for r in N.classes(frame(spark, rows), block_rows=10).collect()}
    assert [got[k] for k, _ in rows] == brute_classes(rows)
    assert {got[k] for k in range(14)} == {0}


def test_keep_one(spark):
    rows = [*corpus(3), (None, "lone row without an id")]
    docs = frame(spark, rows)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.filter("doc_id is not null").collect())
    known = rows[:-1]
    want = sorted({(k, t or "") for (k, t), c in zip(known, brute_classes(known), strict=True) if k == c})
    assert got == want and kept.filter("doc_id is null").count() == 1 and kept.filter("c0 = 'c'").count() == kept.count()


def test_empty(spark):
    assert N.classes(frame(spark, [])).count() == 0
    assert N.classes(frame(spark, [(1, None), (2, "")])).filter(F.col("id") == F.col("class_id")).count() == 2
    assert N.bag_min_hash(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(2, np.int64)).shape == (2, N.M)


def test_components(spark):
    names = [bytes([k]) * 16 for k in range(40)]
    pairs = [(names[k], names[k + 1]) for k in range(0, 30)] + [(names[35], names[33]), (names[35], names[38])]
    got = {bytes(r.node): bytes(r.label) for r in N.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {n: names[0] for n in names[:31]} | {names[k]: names[33] for k in (33, 35, 38)}
