import random

import pytest
from common import frame
from pyspark.sql import functions as F

from velado.llm import features, toxicity


def documents(n=300):
    rnd = random.Random(8)
    return [(k, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 40)))) for k in range(n)]


def drawn(spark, rows, entries, order):
    docs = frame(spark, sorted(rows, key=order)).repartitionByRange(5, "doc_id") if order is None else frame(spark, sorted(rows, key=order)).coalesce(1)
    labels = spark.createDataFrame([(k, k) for k in {k for k, _ in rows}], "id long, y long")
    y, feats, counts, n = features.sample(docs, labels, 250, toxicity.term_features, entries=entries)
    return y, feats.tolist(), counts.tolist(), n.tolist()


@pytest.mark.parametrize("entries", [0, 1000, 4000, 10**6])
def test_the_smallest_hashes_whatever_the_order(spark, entries):
    rows = documents()
    first, last, by_range = (drawn(spark, rows, entries, o) for o in (lambda r: r[0], lambda r: -r[0], None))
    assert first == last == by_range
    size = dict(zip((k for k, _ in rows), toxicity.term_features()([t.encode() for _, t in rows])[2].tolist(), strict=True))
    ids = [r.id for r in spark.range(300).orderBy(F.xxhash64("id"), "id").limit(250).collect()]
    want, total = [], 0
    for k in (k for k in ids if size[k] <= entries):
        if total + size[k] > entries:
            break
        want.append(k)
        total += size[k]
    assert first[0] == want and sum(first[3]) == len(first[1]) == total <= entries


def test_copies_of_a_document_and_one_too_large(spark):
    rows = [(1, "a b c d")] * 5 + [(2, " ".join(map(str, range(500))))]
    y, _, _, n = drawn(spark, rows, 10, lambda r: r[0])
    assert y == [1, 1] and n == [4, 4]
