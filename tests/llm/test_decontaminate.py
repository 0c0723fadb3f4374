import random

import pytest
from common import AWKWARD, corpus, frame, invented, sha, words

from velado.llm import decontaminate as D


def brute(rows, items, size=8):
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name or "")
    out = []
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return out


def inputs(seed=1):
    rnd = random.Random(seed)
    items = [(str(k), invented(rnd, rnd.randrange(3, 30))) for k in range(25)]
    items += [("10", "short one"), ("9", None), ("8", "..."), (None, "ghost item"), ("7", items[0][1]), ("7", "second text of seven here")]
    rows = corpus(seed)
    for k in range(60):
        name, t = rnd.choice(items)
        w = (t or "").split()
        cut = " ".join(w[rnd.randrange(3) :]) if k % 3 else (t or "")
        rows.append((4000 + k, f"{invented(rnd, 9)} {cut.upper()}, {invented(rnd, 9)}; {rnd.choice(items)[1] or ''}"))
    rows += [(5000, "ghost"), (5001, "item ghost"), (5002, "xx ghost-item"), (5003, "short"), (5004, "one"), (None, "short one")]
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame([(n, t, "x", 1) for n, t in items], "item_id string, text string, name string, raw int")


@pytest.mark.parametrize(("segment_bytes", "chunk_bytes"), [(4_000_000, 32_000_000), (700, 300)])
def test_report_equals_brute_force(spark, tmp_path, segment_bytes, chunk_bytes):
    rows, items = inputs()
    index = D.build_index(frame(spark, rows), f"file://{tmp_path}/i", segment_bytes=segment_bytes)
    found = D.report(D.search(index, benchmark(spark, items), chunk_bytes=chunk_bytes))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, items), key=str)
    assert any(r[5] for r in got)


def test_every_posting_is_there(spark, tmp_path):
    rows, _ = inputs()
    index = D.build_index(frame(spark, rows), f"file://{tmp_path}/i", segment_bytes=3000)
    n = sum(len(r.positions) // 4 for r in index.collect())
    assert n == sum(len(words(t)) for _, t in rows)


def test_near(spark, tmp_path):
    docs = [(1, "alpha x x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha x x x x x x beta x gamma"), (5, "gamma"), (6, "beta alpha")]
    index = D.build_index(frame(spark, docs), f"file://{tmp_path}/i")
    found = D.search(index, benchmark(spark, [("a", "alpha beta gamma")]), slop=5)
    assert sorted(r.doc_id for r in found.collect() if r["items"]) == [1, 2]


def test_empty(spark, tmp_path):
    rows, items = inputs()
    none = D.report(D.search(D.build_index(frame(spark, rows), f"file://{tmp_path}/a"), benchmark(spark, [])))
    assert none.filter("n_hit = 0 and n_items = 0 and not contaminated").count() == len(rows)
    assert D.search(D.build_index(frame(spark, []), f"file://{tmp_path}/b"), benchmark(spark, items)).count() == 0
    assert len(AWKWARD) > 10
