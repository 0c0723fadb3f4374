import re

import pytest
from common import corpus, frame, sha

from velado.llm import exact_dedup as E


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), k is not None, k or 0, k))
    out, used = [], set()
    for k, t in rows:
        g = groups[norm(t)]
        best = min(g)
        first = (-len(t or ""), k is not None, k or 0, k) == best and norm(t) not in used
        if first:
            used.add(norm(t))
        out.append((k, best[3], len(g), first, sha(norm(t))))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[3], r[4])


ROWS = [*corpus(), (None, " A\tb"), (9999, "A b    \n"), (9998, "A  b  \n "), (50, " "), (51, "  ")]


@pytest.mark.parametrize("options", [{}, {"memtable_rows": 7, "buckets": 4}, {"digest_size": 1, "buckets": 2}])
def test_groups_equal_brute_force(spark, options):
    """With digests of one byte nearly all collide, and the texts themselves decide."""
    got = [(r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.groups(frame(spark, ROWS), **options).collect()]
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)


@pytest.mark.parametrize("options", [{}, {"digest_size": 1}])
def test_deduplicate_keeps_columns(spark, options):
    docs = frame(spark, ROWS)
    kept = E.deduplicate(docs, **options)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.c0) for r in kept.collect()) == sorted((r[0] is not None, r[0] or 0, t or "", "c") for r, (_, t) in zip(brute(ROWS), ROWS, strict=True) if r[3])


def test_index_grows(spark):
    index = E.LsmIndex(spark, buckets=4, memtable_rows=5)
    index.add(frame(spark, ROWS[:30])).compact()
    hits = {bytes(r.digest): r.group_size for r in index.add(frame(spark, ROWS[30:])).compact().hits().collect()}
    want = {}
    for *_, n, _, s in brute(ROWS):
        if n > 1:
            want[bytes.fromhex(s)] = n
    assert hits == want


def test_empty(spark):
    assert E.groups(frame(spark, [])).count() == 0 and E.deduplicate(frame(spark, [])).count() == 0


def test_buckets_follow_the_rows(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "cast(id % 300 as string) as text")
    assert E.buckets_for(docs) == 256 and 2 * 1000 // 3 <= 3 * E.buckets_for(docs, each=3, least=2) <= 4 * 1000
    assert E.groups(docs).filter("kept").count() == 300
