import random

import numpy as np
import pytest
from common import AWKWARD, frame, sha

from velado.llm import substring_dedup as S


def brute(rows, size):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def rows(seed=1):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n))
    shared = [text(rnd.choice((30, 60, 64, 65, 90, 400, 800))) for _ in range(12)]
    out = list(enumerate(AWKWARD))
    for k in range(80):
        out.append((100 + k, text(rnd.randrange(150)) + rnd.choice(shared) * rnd.choice((0, 1, 1, 2)) + text(rnd.randrange(150)) + rnd.choice(shared)))
    out += [(300, "ab" * 300), (301, "z" * 64), (302, "q" * 65), (303, "z" * 63), (304, text(64)), (305, shared[-1]), (305, shared[-1]), (None, text(500))]
    return out


@pytest.mark.parametrize(("size", "q", "block_bytes"), [(64, 5, 3_000_000), (64, 3, 900), (400, 17, 5000)])
def test_equals_brute_force(spark, size, q, block_bytes):
    docs = rows()
    got = [tuple(r) for r in S.dedup(frame(spark, docs), size=size, q=q, block_bytes=block_bytes, buckets=8).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute(docs, size), key=str)


def test_kept_text_and_empty(spark):
    r = S.dedup(frame(spark, [(1, "x" * 10 + "y" * 500), (2, "y" * 450 + "z")]), keep_text=True).orderBy("id").collect()
    assert [bytes(x.kept) for x in r] == [b"x" * 10, b"z"]
    assert S.dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.dedup(frame(spark, []), size=100)


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_difference_sets(q):
    d, v = S.difference_set(q), q * q + q + 1
    assert len(d) == q + 1 and len({(a - b) % v for a in d for b in d}) == v


def test_fingerprints():
    r = S.Running()
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    r.load(data)
    h = r.at(np.arange(4601), 400)
    assert h[1000] == h[3000] and len(set(h.tolist())) == 4600


def test_changed_input_fails(spark, tmp_path):
    from velado.llm import pages

    one = np.arange(3, dtype=np.uint64)
    with pytest.raises(RuntimeError, match="another order"):
        pages.Answers(f"file://{tmp_path}/none", "0").totals(7, one)
    asked = [r for part, k in (("0", 0), ("0", 1), ("corpus-0", 0)) for r in pages.requests(part, k, 7 + k, one + np.uint64(k), np.ones(3, np.int64), 4).to_pylist()]
    folder = pages.answered(spark.createDataFrame(asked, pages.REQUEST), f"file://{tmp_path}/a", "corpus-")
    known = pages.Answers(folder, "0")
    assert known.totals(7, one).tolist() == [2, 3, 3] and known.totals(8, one).tolist() == [3, 3, 1] and known.totals(9, one[:0]).tolist() == []
    for mark, names in ((8, one), (7, one[:2])):
        with pytest.raises(RuntimeError, match="another order"):
            pages.Answers(folder, "0").totals(mark, names)


def test_blocks_and_buckets_of_any_number_give_the_same(spark):
    docs = rows()
    found = [sorted(map(tuple, S.dedup(frame(spark, docs), size=64, q=5, block_bytes=n, buckets=b).select("id", "n_removed", "n_spans", "kept_sha256").collect()), key=str) for n, b in ((300, 2), (5000, 64), (10**6, 4096))]
    assert found[0] == found[1] == found[2]


def test_pages():
    from velado.llm import pages
    from velado.llm.common import pack_page, unpack_page

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 50)))
        assert unpack_page(pack_page(x)).tolist() == x.tolist()
        c = rng.choice([0, 1, 2, 254, 255, 256, 10**12], len(x))
        assert pages.unpack_counts(pages.pack_counts(c)).tolist() == c.tolist()
    same = np.arange(1000, dtype=np.uint64)
    assert unpack_page(pack_page(same)).tolist() == same.tolist()
