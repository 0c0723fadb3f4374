import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from common import AWKWARD, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from velado.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=200))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.uint64))
    f = T.EliasFano.from_bytes(T.EliasFano.of(v).to_bytes())
    assert f.all().tolist() == v.tolist() == [f[i] for i in range(len(v))]


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(1).integers(0, 10**6, 10_000).astype(np.uint64))
    assert len(T.EliasFano.of(v).to_bytes()) * 8 < 10_000 * 12


def test_words_give_the_whole_texts_ids():
    rnd = random.Random(5)
    pieces = [" ", "  ", "\n", " \n", "a", "the", "'s", "é", "1", ".", "　", "\x1c", "\x85", "日本", "\t", "!!", "<|endoftext|>"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(4000)] + [t or "" for t in AWKWARD]
    tok = T._tokenizer(PATH)
    e = T.WordEncoder(tok, np.dtype("<u2"))
    e.limit = 500  # the table is trimmed again and again
    for lot in range(0, len(texts), 300):
        ids, n = e.encode(texts[lot : lot + 300])
        want = [x.ids for x in tok.encode_batch(texts[lot : lot + 300], add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("shard_ids", [32_000_000, 50])
def test_files_hold_every_document(spark, tmp_path, shard_ids):
    rows = [*corpus(), (None, "no id"), (None, None)]
    files = T.write_token_files(frame(spark, rows), f"file://{tmp_path}/t", PATH, end_id=2, shard_ids=shard_ids, block_bytes=1000)
    got = [tuple(r) for r in T.read_token_files(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tok, at, want = T._tokenizer(PATH), 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    f = T.TokenFile(files[0]["path"])
    whole = np.split(f.ids(), f.bounds.all()[1:-1].astype(int))
    assert [f.document(i).tolist() for i in range(f.n_docs)] == [x.tolist() for x in whole]
    if shard_ids == 50:
        assert len(files) > 10


def test_empty_table(spark, tmp_path):
    files = T.write_token_files(frame(spark, []), f"file://{tmp_path}/t", PATH, end_id=2)
    assert files == [] and T.read_token_files(spark, files).count() == 0


def test_not_a_token_file(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        T.TokenFile(f"file://{tmp_path}/x")
