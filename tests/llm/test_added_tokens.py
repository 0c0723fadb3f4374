import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from common import frame
from tokenizers import AddedToken, Tokenizer

from velado.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", " \n", "a", "the", "é", "1", ".", "\t", "日本", "<|endoftext|>", "<|endoftext|>", "<|end", "oftext|>", "[X]"]


def texts(seed, n=3000):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12))) for _ in range(n)]


def check(encoder, plain, some):
    for lot in range(0, len(some), 300):
        ids, n = encoder.encode(some[lot : lot + 300])
        want = [x.ids for x in plain.encode_batch(some[lot : lot + 300], add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_marker_has_its_own_id():
    ids, n = T.WordEncoder(T._tokenizer(PATH), np.dtype("<u2")).encode(["a <|endoftext|> b"])
    assert ids.tolist() == [64, 220, 50256, 275] and n.tolist() == [4]


def test_ids_of_a_plain_tokenizer():
    check(T.WordEncoder(T._tokenizer(PATH), np.dtype("<u2"), limit=500), Tokenizer.from_file(PATH), ["<|endoftext|>", "", *texts(3)])


@pytest.mark.parametrize("token", [AddedToken("[X]"), AddedToken("[X]", lstrip=True, rstrip=True), AddedToken("<|endoftext|><|end", special=True), AddedToken("[X]", single_word=True)])
def test_further_added_tokens(tmp_path, token):
    t = Tokenizer.from_file(PATH)
    (t.add_special_tokens if token.special else t.add_tokens)([token])
    path = str(tmp_path / "t.json")
    t.save(path)
    check(T.WordEncoder(T._tokenizer(path), np.dtype("<u4"), limit=500), Tokenizer.from_file(path), texts(4))


def test_starts_after_a_marked_document(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "c d"), (3, None)]
    files = T.write_token_files(frame(spark, rows), f"file://{tmp_path}/t", PATH, end_id=2)
    t, at, want = Tokenizer.from_file(PATH), 0, []
    for k, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in T.read_token_files(spark, files).collect()) == want
