import random

import numpy as np
import pytest
from common import frame
from test_language import labelled, text

from velado.llm import language as L


def glued(rnd, lang, n):
    return text(rnd, lang, n).replace(" ", "")[:n]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(frame(spark, labelled()), rows=150)


@pytest.mark.parametrize("n", [1, 40, 41, 80, 81, 1234])
def test_pieces_hold_every_letter(n):
    word = "".join(random.Random(n).choice("abcß") for _ in range(n))
    pieces = L.pieces_of(word)
    assert "".join(x.strip(L.CUT) for x in pieces) == word and max(len(x.strip(L.CUT)) for x in pieces) <= L.PIECE
    assert pieces == [word] if n <= 40 else all(x.endswith(L.CUT) for x in pieces[:-1]) and all(x.startswith(L.CUT) for x in pieces[1:])


def test_the_middle_of_a_run_counts(spark, model):
    rnd = random.Random(4)
    run = glued(rnd, "de", 20) + glued(rnd, "fr", 2000) + glued(rnd, "de", 20)
    rows = {r.id: r for r in L.predict(frame(spark, [(1, run), (2, f"{text(rnd, 'de', 30)} {run} {text(rnd, 'de', 30)}")]), model).collect()}
    assert rows[1].lang_pred == "fr" and rows[1].score > 0.9 and rows[1].n_words == 1 and rows[1].n_switches == 0
    assert rows[2].lang_pred == "fr" and rows[2].n_words == 61


def test_a_run_is_the_mean_of_its_pieces(model):
    rnd = random.Random(6)
    run = glued(rnd, "fr", 400) + glued(rnd, "en", 400)
    p, letters, n = L.Labeller(model)([b"", f"{text(rnd, 'en', 3)} {run} eau".encode(), b"the"])
    assert n.tolist() == [0, 5, 1] and letters[3] == 800 and len(p) == 6 and np.allclose(p.sum(1), 1)
    assert 0.35 < p[3, 2] < 0.65 and 0.35 < p[3, 1] < 0.65
