"""Language-model scores, toxicity and quality."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from common import AWKWARD, corpus, frame, invented, words
from oracle import rows_of, rows_of_sql

from velado.llm import lm_score as M
from velado.llm import quality as Q
from velado.llm import toxicity as X


def brute_lm(rows, corpus_rows, order, alpha=0.4, least=2):
    c = Counter()
    for _, t in corpus_rows:
        w = words(t)
        c.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        c[()] += len(w)
    out = []
    for k, t in rows:
        w, s = words(t), 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            back = 0
            while n > 1 and c[tuple(w[i - n + 1 : i + 1])] < least:
                n, back = n - 1, back + 1
            gram = tuple(w[i - n + 1 : i + 1])
            s += back * math.log(alpha) + (math.log(c[gram] / c[gram[:-1]]) if n > 1 else math.log(max(c[gram], 0.5) / max(1, c[()])))
        out.append((k, len(w), round(s, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rows = [*corpus(), (None, "no id here")]
    docs = frame(spark, rows)
    got = [(r.id, r.n_words, round(r.log_score, 6)) for r in M.score(docs, order=order, block_bytes=3000, buckets=8).collect()]
    assert sorted(got, key=str) == sorted(brute_lm(rows, rows, order), key=str)


def test_scores_under_another_corpus(spark):
    rows, other = corpus(1), corpus(2)[:40]
    got = [(r.id, r.n_words, round(r.log_score, 6)) for r in M.score(frame(spark, rows), frame(spark, other), block_bytes=3000, buckets=4).collect()]
    assert sorted(got, key=str) == sorted(brute_lm(rows, other, 3), key=str)
    none = M.score(frame(spark, [(1, "a b"), (2, None)]), frame(spark, [])).collect()
    assert sorted((r.id, r.n_words, round(r.log_score, 6)) for r in none) == [(1, 2, round(2 * math.log(0.5) + math.log(0.4), 6)), (2, 0, 0.0)]
    assert M.score(frame(spark, [])).count() == 0


def test_lm_query_equals_sql(spark, sf_dir):
    assert rows_of(M.op5_lm_score(spark, sf_dir)) == rows_of_sql(M.ORACLE, sf_dir)


def toxic_rows(n=900, seed=1):
    """Label 1 where an insult stands with a group; each alone is harmless."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        t, kind = invented(rnd, rnd.randrange(10, 60)), k % 4
        w = t.split()
        for word in [("scumbags", "idiots")[k % 2]] * (kind in (0, 1)) + [("outlander", "foreigners")[k // 2 % 2]] * (kind in (0, 2)):
            w.insert(rnd.randrange(len(w)), word)
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind == 0)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    rows, labels = toxic_rows()
    held = rows[600:]
    lab = spark.createDataFrame([*labels[:600], (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = X.train(frame(spark, rows), lab)
    got = {r.id: r.score for r in X.score(frame(spark, held + [(9000 + k, t) for k, t in enumerate(AWKWARD)]), model).collect()}
    want = dict(labels)
    right = [(got[k] >= 0.3) == bool(want[k]) for k, _ in held]
    assert np.mean(right) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.3
    x = frame(spark, [(1, "a"), (2, None)])
    assert [r.score for r in X.score(x, X.train(x, lab.limit(0))).collect()] == [0.0, 0.0]
    assert X.score(frame(spark, []), model).count() == 0


def test_quality_orders_grades(spark):
    rnd = random.Random(2)
    rows, grades = [], []
    for k in range(600):
        g = k % 3
        w = [x + ("%%%" if rnd.random() < (0.5, 0.15, 0.01)[g] else "") for x in invented(rnd, rnd.randrange(15, 60)).split()]
        rows.append((k, " ".join(w)))
        grades.append((k, g))
    ratings = spark.createDataFrame([*grades[:400], (None, 1), (2, 9), (3, None)], "doc_id long, grade int")
    model = Q.train(frame(spark, rows), ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.id: r for r in Q.grade(frame(spark, rows[400:] + [(9000, None), (9001, "")]), model).collect()}
    mean = [np.mean([got[k].expected_grade for k, g in grades[400:] if g == want]) for want in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got.values())
    assert got[9000].expected_grade == got[9001].expected_grade
    even = Q.train(frame(spark, rows), ratings.limit(0), 3)
    assert abs(Q.grade(frame(spark, [(1, "a")]), even).first().expected_grade - 1) < 1e-9
    assert Q.grade(frame(spark, []), model).count() == 0


def test_ordinal_slope_is_right():
    """The step of the weights follows the slope of the likelihood (checked by differences)."""
    rng = np.random.default_rng(1)
    y, feats, counts, lengths = [0, 2, 1, 2], rng.integers(0, 50, 20), rng.integers(1, 4, 20), np.array([5, 5, 5, 5])
    model = Q.CumulativeLink(3, rounds=60, rate=0.1).fit(y, feats, counts, lengths)
    tails = model.tails(feats, counts, lengths)
    p = np.concatenate((1 - tails[:, :1], tails[:, :1] - tails[:, 1:], tails[:, 1:]), 1)
    assert (p.argmax(1) == y).all()


def layouts(spark, rows):
    """The same rows in several partitions and orders."""
    for order, parts in ((sorted(rows), 1), (sorted(rows, reverse=True), 7)):
        yield frame(spark, order).repartitionByRange(parts, "doc_id") if parts > 1 else frame(spark, order).coalesce(1)
    yield frame(spark, rows).repartition(5, "text")


def test_scores_do_not_depend_on_the_layout(spark):
    """Equal to the last bit, with repeated documents, ties and a very long text among the rows that train."""
    rows, labels = toxic_rows(400)
    rows += [(k, t) for k, t in rows[:20]] + [(5000, "scumbags outlander " * 20_000), (5001, "same"), (5002, "same")]
    labels += [(5000, 1), (5001, 0), (5002, 1), (5002, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    ratings = spark.createDataFrame([(k, 2 - y) for k, y in labels], "doc_id long, grade int")
    toxic, quality = [], []
    for docs in layouts(spark, rows):
        shuffled = lab.repartition(3)
        toxic.append(sorted((r.id, r.score) for r in X.score(docs, X.train(docs, shuffled)).collect()))
        quality.append(sorted((r.id, r.expected_grade, r.p_ge_2) for r in Q.grade(docs, Q.train(docs, ratings.repartition(2), 3, steps=20, rounds=2)).collect()))
    assert toxic[0] == toxic[1] == toxic[2] and quality[0] == quality[1] == quality[2]


def test_toxicity_score_is_the_sum_over_pairs(spark):
    """Every pair of distinct known features, one by one."""
    rows, labels = toxic_rows(300)
    model = X.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = rows[:25] + [(9000 + k, t) for k, t in enumerate(AWKWARD)]
    at = {f: i + 1 for i, f in enumerate(model.known.tolist())}
    want = {}
    for k, t in held:
        feats = sorted({f for w in X.terms((t or "").encode()) for f in X.hashed(w)})
        known = [model.weights[at[f]].astype(float) for f in feats if f in at]
        s = model.bias + sum(x[0] for x in known) + sum(known[i][1:] @ known[j][1:] for i in range(len(known)) for j in range(i))
        p = 1 / (1 + math.exp(-min(max(s, -30), 30)))
        want[k] = p if known else min(p, model.share)
    assert any(abs(x[1:]).any() for x in model.weights)
    assert {r.id: pytest.approx(r.score, abs=1e-9) for r in X.score(frame(spark, held), model).collect()} == want


def test_quality_slope_equals_differences():
    """The slopes that training follows are those of the negative log-likelihood, by finite differences."""
    rng = np.random.default_rng(1)
    y, lengths = np.array([0, 2, 1, 2, 0, 1]), np.array([5, 4, 6, 5, 0, 4])
    feats, counts = rng.integers(0, 12, lengths.sum()), rng.integers(1, 4, lengths.sum())
    x, own = Q.scaled(counts, lengths), np.repeat(np.arange(len(y)), lengths)
    w, first, steps = rng.normal(0, 1, 12), -0.7, np.array([0.3])

    def loss(w, first, steps):
        t = np.concatenate(([-np.inf], Q.ascending(first, steps), [np.inf]))
        s = np.bincount(own, x * w[feats], len(y))
        return -np.mean([math.log(1 / (1 + math.exp(-(t[g + 1] - v))) - 1 / (1 + math.exp(-(t[g] - v)))) if g < 2 else math.log(1 - 1 / (1 + math.exp(-(t[g] - v)))) for g, v in zip(y, s, strict=True)])

    s = np.bincount(own, x * w[feats], len(y))
    error, move = Q.slopes(y, s, first, steps)
    slope = np.bincount(feats, error[own] * x, 12)
    e = 1e-5
    near = lambda a, b: (loss(*b) - loss(*a)) / (2 * e)
    for k in range(12):
        d = np.eye(12)[k] * e
        assert slope[k] == pytest.approx(near((w - d, first, steps), (w + d, first, steps)), abs=1e-6)
    assert move[0] == pytest.approx(near((w, first - e, steps), (w, first + e, steps)), abs=1e-6)
    assert move[1] == pytest.approx(near((w, first, steps - e), (w, first, steps + e)), abs=1e-6)
