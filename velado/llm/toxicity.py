"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed lower-case terms. The score is sigmoid(b + sum of w + half of (the squared sum of v
less the sum of squared v)), so that pairs of terms (an insult and the mention of a group) weigh beyond what each weighs
alone. It is trained by AdaGrad with a proximal step that sets unhelpful weights to zero; terms that fewer than
`min_docs` sampled documents have keep weight zero.

Nulls and edges: a null or empty text, or one of unknown terms only, gets the score of the bias, lowered to the training
share of label 1; without any training row every score is 0. Null labels and ids do not train. Repeated labels of one
document count as one, the largest. Every text is scored whole. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_doc, id_text
from .features import Featurizer, bucket, in_fold, sample, terms

BITS = 20


def hashed(term: bytes) -> list[int]:
    """The term, and its first three to six letters, which inflected forms share."""
    w = term.decode("utf-8", "replace")
    return [bucket(b"t" + term, BITS), *(bucket(f"{k}{w[:k]}".encode(), BITS) for k in (3, 4, 5, 6) if len(w) >= k)]


def term_features() -> Featurizer:
    return Featurizer(terms, hashed)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class FactorizationMachine:
    def __init__(self, rank: int = 4, rounds: int = 20, rate: float = 0.05, l1: float = 3e-3, min_docs: int = 5, seed: int = 7):
        self.rank, self.rounds, self.rate, self.l1, self.min_docs, self.seed = rank, rounds, rate, l1, min_docs, seed
        #: features with weights, sorted; row k of weights holds w and v of feature k - 1, row 0 is that of all others.
        self.known, self.weights, self.bias, self.share = np.empty(0, np.int64), np.zeros((1, 1 + rank), np.float32), -30.0, 0.0

    def _rows(self, feats: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(feats), np.int64)
        at = np.minimum(np.searchsorted(self.known, feats), len(self.known) - 1)
        return np.where(self.known[at] == feats, at + 1, 0)

    def fit(self, y: list[int], feats: np.ndarray, lengths: np.ndarray) -> FactorizationMachine:
        if not len(y):
            return self
        y = np.array(y, float)
        self.share = float(y.mean())
        self.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        names, docs = np.unique(feats, return_counts=True)
        self.known = names[docs >= self.min_docs]
        rng = np.random.default_rng(self.seed)
        size = len(self.known) + 1
        w = np.concatenate((np.zeros((size, 1)), rng.normal(0, 0.02, (size, self.rank))), axis=1)
        w[0] = 0
        squares, bias_square = np.full_like(w, 1e-2), 1e-2
        rows = self._rows(feats)
        doc = np.repeat(np.arange(len(y)), lengths)
        doc, rows = doc[rows > 0], rows[rows > 0]
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(y))))
        for turn in range(self.rounds):
            if turn in (3, 8):  # what the proximal step holds at zero is left out of the later rounds
                live = (w[rows] != 0).any(1)
                doc, rows = doc[live], rows[live]
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(y))))
            for lot in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                n = ends[lot + 1] - ends[lot]
                at = np.repeat(ends[lot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own, r = np.repeat(np.arange(len(lot)), n), rows[at]
                seen, r = np.unique(r, return_inverse=True)
                x = w[seen][r]
                sums = np.stack([np.bincount(own, x[:, k], len(lot)) for k in range(w.shape[1])], 1)
                pairs = 0.5 * (sums[:, 1:] ** 2 - np.stack([np.bincount(own, x[:, k] ** 2, len(lot)) for k in range(1, w.shape[1])], 1)).sum(1)
                error = (sigmoid(self.bias + sums[:, 0] + pairs) - y[lot]) / len(lot)
                each = error[own]
                slope = np.stack([np.bincount(r, each, len(seen)), *(np.bincount(r, each * (sums[own, k] - x[:, k]), len(seen)) for k in range(1, w.shape[1]))], 1)
                squares[seen] += slope**2
                step = self.rate / np.sqrt(squares[seen])
                new = w[seen] - step * slope
                w[seen] = np.sign(new) * np.maximum(np.abs(new) - step * self.l1, 0)
                bias_square += error.sum() ** 2
                self.bias -= self.rate * float(error.sum()) / bias_square**0.5
        self.weights = w.astype(np.float32)
        return self

    def score(self, feats: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows = self._rows(feats)
        x = self.weights[rows].astype(float)
        sums = np.stack([by_doc(x[:, k], lengths) for k in range(x.shape[1])], 1)
        squares = by_doc((x[:, 1:] ** 2).sum(1), lengths)
        out = sigmoid(self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares))
        return np.where(by_doc((rows > 0).astype(int), lengths) > 0, out, np.minimum(out, self.share))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 12_000, **options) -> FactorizationMachine:
    """Fits on at most `rows` labelled documents (and 6 million features); labels must hold the training fold only."""
    one = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("long").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    y, feats, _, lengths = sample(docs, one, rows, term_features, id_col=id_col, text_col=text_col)
    return FactorizationMachine(**options).fit(y, feats, lengths)


def score(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000) -> DataFrame:
    """(id, score) of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = term_features()
        for ids, raws in blocks(batches, block_bytes):
            feats, _, n = featurize(raws)
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(feats, n))], names=["id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(apply, "id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(~in_fold("doc_id", 4, 2)))
    scored = score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
