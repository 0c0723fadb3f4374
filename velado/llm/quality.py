"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold k - s), where s is one linear score of hashed text features that all grades share, and
the thresholds ascend. From it follow the expected grade and the tail probabilities P(grade >= k) to select by. Features
are counts, scaled to length 1: whole tokens, and their shapes (marks at the end, marks within, kind of characters,
length), which also say something of tokens never seen.

Nulls and edges: a null or empty text has no feature, so s = 0, and its grade is that of the thresholds alone; without
training rows every grade is equally likely. Null grades and ids do not train; of several grades of one document the
smallest counts. Every text is scored whole. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_doc, id_text
from .features import Featurizer, bucket, in_fold, sample, tokens
from .toxicity import sigmoid

BITS = 18
_TAIL = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")
_KIND = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 98 if c >= 128 else c for c in range(256))


def token_features(w: bytes) -> list[int]:
    mark = _TAIL.search(w)
    kind = w.translate(_KIND)
    shape = bytes(dict.fromkeys(kind))
    return [bucket(x, BITS) for x in (b"w" + w.lower(), b"m" + (mark[0] if mark else b""), b"k" + shape[:8], b"n%d" % min(len(w), 30))]


def make() -> Featurizer:
    return Featurizer(tokens, token_features)


def scaled(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    norm = np.sqrt(by_doc((counts**2).astype(float), lengths))
    return counts / np.repeat(np.maximum(norm, 1e-9), lengths)


def ascending(first: float, steps: np.ndarray) -> np.ndarray:
    """Thresholds: the first, then the exponentials of the steps."""
    return np.concatenate(([first], first + np.cumsum(np.exp(steps))))


def slopes(y: np.ndarray, s: np.ndarray, first: float, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean negative log-likelihood of grades y: by each row's score s, and by `first` and the steps."""
    t, n = ascending(first, steps), len(y)
    # Cumulative probabilities at both edges of each row's own grade, and their slopes.
    edge = sigmoid(np.concatenate((np.full((n, 1), -30.0), t[None, :] - s[:, None], np.full((n, 1), 30.0)), 1))
    hi, lo = edge[np.arange(n), y + 1], edge[np.arange(n), y]
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    d_t = np.zeros(len(t) + 2)
    np.add.at(d_t, y + 1, -d_hi / n)
    np.add.at(d_t, y, d_lo / n)
    d_t = d_t[1:-1]
    return (d_hi - d_lo) / n, np.concatenate(([d_t.sum()], [d_t[k + 1 :].sum() * np.exp(steps[k]) for k in range(len(steps))]))


class CumulativeLink:
    def __init__(self, grades: int, rounds: int = 15, steps: int = 600, rate: float = 0.2, l2: float = 1e-5, seed: int = 5):
        """rounds over the sample, or more where it is so small that they make fewer than `steps` steps."""
        self.grades, self.rounds, self.steps, self.rate, self.l2, self.seed = grades, rounds, steps, rate, l2, seed
        k = np.arange(1, grades)
        self.thresholds = np.log(k / (grades - k))
        self.weights = np.zeros(1 << BITS)

    def fit(self, y: list[int], feats: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> CumulativeLink:
        if not len(y):
            return self
        y, x = np.array(y, int), scaled(counts, lengths)
        below = np.array([(np.sum(y < k) + 0.5) / (len(y) + 1) for k in range(1, self.grades)])
        first, steps = np.log(below / (1 - below)), None
        # Thresholds ascend by construction: the first, then the exponentials of the steps.
        steps = np.log(np.maximum(np.diff(first), 1e-3))
        first = first[0]
        rng, ends = np.random.default_rng(self.seed), np.append(0, np.cumsum(lengths))
        square, t_square = np.full(1 << BITS, 1e-4), np.full(self.grades - 1, 1e-2)
        lots = max(1, len(y) // 128)
        for _ in range(max(self.rounds, -(-self.steps // lots))):
            for lot in np.array_split(rng.permutation(len(y)), lots):
                n = ends[lot + 1] - ends[lot]
                at = np.repeat(ends[lot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = np.repeat(np.arange(len(lot)), n)
                seen, r = np.unique(feats[at], return_inverse=True)
                s = np.bincount(own, x[at] * self.weights[seen][r], len(lot))
                error, move = slopes(y[lot], s, first, steps)
                slope = np.bincount(r, error[own] * x[at], len(seen)) + self.l2 * self.weights[seen]
                square[seen] += slope**2
                self.weights[seen] -= self.rate * slope / np.sqrt(square[seen])
                t_square += move**2
                move *= 0.1 / np.sqrt(t_square)
                first, steps = first - move[0], steps - move[1:]
        self.thresholds = ascending(first, steps)
        return self

    def tails(self, feats: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1 and up, a column each."""
        s = by_doc(scaled(counts, lengths) * self.weights[feats], lengths)
        return sigmoid(s[:, None] - self.thresholds[None, :])


def train(docs: DataFrame, ratings: DataFrame, grades: int, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows: int = 12_000, **options) -> CumulativeLink:
    """Fits on at most `rows` rated documents (and 6 million features); grades are 0 .. grades - 1."""
    one = ratings.select(ratings[id_col].cast("long").alias("id"), ratings[grade_col].cast("long").alias("y")).filter(F.col("y").between(0, grades - 1)).groupBy("id").agg(F.min("y").alias("y"))
    y, feats, counts, lengths = sample(docs, one, rows, make, id_col=id_col, text_col=text_col)
    return CumulativeLink(grades, **options).fit(y, feats, counts, lengths)


def grade(docs: DataFrame, model: CumulativeLink, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000) -> DataFrame:
    """(id, expected_grade, p_ge_1, p_ge_2, ...) of each row."""
    tails = [f"p_ge_{k}" for k in range(1, model.grades)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = make()
        for ids, raws in blocks(batches, block_bytes):
            p = model.tails(*featurize(raws))
            yield pa.RecordBatch.from_arrays([ids, pa.array(p.sum(1)), *(pa.array(p[:, k].copy()) for k in range(p.shape[1]))], names=["id", "expected_grade", *tails])

    return id_text(docs, id_col, text_col).mapInArrow(apply, "id long, expected_grade double, " + ", ".join(f"{t} double" for t in tails))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades from the two labels: 0 low quality, 1 good but toxic, 2 good. A fifth of the rows is held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.filter(~in_fold("doc_id", 5, 0)).select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    found = grade(docs, train(docs, ratings, 3)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "expected_grade", "p_ge_1", "p_ge_2", (F.col("p_ge_1") >= 0.5).alias("selected"))
