"""Language ID: a linear-chain conditional random field over the words of a text.

Words are runs of letters. A run of over 40 of them, as in glued words or a script without spaces, is cut into even pieces
of at most 40, which are labelled like words; its label probabilities are the mean of theirs by letters. A word's label scores are sums of weights of its affixes, character n-grams and itself (the
lexicon), and learned transitions say how readily one language follows another; forward-backward gives each word's label
probabilities, so a text that switches languages is labelled word by word. A document's language is the one with the
largest sum of them (words weigh by their letters), its score the share of that sum.

Training texts have one label each. Sequences are spliced from pieces of several texts, so that the switches that the
transitions must learn occur; whole texts are used for prediction.

Predicting runs over all words of a block as one chain, in which a document's first word forgets what came before. The
chain is cut into equal chunks: products of the step matrices of each chunk, a scan over the chunks, then both passes
inside all chunks at once; this is exact and needs no loop over words.

Nulls and edges: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts first;
without training rows everything is `und`. Repeated rows each get their row. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ragged, Words, blocks, by_doc, id_text, let_go
from .features import in_fold

BITS = 18
UNKNOWN = "und"
#: Letters of a piece at most, and the mark of a side where a longer run was cut (no letter, so in no word).
PIECE, CUT = 40, "\0"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(raw: bytes) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower())


def pieces_of(word: str) -> list[str]:
    """The word itself, or even pieces of a run longer than PIECE."""
    if len(word) <= PIECE:
        return [word]
    k = -(-len(word) // PIECE)
    bounds = [len(word) * i // k for i in range(k + 1)]
    return [CUT * (i > 0) + word[bounds[i] : bounds[i + 1]] + CUT * (i < k - 1) for i in range(k)]


def units_of(raw: bytes) -> list[str]:
    """words_of, longer runs in pieces."""
    words = words_of(raw)
    return words if max(map(len, words), default=0) <= PIECE else [x for w in words for x in pieces_of(w)]


def word_features(word: str) -> list[int]:
    """Hashed: the word, its affixes of up to three letters, and its character n-grams of one to three letters.

    A piece has the n-grams of its letters; affixes only where its run begins or ends.
    """
    w, begins, ends = word.strip(CUT), word[0] != CUT, word[-1] != CUT
    b = "^" * begins + w + "$" * ends
    names = {*w}
    if begins and ends:
        names.add(f"w{w}")
    if begins:
        names.update(f"p{w[:k]}" for k in (1, 2, 3))
    if ends:
        names.update(f"s{w[-k:]}" for k in (1, 2, 3))
    names.update(b[i : i + 2] for i in range(len(b) - 1))
    names.update(b[i : i + 3] for i in range(len(b) - 2))
    return [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names]


class CRF:
    def __init__(self, labels: list[str], rounds: int = 3, rate: float = 0.3, seed: int = 3):
        self.labels, self.rounds, self.rate, self.seed = sorted(labels), rounds, rate, seed
        n = len(labels)
        self.weights, self.moves, self.start = np.zeros((1 << BITS, n), np.float32), np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[tuple[list[str], int]], length: int = 48, sequences: int = 4000, lot: int = 100) -> CRF:
        """texts: (words, label number). Each sequence is spliced from up to three pieces of texts."""
        texts = [t for t in texts if t[0]]
        if not texts or len(self.labels) < 1:
            return self
        rng, words, feats = np.random.default_rng(self.seed), Words(10**9), Ragged(np.int64)
        by_label = {y: [k for k, t in enumerate(texts) if t[1] == y] for y in {t[1] for t in texts}}
        kinds = sorted(by_label)
        x, y = np.empty((sequences, length), np.int32), np.empty((sequences, length), np.int64)
        for k in range(sequences):
            pieces, at = rng.choice((1, 1, 2, 3)), 0
            cuts = sorted({*rng.integers(1, length, pieces - 1).tolist(), length})
            for cut in cuts:
                own = by_label[kinds[rng.integers(len(kinds))]]
                source, label = texts[own[rng.integers(len(own))]]
                first = int(rng.integers(max(1, len(source) - (cut - at) + 1)))
                piece = [source[(first + i) % len(source)] for i in range(cut - at)]
                x[k, at:cut], y[k, at:cut], at = words.numbers(piece), label, cut
        feats.append([word_features(w) for w in words.take()])
        squares, move_squares, start_squares = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-1), np.full_like(self.start, 1e-1)
        n = len(self.labels)
        for _ in range(self.rounds):
            for rows in np.array_split(rng.permutation(sequences), max(1, sequences // lot)):
                seen, r = np.unique(x[rows], return_inverse=True)
                flat, k = feats.gather(seen)
                own = np.repeat(np.arange(len(seen)), k)
                emit = np.stack([np.bincount(own, self.weights[flat, j], len(seen)) for j in range(n)], 1)
                e = np.exp(np.clip(emit, -30, 30))[r.reshape(len(rows), length)]
                gold = np.eye(n)[y[rows]]
                node, edge = self._expected(e)
                wrong = (node - gold) / len(rows)
                per_word = np.stack([np.bincount(r.reshape(-1), wrong[:, :, j].reshape(-1), len(seen)) for j in range(n)], 1)
                names, back = np.unique(flat, return_inverse=True)
                slope = np.stack([np.bincount(back, per_word[own, j], len(names)) for j in range(n)], 1)
                squares[names] += slope**2
                self.weights[names] -= self.rate * slope / np.sqrt(squares[names])
                m = (edge - np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])) / len(rows)
                move_squares += m**2
                self.moves -= self.rate * m / np.sqrt(move_squares)
                s = wrong[:, 0].sum(0)
                start_squares += s**2
                self.start -= self.rate * s / np.sqrt(start_squares)
        return self

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each place, and expected counts of transitions, of equally long sequences."""
        moves, start = np.exp(self.moves), np.exp(self.start)
        lots, length, n = e.shape
        a, b = np.empty_like(e), np.ones_like(e)
        a[:, 0] = start * e[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            a[:, t] = (a[:, t - 1] @ moves) * e[:, t]
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        edge = np.zeros((n, n))
        for t in range(length - 2, -1, -1):
            right = e[:, t + 1] * b[:, t + 1]
            pair = a[:, t, :, None] * moves * right[:, None, :]
            edge += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b[:, t] = right @ moves.T
            b[:, t] /= b[:, t].sum(1, keepdims=True)
        node = a * b
        return node / node.sum(2, keepdims=True), edge

    def emissions(self, feats: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Label scores of words from their features, exponentiated (the largest is 1)."""
        scores = np.stack([by_doc(self.weights[feats, j].astype(float), k) for j in range(len(self.labels))], 1)
        return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60))

    def marginals(self, e: np.ndarray, first: np.ndarray, steps: int = 128) -> np.ndarray:
        """Label probabilities of each word of one chain; `first` marks words that begin a document."""
        total, n = e.shape
        if not total:
            return e
        moves, start = np.exp(self.moves - self.moves.max()), np.exp(self.start - self.start.max())
        chunks = -(-total // steps)
        pad = chunks * steps - total
        e = np.concatenate((e, np.ones((pad, n)))).reshape(chunks, steps, n)
        first = np.concatenate((first, np.ones(pad, bool))).reshape(chunks, steps)
        # Products of a chunk's step matrices: row i is the forward vector that starts from label i before the chunk.
        p = np.broadcast_to(np.eye(n), (chunks, n, n)).copy()
        for t in range(steps):
            moved = p @ moves
            f = first[:, t]
            if f.any():
                moved[f] = p[f].sum(2, keepdims=True) * start
            p = moved * e[:, t, None, :]
            p /= p.sum((1, 2), keepdims=True)
        before, after = np.empty((chunks, n)), np.empty((chunks, n))
        v = np.full(n, 1 / n)
        for c in range(chunks):
            before[c] = v
            v = v @ p[c]
            v = v / v.sum()
        v = np.ones(n)
        for c in range(chunks - 1, -1, -1):
            after[c] = v
            v = p[c] @ v
            v = v / v.sum()
        a = np.empty_like(e)
        v = before
        for t in range(steps):
            v = np.where(first[:, t, None], start, v @ moves) * e[:, t]
            v = v / v.sum(1, keepdims=True)
            a[:, t] = v
        v = after
        for t in range(steps - 1, -1, -1):
            a[:, t] *= v
            right = v * e[:, t]
            v = np.where(first[:, t, None], 1.0, right @ moves.T)
            v = v / v.sum(1, keepdims=True)
        a = a.reshape(-1, n)[:total]
        return a / a.sum(1, keepdims=True)


class Labeller:
    """Blocks of texts -> label probabilities of their words; a word's features are looked up once while in the table."""

    def __init__(self, model: CRF):
        self.model, self.words = model, Words(250_000)
        self.emit, self.letters = np.zeros((0, len(model.labels))), np.zeros(0, np.int64)
        self.inner = np.zeros(0, bool)  # pieces that do not begin their run

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities by word, letters by word, words by document)."""
        if left := self.words.trim():
            self.emit, self.letters, self.inner = self.emit[:left].copy(), self.letters[:left].copy(), self.inner[:left].copy()
        parts = [self.words.numbers(units_of(raw)) for raw in raws]
        if fresh := self.words.take():
            for i in range(0, len(fresh), 20_000):
                lists = Ragged(np.int32)
                lists.append([word_features(w) for w in fresh[i : i + 20_000]])
                self.emit = np.concatenate((self.emit, self.model.emissions(lists.values, np.diff(lists.ends))))
            self.letters = np.append(self.letters, np.fromiter((sum(map(str.isalpha, w)) for w in fresh), np.int64, len(fresh)))
            self.inner = np.append(self.inner, np.fromiter((w[0] == CUT for w in fresh), bool, len(fresh)))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        p, letters, begins = self.model.marginals(self.emit[flat], first), self.letters[flat], ~self.inner[flat]
        if begins.all():
            return p, letters, n
        # Runs from their pieces; one of no letters at all has the plain mean.
        at, weight = np.flatnonzero(begins), np.maximum(letters, 1e-9)
        p = np.add.reduceat(p * weight[:, None], at) / np.add.reduceat(weight, at)[:, None]
        return p, np.add.reduceat(letters, at), by_doc(begins.astype(np.int64), n)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 4000, words: int = 200, **options) -> CRF:
    """Fits on `words` words (from a place that the id decides) of at most `rows` documents of the training fold.

    Rows are shared out evenly among the languages, those with the smallest hashes of id first. An id that occurs several
    times trains once, with its least language and, of that, the text of the least hash.
    """
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].alias("lang")).filter("id is not null and lang is not null")
    labels = sorted(r.lang for r in d.select("lang").distinct().collect())
    if not labels:
        return CRF([])
    each = [d.filter(F.col("lang") == x).orderBy(F.xxhash64("id"), "id").limit(-(-rows // len(labels))) for x in labels]
    chosen = each[0]
    for x in each[1:]:
        chosen = chosen.unionByName(x)
    # At most one row of an id, so at most `rows` of them: repeated ids count against the bound, and of their texts one trains.
    chosen = chosen.groupBy("id").agg(F.min("lang").alias("lang"))
    texts = id_text(docs, id_col, text_col, lang_col).toDF("id", "raw", "lang").join(F.broadcast(chosen), ["id", "lang"]).select("id", "raw", "lang", F.xxhash64("raw").alias("hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = units_of(raw)
                at = xxhash.xxh32_intdigest(str(k)) % max(1, len(w) - words + 1)
                found.append(w[at : at + words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2), batch.column(3)], names=["id", "words", "lang", "hash"])

    number = {x: k for k, x in enumerate(labels)}
    pieces = texts.mapInArrow(cut, "id long, words array<string>, lang string, hash long").groupBy("id", "lang").agg(F.min(F.struct("hash", "words")).alias("one"))
    got = sorted(pieces.select("id", "one.words", "lang").collect(), key=lambda r: (r.id, r.words))
    return CRF(labels, **options).fit([(r.words, number[r.lang]) for r in got])


def predict(docs: DataFrame, model: CRF, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000, keep: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_words, n_switches); with `keep`, docs with lang_pred and score beside its own columns."""
    names = np.array([*model.labels, UNKNOWN], object)

    def label(raws: list[bytes], labeller: Labeller) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        if not model.labels:
            return [UNKNOWN] * len(raws), np.zeros(len(raws)), np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
        p, letters, n = labeller(raws)
        sums = np.stack([by_doc(p[:, j] * letters, n) for j in range(p.shape[1])], 1)
        best, total = sums.argmax(1), sums.sum(1)
        own = p.argmax(1) if len(p) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        switch = np.zeros(len(own), np.int64)
        switch[1:] = (own[1:] != own[:-1]) & (doc[1:] == doc[:-1])
        # A fraction or a superscript makes a word of no letters, which says nothing.
        known = by_doc(letters, n) > 0
        score = np.where(known, np.clip(sums[np.arange(len(n)), best] / np.maximum(total, 1e-12), 0, 1), 0)
        return names[np.where(known, best, len(model.labels))].tolist(), score, n, by_doc(switch, n)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        labeller = Labeller(model)
        for ids, raws in blocks(batches, block_bytes):
            lang, score, n, switches = label(raws, labeller)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score), pa.array(n), pa.array(switches)], names=["id", "lang_pred", "score", "n_words", "n_switches"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        labeller = Labeller(model)
        for batch in batches:
            raws = batch.column(batch.num_columns - 1)
            done = []
            for _, some in blocks(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(raws))), raws], names=["id", "raw"])]), block_bytes):
                done.append(label(some, labeller)[:2])
            columns = [*batch.columns[:-1], pa.array([x for lang, _ in done for x in lang], pa.string()), pa.array(np.concatenate([s for _, s in done]) if done else np.empty(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"c{k}" for k in range(len(columns) - 2)), "lang_pred", "score"])

    if not keep:
        return id_text(docs, id_col, text_col).mapInArrow(rows, "id long, lang_pred string, score double, n_words long, n_switches long")
    # Columns travel under names of their own, so that they may be called anything.
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    raw = F.coalesce(own[f"c{docs.columns.index(text_col)}"].cast("string").cast("binary"), F.lit(b""))
    schema = own.schema.add("lang_pred", "string").add("score", "double")
    return own.withColumn("raw", raw).mapInArrow(beside, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~in_fold("doc_id", 5, 0)))
    return predict(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
