"""Hashed text features, counted a document, and bounded training samples of them."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ragged, Words, blocks, by_doc, id_text

#: Bytes that end a term: ASCII other than letters and digits; capital ASCII letters become small.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


def tokens(raw: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, case and punctuation kept."""
    return raw.split()


def bucket(name: bytes, bits: int) -> int:
    return xxhash.xxh32_intdigest(name) & ((1 << bits) - 1)


class Featurizer:
    """Blocks of texts -> (row numbers of hashed features, their counts, how many distinct ones each document has)."""

    def __init__(self, split: Callable[[bytes], list[bytes]], of_word: Callable[[bytes], list[int]]):
        self.split, self.of_word, self.words, self.rows = split, of_word, Words(), Ragged(np.int64)

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if left := self.words.trim():
            self.rows.trim(left)
        parts = [self.words.numbers(self.split(raw)) for raw in raws]
        self.rows.append([self.of_word(w) for w in self.words.take()])
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        feats, k = self.rows.gather(np.concatenate(parts) if parts else np.empty(0, np.int32))
        doc = np.repeat(np.arange(len(raws)), by_doc(k, n))
        key, count = np.unique(doc << 32 | feats, return_counts=True)
        return key & 0xFFFFFFFF, count, np.bincount(key >> 32, minlength=len(raws))


def in_fold(id_col: str, mod: int, rest: int) -> Column:
    """crc32(id as text) mod `mod` is `rest`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def sample(docs: DataFrame, labels: DataFrame, rows: int, make: Callable[[], Featurizer], *, id_col: str = "doc_id", text_col: str = "text", entries: int = 6_000_000, block_bytes: int = 2_000_000) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most `rows` labelled documents, those with the smallest hashes of id, and at most `entries` in all.

    labels: (id, y), one a document, already restricted to the training fold. Returns y, features, counts, lengths, in
    order of the hashes. Where `entries` is met, the documents with the largest hashes go, wherever they stand in the
    table; one with more features than that by itself is left out. Only ids, labels and counted features come to the
    driver, so what it holds is bounded by the two parameters.
    """
    chosen = labels.filter("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "id").select(F.struct("y", "id", F.xxhash64("id").alias("hash")).alias("key"), "raw")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = make()
        for keys, raws in blocks(batches, block_bytes):
            feats, counts, n = featurize(raws)
            ends = np.append(0, np.cumsum(n)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (feats, counts)]
            yield pa.RecordBatch.from_arrays([keys, *lists], names=["key", "feats", "counts"])

    # A heap with the largest key first. Rows of one key have the same features, so it does not matter which of them go.
    kept, total, least_gone = [], 0, None
    for number, row in enumerate(texts.mapInArrow(extract, "key struct<y: long, id: long, hash: long>, feats array<int>, counts array<int>").toLocalIterator()):
        if len(row.feats) > entries:
            continue
        feats, counts = np.array(row.feats, np.int64), np.array(row.counts, np.int64)
        key = (-row.key.hash, -row.key.id, -row.key.y, -xxhash.xxh64_intdigest(feats.tobytes() + counts.tobytes()))
        if least_gone is not None and key <= least_gone:
            continue
        heapq.heappush(kept, (key, number, feats, counts))
        total += len(feats)
        while total > entries:
            least_gone, _, gone, _ = heapq.heappop(kept)
            total -= len(gone)
    kept.sort(key=lambda x: x[0], reverse=True)
    flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return [-x[0][2] for x in kept], flat([x[2] for x in kept]), flat([x[3] for x in kept]), np.array([len(x[2]) for x in kept], np.int64)
