"""What the corpus operators share: the shared folder, blocks of texts, tables of distinct words, pages of hashes.

All operators select the id and text columns by name first, under names of their own, so further columns of the
input never clash with theirs. Texts reach Python as bytes (invalid UTF-8 survives), a null text as an empty one. They
change no setting of the session; plans.session.prepared lowers the size of Arrow batches for those who call them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Tables, scratch, shared_folder, written  # noqa: F401

U64 = np.uint64


def give_back() -> None:
    """Returns freed memory to the system, for a worker process that goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id long, raw binary, further columns); a null text becomes empty bytes."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b"")).alias("raw"), *(docs[c] for c in more))


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Rows of (id, raw) in blocks of about `limit` bytes; a longer text is a block of its own, whole."""
    give_back()
    ids: list[pa.Array] = []
    raws: list[bytes] = []
    held = 0
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < n:
            before = int(sizes[start - 1]) if start else 0
            end = max(int(np.searchsorted(sizes, before + limit - held, "right")), start + (not held))
            if end > start:
                ids.append(batch.column(0).slice(start, end - start))
                raws += batch.column(1).slice(start, end - start).to_pylist()
                held += int(sizes[end - 1]) - before
            if end < n or held >= limit:
                yield pa.concat_arrays(ids), raws
                ids, raws, held = [], [], 0
            start = end
    if ids:
        yield pa.concat_arrays(ids), raws
    del ids, raws
    give_back()


_held: dict = {}


def held(key: tuple, make):
    """What a worker process keeps from task to task, such as a table of frequent words: one thing at a time, so that the
    tables of a stage that is over do not weigh on the next."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For operators that hold nothing: what an earlier one left in this worker process goes."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


class Words(dict):
    """Distinct words -> dense numbers. New words wait in `fresh`.

    `trim`, between blocks, forgets the later half of a table that has grown too large: frequent words come early.
    """

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit, self.fresh = limit, []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def numbers_of(self, words: pa.Array) -> np.ndarray:
        """The same of an Arrow array: only its distinct words become Python objects."""
        found = words.dictionary_encode()
        return self.numbers(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)]

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh

    def trim(self) -> int | None:
        """How many words are left if it forgot any."""
        if len(self) <= self.limit:
            return None
        for _ in range(len(self) - self.limit // 2):
            self.popitem()
        return len(self)


class Ragged:
    """Lists of numbers by dense number: appended in lots, gathered in bulk."""

    def __init__(self, dtype):
        self.values, self.ends = np.empty(0, dtype), np.zeros(1, np.int64)

    def append(self, lists: list) -> None:
        if not lists:
            return
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for one in lists for x in one), self.values.dtype, int(n.sum()))
        self.extend(flat, n)

    def extend(self, flat: np.ndarray, n: np.ndarray) -> None:
        self.values = np.concatenate((self.values, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(n)))

    def trim(self, n: int) -> None:
        self.ends = self.ends[: n + 1].copy()
        self.values = self.values[: self.ends[-1]].copy()

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these numbers, concatenated; the length of each)."""
        start, n = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        return self.values[spans(start, n)], n


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(n) - n
    return np.repeat(start - at, n) + np.arange(total, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def by_doc(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` with these lengths (zero-length runs give 0), each by itself, so that a run's sum
    does not depend on what stands beside it."""
    out, full = np.zeros(len(lengths), np.add.reduce(values[:0]).dtype), lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


# Pages of sorted 64-bit hashes -------------------------------------------------------------------------------------
# A block of texts asks about its distinct hashes: one page for each range of hash values (a bucket). Pages of a bucket
# meet in one task, which adds them up and answers each with totals in the order of the page. A page drops what its
# values share with the bucket and stores the low 6 bytes raw and the rest as run lengths, near the Elias-Fano bound.


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` (a power of two) equal ranges begins in the sorted hashes, and the end."""
    bits = buckets.bit_length() - 1
    edges = (np.arange(buckets, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, U64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def pack_page(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes -> bytes."""
    if not len(hashes):
        return b""
    high = (hashes >> U64(48)).astype(np.int64)
    runs = np.bincount(high - high[0])
    low = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    wide = runs.max() > 255
    head = np.array([len(hashes), int(high[0]), len(runs), int(wide)], "<i8").tobytes()
    return head + runs.astype("<u4" if wide else "u1").tobytes() + low.tobytes()


def unpack_page(page: bytes) -> np.ndarray:
    if not page:
        return np.empty(0, U64)
    n, first, k, wide = (int(x) for x in np.frombuffer(page, "<i8", 4))
    runs = np.frombuffer(page, "<u4" if wide else "u1", k, 32)
    high = np.repeat(np.arange(first, first + k, dtype=np.int64), runs).astype(U64)
    low = np.zeros((n, 8), np.uint8)
    low[:, :6] = np.frombuffer(page, np.uint8, 6 * n, 32 + runs.nbytes).reshape(n, 6)
    return low.view("<u8").reshape(-1) | (high << U64(48))


# A filter of fixed size over 64-bit ids ----------------------------------------------------------------------------


class IdFilter:
    """A Bloom filter of `bits` bits (4 MB unless said otherwise) over any number of ids: it may say yes too often, never
    no too often, so it only decides which rows need a join. Tasks fold their ids into slices; the slices, and nothing that
    grows with the ids, come to the driver."""

    SLICES, PROBES = 64, 3

    def __init__(self, ids: DataFrame, bits: int = 1 << 25):
        """ids: one column of longs."""
        each = bits // self.SLICES
        name = ids.columns[0]

        def fold(table: pa.Table) -> pa.Table:
            found = np.zeros(each, bool)
            found[self.places(mixed(table["id"].to_numpy().view(U64)), each).reshape(-1)] = True
            return pa.table({"slice": table["slice"].slice(0, 1), "bits": [np.packbits(found, bitorder="little").tobytes()]})

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array((mixed(x.view(U64)) % U64(self.SLICES)).astype(np.int32))], names=["id", "slice"])

        self.slices = np.zeros((self.SLICES, each // 8), np.uint8)
        placed = ids.filter(F.col(name).isNotNull()).select(F.col(name).alias("id")).mapInArrow(place, "id long, slice int").distinct()
        for row in placed.groupBy("slice").applyInArrow(fold, "slice int, bits binary").collect():
            self.slices[row.slice] = np.frombuffer(bytes(row.bits), np.uint8)

    def places(self, x: np.ndarray, each: int) -> np.ndarray:
        a, b = x >> U64(6), mixed(x ^ U64(0x5851F42D4C957F2D)) | U64(1)
        return np.stack([(a + U64(i) * b) % U64(each) for i in range(self.PROBES)]).astype(np.int64)

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        x = mixed(ids.astype(np.int64).view(U64))
        at = self.places(x, self.slices.shape[1] * 8)
        own = (x % U64(self.SLICES)).astype(np.int64)
        return ((self.slices[own, at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def column(self, col):
        """A boolean column: whether a long column's value may be among the ids (false for null)."""

        @F.arrow_udf("boolean")
        def maybe_among(x: pa.Array) -> pa.Array:
            known = x.is_valid().to_numpy(zero_copy_only=False)
            return pa.array(self.maybe(x.fill_null(0).to_numpy(zero_copy_only=False)) & known)

        return maybe_among(col)


def without(docs: DataFrame, losers: DataFrame, id_col: str) -> DataFrame:
    """docs less the rows whose id is among the losers (one column of longs). Only rows that may be meet the join."""
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    key = own[f"c{docs.columns.index(id_col)}"].cast("long")
    lost = losers.select(F.col(losers.columns[0]).alias("loser")).distinct()
    flagged = own.withColumn("maybe", IdFilter(lost).column(key))
    doubt = flagged.filter("maybe").join(lost, key == F.col("loser"), "left_anti")
    return flagged.filter("not maybe").unionByName(doubt).drop("maybe").toDF(*docs.columns)
