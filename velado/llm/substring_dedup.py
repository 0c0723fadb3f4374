"""Substring deduplication: removes every byte that a 400-byte string covers which also starts anywhere else.

A distributed difference-cover algorithm, for suffixes compared by their first 400 bytes:

1. Positions of a document (counted from its start) whose remainder lies in a difference cover modulo v are sampled. Any
   two positions have a shift below v after which both are sampled, so of two equal 400-byte strings some equal pair of
   (400 - v + 1)-byte strings starts at sampled positions. The sampled strings are named (by 64-bit fingerprints), the
   names sorted by ranges, and neighbours compared: a name that occurs twice is repeated.
2. The suffixes that remain are those with a repeated sampled name at a shift below v. Their 400-byte prefixes are named
   from the same running fingerprints, merged into one order by ranges again, and neighbours compared: equal ones are
   repeated strings.
3. Each document removes what its repeated strings cover.

The cover is a perfect difference set (Singer's, of a prime q: q + 1 of q^2 + q + 1), so q = 17 samples 18 of 307
positions. Names replace the triples and the recursion of the cover modulo 3: a name already spans 94 bytes, and only
equality within 400 bytes matters, not the full order. Sorting triples of all positions would shuffle over ten times the
input (see README). Blocks send each distinct name once (`pages`), so a text that a third of all rows share is one entry a block.

Nulls and edges: a null text counts as empty; texts under 400 bytes keep everything; matches never cross documents, but
may lie in one document and may overlap; repeated rows are each other's matches. Further columns are ignored. Equal
fingerprints of different strings have a chance of about n^2 / 2^65 among n distinct ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, by_doc, held, mixed, scratch, spans
from .pages import Answers, answered, buckets_for, distinct, gather, scan

RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@lru_cache(maxsize=8)
def difference_set(q: int) -> np.ndarray:
    """q + 1 residues modulo q^2 + q + 1, each non-zero difference once (Singer): for a prime q, the powers of a generator
    of the field of q^3 elements that lie in a plane."""
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                # x^3 = a x^2 + b x + c
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return np.array(found, np.int64)
    raise ValueError(f"no difference set for {q}")


class Running:
    """Fingerprints of any substrings of a chunk of bytes, from one running sum."""

    BASE = 0x9E3779B97F4A7C15 | 5
    _values = mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))

    def __init__(self):
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            step, back = pow(self.BASE, k, 1 << 64), pow(self.BASE, -k, 1 << 64)
            self.up = np.concatenate((self.up, self.up * U64(step)))
            self.down = np.concatenate((self.down, self.down * U64(back)))

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self._values[data] * self.up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + U64(length))


def _running() -> Running:
    return held(("running",), Running)


class Chunks:
    """A block's documents, some at a time: bytes, starts and lengths."""

    def __init__(self, raws: list[bytes], most: int = 500_000):
        self.groups: list[list[bytes]] = []
        held = 0
        for raw in raws:
            if not self.groups or held + len(raw) > most:
                self.groups.append([])
                held = 0
            self.groups[-1].append(raw)
            held += len(raw)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for group in self.groups:
            n = np.fromiter(map(len, group), np.int64, len(group))
            yield np.frombuffer(b"".join(group), np.uint8), np.cumsum(n) - n, n


def sampled(starts: np.ndarray, lengths: np.ndarray, cover: np.ndarray, v: int, size: int) -> np.ndarray:
    """Positions in the chunk that the cover samples and that `size` bytes of their document follow."""
    last = lengths - size
    rounds = np.maximum(-(-(last + 1) // v), 0)
    base = spans(np.zeros(len(starts), np.int64), rounds) * v
    at = (base[:, None] + cover[None, :]).reshape(-1)
    doc = np.repeat(np.arange(len(starts)), rounds * len(cover))
    keep = at <= last[doc]
    return starts[doc[keep]] + at[keep]


def covered(length: int, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Marks of [p - before, p + after) for each p in at, cut to [0, length)."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, np.maximum(at - before, 0), 1)
    np.add.at(steps, np.minimum(at + after, length), -1)
    return np.cumsum(steps[:-1]) > 0


def dedup(docs: DataFrame, *, size: int = 400, q: int = 17, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6_000_000, buckets: int | None = None, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with keep_text also the remaining bytes as `kept`."""
    v = q * q + q + 1
    if size < v + 8:
        raise ValueError("strings must be longer than the cover's period")
    cover, short = difference_set(q), size - v + 1
    buckets = buckets or buckets_for(docs, 8)
    how = {"id_col": id_col, "text_col": text_col, "block_bytes": block_bytes}
    spark = docs.sparkSession

    def names_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, found = _running(), []
        for data, starts, lengths in Chunks(raws):
            r.load(data)
            found.append(r.at(sampled(starts, lengths, cover, v, short), short))
        return distinct(np.concatenate(found) if found else np.empty(0, U64))

    def ask_names(part: str):
        return lambda mark, ids, raws: names_of(raws)[::2]

    first = answered(gather(docs, ask_names, buckets, **how), scratch(spark, "names"))

    def remaining(known: Answers, mark: int, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By chunk: starts, lengths, positions of the suffixes that remain, and their names."""
        names, back, _ = names_of(raws)
        twice = (known.totals(mark, names) > 1)[back]
        r, used = _running(), 0
        for data, starts, lengths in Chunks(raws):
            at = sampled(starts, lengths, cover, v, short)
            own = at[twice[used : used + len(at)]]
            used += len(at)
            if not len(own):
                yield starts, lengths, np.empty(0, np.int64), np.empty(0, U64)
                continue
            near = np.flatnonzero(covered(len(data), own, v - 1, 1))
            doc = np.searchsorted(starts, near, "right") - 1
            near = near[near + size <= starts[doc] + lengths[doc]]
            r.load(data)
            yield starts, lengths, near, r.at(near, size)

    def suffixes_of(known: Answers, mark: int, raws: list[bytes]) -> tuple[list, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = list(remaining(known, mark, raws))
        return parts, distinct(np.concatenate([x for *_, x in parts] or [np.empty(0, U64)]))

    def ask_suffixes(part: str):
        known = Answers(first, part)
        return lambda mark, ids, raws: suffixes_of(known, mark, raws)[1][::2]

    second = answered(gather(docs, ask_suffixes, buckets, **how), scratch(spark, "suffixes"))

    def cut(part: str):
        known, repeated = Answers(first, part), Answers(second, part)
        return lambda mark, ids, raws: cut_block(known, repeated, mark, ids, raws)

    def cut_block(known: Answers, repeated: Answers, mark: int, ids: pa.Array, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, (names, back, _) = suffixes_of(known, mark, raws)
        twice = (repeated.totals(mark, names) > 1)[back]
        removed, runs, kept, used = [], [], [], 0
        for (data, _, _), (starts, lengths, near, _) in zip(Chunks(raws), parts, strict=True):
            gone = covered(len(data), near[twice[used : used + len(near)]], 0, size)
            used += len(near)
            edge = gone.copy()
            inner = starts[(lengths > 0) & (starts > 0)]
            edge[1:] &= ~gone[:-1]
            edge[inner] = gone[inner]
            removed.append(by_doc(gone.astype(np.int64), lengths))
            runs.append(by_doc(edge.astype(np.int64), lengths))
            left = data[~gone].tobytes()
            ends = np.cumsum(lengths - removed[-1])
            kept += [left[i:j] for i, j in zip((ends - lengths + removed[-1]).tolist(), ends.tolist(), strict=True)]
        flat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
        columns = [ids, pa.array([len(x) for x in raws], pa.int64()), flat(removed), flat(runs), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names_ = [x.split()[0] for x in RESULT.split(", ")]
        if keep_text:
            columns, names_ = [*columns, pa.array(kept, pa.binary())], [*names_, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names=names_)

    return scan(docs, cut, RESULT + ", kept binary" * keep_text, **how)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).withColumn("doc_id", F.col("id")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
