"""Totals of 64-bit hashes over a corpus, by pages.

A block of texts (whole documents) asks about its distinct hashes, once each, however often it has them: sorted pages, one
for each bucket, an equal range of hash values. The pages of a bucket meet in one task, which adds them up and answers each
page with the totals of its hashes, in their order. A partition's answers become one file in the shared folder, which the
partition's next pass reads block by block. So the shuffle carries about 6 bytes a distinct hash and block one way, one byte
the other, and no row a hash; a key that a third of all rows have is one entry a block.

Scale. Buckets grow with the scan's partitions, without a bound, so a bucket's pages stay a fixed share of what one
partition holds, and files are one a partition and pass. A page has a block's hashes divided by the buckets: with very many
partitions larger blocks (`block_bytes`, more memory a task) keep pages long.

Blocks are known by their partition and place in it; each pass over the same files meets the same ones. A fingerprint of the
documents guards this: if the input has changed meanwhile, or is no plain table and came in another order, the next pass
fails rather than give wrong results (write such a frame to a table first).

Different texts share a 64-bit hash with a chance of about n^2 / 2^65 among n distinct ones.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import U64, blocks, bucket_bounds, id_text, pack_page, unpack_page

REQUEST = "part string, block int, mark long, bucket int, page binary, counts binary"
ANSWER = "part string, block int, mark long, bucket int, totals binary"


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; 255 and more go to a list behind."""
    large = counts >= 255
    return np.array([len(counts)], "<i8").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    if len(data) > 8 + n:
        counts[counts == 255] = np.frombuffer(data, "<i8", -1, 8 + n)
    return counts


def buckets_for(docs: DataFrame, each: int, least: int = 64) -> int:
    """A power of two: at least `each` buckets for each of the scan's partitions."""
    return max(least, 1 << (each * docs.rdd.getNumPartitions() - 1).bit_length())


def fingerprint(ids: pa.Array, raws: list[bytes]) -> int:
    return zlib.crc32(repr((ids.to_pylist(), list(map(len, raws)))).encode())


def requests(part: str, block: int, mark: int, names: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pages of a block's sorted distinct hashes."""
    ends = bucket_bounds(names, buckets)
    at = np.flatnonzero(np.diff(ends)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(at), pa.string()), pa.array([block] * len(at), pa.int32()), pa.array([mark] * len(at), pa.int64()), pa.array(at, pa.int32()),
            pa.array([pack_page(names[ends[b] : ends[b + 1]]) for b in at], pa.binary()), pa.array([pack_counts(counts[ends[b] : ends[b + 1]]) for b in at], pa.binary()),
        ],
        names=["part", "block", "mark", "bucket", "page", "counts"],
    )


def gather(docs: DataFrame, each: Callable[[str], Callable[[int, pa.Array, list[bytes]], tuple[np.ndarray, np.ndarray]]], buckets: int, *, prefix: str = "", id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One pass: the requests of all blocks. each: a partition -> a block's (fingerprint, ids, texts) -> its sorted distinct
    hashes and their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = str(TaskContext.get().partitionId())
        own = each(part)
        for k, (ids, raws) in enumerate(blocks(batches, block_bytes)):
            mark = fingerprint(ids, raws)
            yield requests(prefix + part, k, mark, *own(mark, ids, raws), buckets)

    return id_text(docs, id_col, text_col).mapInArrow(ask, REQUEST)


def scan(docs: DataFrame, each: Callable[[str], Callable[[int, pa.Array, list[bytes]], Iterator[pa.RecordBatch]]], schema: str, *, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One pass. each: a partition -> a block's (fingerprint, ids, texts) -> rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = str(TaskContext.get().partitionId())
        own = each(part)
        for ids, raws in blocks(batches, block_bytes):
            yield from own(fingerprint(ids, raws), ids, raws)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def answered(asked: DataFrame, folder: str, silent: str | None = None) -> str:
    """Adds up the pages of all blocks and writes each partition's totals to a file in `folder`; returns it. Partitions whose
    names begin with `silent` count, and get no answer."""

    def add(table: pa.Table) -> pa.Table:
        names = [unpack_page(p) for p in table["page"].to_pylist()]
        sizes = np.cumsum([0, *map(len, names)])
        flat = np.concatenate(names)
        del names
        order = np.argsort(flat, kind="stable")  # which merges what is sorted already
        flat = flat[order]
        new = np.append(True, flat[1:] != flat[:-1])
        sums = np.add.reduceat(np.concatenate([unpack_counts(c) for c in table["counts"].to_pylist()])[order], np.flatnonzero(new))
        totals = np.empty(len(flat), np.int64)
        totals[order] = sums[np.cumsum(new) - 1]
        at = [k for k, part in enumerate(table["part"].to_pylist()) if silent is None or not part.startswith(silent)]
        out = [zlib.compress(pack_counts(totals[sizes[k] : sizes[k + 1]]), 1) for k in at]
        return table.take(pa.array(at, pa.int64())).select(["part", "block", "mark", "bucket"]).append_column("totals", pa.array(out, pa.binary()))

    system, path = _system(folder)
    system.create_dir(path, recursive=True)

    def deliver(table: pa.Table) -> pa.Table:
        part, found = table["part"][0].as_py(), {}
        for row in table.sort_by([("block", "ascending"), ("bucket", "ascending")]).to_pylist():
            found.setdefault((row["block"], row["mark"]), []).append(unpack_counts(zlib.decompress(row["totals"])))
        blobs = {key: zlib.compress(pack_counts(np.concatenate(x)), 1) for key, x in found.items()}
        head = json.dumps([[*key, len(x)] for key, x in blobs.items()]).encode()
        store, at = _system(folder)
        tmp = f"{at}/{part}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(tmp) as out:
            out.write(np.array([len(head)], "<i8").tobytes() + head)
            for x in blobs.values():
                out.write(x)
        store.move(tmp, f"{at}/{part}")
        return pa.table({"part": [part]})

    asked.groupBy("bucket").applyInArrow(add, ANSWER).groupBy("part").applyInArrow(deliver, "part string").count()
    return folder


class Answers:
    """A partition's answers. `totals` must be called once a block, in order, with the hashes that the block asked about."""

    def __init__(self, folder: str, part: str):
        self.folder, self.part, self.block, self.places = folder, part, -1, None

    def totals(self, mark: int, names: np.ndarray) -> np.ndarray:
        self.block += 1
        if not len(names):
            return np.empty(0, np.int64)
        store, at = _system(self.folder)
        found = np.empty(0, np.int64)
        try:
            with store.open_input_file(f"{at}/{self.part}") as f:
                if self.places is None:
                    size = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
                    head = json.loads(f.read_at(size, 8))
                    starts = 8 + size + np.cumsum([0, *(n for *_, n in head)])
                    self.places = {(block, own): (n, start) for (block, own, n), start in zip(head, starts.tolist(), strict=False)}
                if place := self.places.get((self.block, mark)):
                    found = unpack_counts(zlib.decompress(f.read_at(*place)))
        except FileNotFoundError:
            pass
        if len(found) != len(names):
            raise RuntimeError("the input came in another order than in the pass before; write it to a table first")
        return found


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, where each hash is among them, their counts)."""
    names, back, counts = np.unique(hashes.astype(U64, copy=False), return_inverse=True, return_counts=True)
    return names, back, counts
