"""Benchmark decontamination by a distributed positional inverted index.

The index is a table in the shared folder, one row a segment (a block of documents): the hashes of its distinct words in
order, and for each the sorted positions at which it stands. Every word of every document has its posting. Documents are
one position apart, so that no match crosses from one to the next. A search looks up a window's words in a segment, takes
the rarest one's list, shifts it by the word's offset, and keeps what the next rarest lists, shifted likewise, also hold
(exact phrases), or what has all words within `slop` positions (proximity). Segments hold whole documents, so building
and searching need no shuffle, and a word or document that many rows share burdens no single task.

Benchmark items come to the tasks in chunks of at most `chunk_bytes` of text; more items mean more passes over the index.

Words are lower-cased (A-Z only) maximal runs of characters other than ASCII non-alphanumerics, known by 64-bit hashes.

Nulls and edges: a null or empty text has no words; an item without words has no window; a null item_id reads as empty
text; repeated item_ids are one item with all their windows, repeated documents are each matched. An empty benchmark hits
nothing. Further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, id_text, let_go, scratch, spans
from .features import terms

SEGMENT = "segment string, doc_ids array<long>, starts binary, words binary, terms binary, ends binary, positions binary"


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Segment:
    """Terms (sorted hashes), the end of each one's list, the lists, and where documents begin and how long they are."""

    def __init__(self, doc_ids: list, starts: np.ndarray, words: np.ndarray, terms_: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.doc_ids, self.starts, self.words, self.terms, self.ends, self.positions = doc_ids, starts, words, terms_, ends, positions

    @classmethod
    def of(cls, doc_ids: list, raws: list[bytes], words: Words, known: np.ndarray) -> tuple[Segment, np.ndarray]:
        """known: hashes of the words in the table, returned with those of new words."""
        parts = [words.numbers(terms(raw)) for raw in raws]
        if fresh := words.take():
            known = np.append(known, hashes(fresh))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(n + 1) - n - 1
        at = spans(starts, n)
        flat = known[np.concatenate(parts)] if len(at) else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        last = np.flatnonzero(np.append(flat[1:] != flat[:-1], True)) if len(flat) else np.empty(0, np.int64)
        return cls(doc_ids, starts, n, flat[last], last + 1, at[order]), known

    def lookup(self, hashes_: np.ndarray) -> np.ndarray:
        """The row of each term, or -1."""
        if not len(self.terms):
            return np.full(hashes_.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes_), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes_, at, -1)

    def postings(self, row: int) -> np.ndarray:
        return self.positions[(self.ends[row - 1] if row else 0) : self.ends[row]]

    def phrase(self, rows: list[int]) -> np.ndarray:
        """Positions at which these terms stand one after the other."""
        found = None
        for k in sorted(range(len(rows)), key=lambda k: self._count(rows[k])):
            own = self.postings(rows[k])
            if found is None:
                found = own.astype(np.int64) - k
            else:
                at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
                found = found[own[at] == found + k]
            if not len(found):
                break
        return found

    def near(self, rows: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest of these terms that have all others, in any order, at most `slop` positions away."""
        rows = sorted(set(rows), key=self._count)
        found = self.postings(rows[0]).astype(np.int64)
        doc = np.searchsorted(self.starts, found, "right") - 1
        low, high = np.maximum(found - slop, self.starts[doc]), np.minimum(found + slop, self.starts[doc] + self.words[doc] - 1)
        keep = np.ones(len(found), bool)
        for row in rows[1:]:
            own = self.postings(row)
            keep &= np.searchsorted(own, low) < np.searchsorted(own, high, "right")
        return found[keep]

    def _count(self, row: int) -> int:
        return int(self.ends[row] - (self.ends[row - 1] if row else 0))

    def to_row(self, name: str) -> pa.RecordBatch:
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([self.doc_ids], pa.list_(pa.int64())), blob(self.starts, "<u4"), blob(self.words, "<u4"), blob(self.terms, "<u8"), blob(self.ends, "<u4"), blob(self.positions, "<u4")], names=[x.split()[0] for x in SEGMENT.split(", ")])

    @classmethod
    def from_row(cls, batch: pa.RecordBatch, k: int) -> Segment:
        get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        return cls(batch.column("doc_ids")[k].as_py(), *(get(x, "<u4").astype(np.int64) for x in ("starts", "words")), get("terms", "<u8"), get("ends", "<u4").astype(np.int64), get("positions", "<u4"))


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 2_000_000) -> DataFrame:
    """Writes the index of docs to `path` and returns its rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, words, known = TaskContext.get().partitionId(), Words(), np.empty(0, np.uint64)
        for k, (ids, raws) in enumerate(blocks(batches, segment_bytes)):
            if left := words.trim():
                known = known[:left].copy()
            segment, known = Segment.of(ids.to_pylist(), raws, words, known)
            yield segment.to_row(f"{part}-{k}")

    spark = docs.sparkSession
    id_text(docs, id_col, text_col).mapInArrow(build, SEGMENT).write.parquet(path)
    return spark.read.schema(SEGMENT).parquet(path)


def windows(items: list[tuple[str, bytes]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of `size` words (an item of fewer words is one) -> the items that have them."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for name, raw in items:
        w = terms(raw)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found[tuple(w[i : i + size])].add(name)
    return found


def _chunks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("name"), F.coalesce(items[text_col].cast("string").cast("binary"), F.lit(b"")).alias("raw"))
    total = rows.agg(F.sum(F.length("raw") + 16)).first()[0] or 0
    n = -(-total // most)
    for c in range(n):
        yield [(r.name, bytes(r.raw)) for r in (rows.filter(F.pmod(F.xxhash64("name", "raw"), F.lit(n)) == c) if n > 1 else rows).collect()]


def search(index: DataFrame, items: DataFrame, *, size: int = 8, slop: int | None = None, id_col: str = "item_id", text_col: str = "text", chunk_bytes: int = 32_000_000) -> DataFrame:
    """For each indexed document: segment, k, doc_id, n_words, hits (array of bitmaps of its words), n_hit, items (array).

    With `slop` a window matches where all its words are at most that far from its rarest one, which is the word hit.
    """

    def matcher(found: dict[tuple[bytes, ...], set[str]]):
        keys = list(found)
        names = [sorted(found[w]) for w in keys]
        lengths = np.array([len(w) for w in keys], np.int64)
        flat = hashes([x for w in keys for x in w])
        ends = np.cumsum(lengths)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    s = Segment.from_row(batch, row)
                    n = len(s.doc_ids)
                    hit = np.zeros(int((s.words + 1).sum()), bool)
                    items_of: dict[int, set[str]] = defaultdict(set)
                    at = s.lookup(flat)
                    whole = np.minimum.reduceat(at, ends - lengths) >= 0 if len(keys) else np.empty(0, bool)
                    for w in np.flatnonzero(whole).tolist():
                        rows = at[ends[w] - lengths[w] : ends[w]].tolist()
                        places = s.phrase(rows) if slop is None else s.near(rows, slop)
                        if len(places):
                            wide = int(lengths[w]) if slop is None else 1
                            hit[spans(places, np.full(len(places), wide))] = True
                            for d in np.unique(np.searchsorted(s.starts, places, "right") - 1).tolist():
                                items_of[d].update(names[w])
                    own = [hit[a : a + m] if d in items_of else None for d, (a, m) in enumerate(zip(s.starts.tolist(), s.words.tolist(), strict=True))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("segment")[row].as_py()] * n), pa.array(range(n), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.words, pa.int64()),
                            pa.array([[] if x is None else [np.packbits(x).tobytes()] for x in own], pa.list_(pa.binary())), pa.array([0 if x is None else int(x.sum()) for x in own], pa.int64()),
                            pa.array([sorted(items_of.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                        ],
                        names=["segment", "k", "doc_id", "n_words", "hits", "n_hit", "items"],
                    )

        return match

    out = "segment string, k int, doc_id long, n_words long, hits array<binary>, n_hit long, items array<string>"
    parts = [index.mapInArrow(matcher(windows(chunk, size)), out) for chunk in _chunks(items, id_col, text_col, chunk_bytes)] or [index.mapInArrow(matcher({}), out)]
    if len(parts) == 1:
        return parts[0]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    merged = all_.groupBy("segment", "k").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that several chunks hit count once."""
        for batch in batches:
            n = [int(np.bitwise_or.reduce([np.unpackbits(np.frombuffer(x, np.uint8)) for x in maps]).sum()) if maps else 0 for maps in batch.column("hits").to_pylist()]
            yield batch.set_column(5, "n_hit", pa.array(n, pa.int64()))

    return merged.mapInArrow(union, out)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least two items) from what `search` returns."""
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(search(build_index(docs, scratch(spark, "positions")), items))


ORACLE = r"""
with lower_d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
lower_i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(8, len(w)) as n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from lower_i where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from lower_d) join (select distinct n from iw) on i + n - 1 <= len(w)),
hit as (select doc_id, i, n, item_id from dw join iw using (n, s)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from lower_d left join pos using (doc_id) left join it using (doc_id)
"""
