"""Exact deduplication with a log-structured merge index of SHA-256 digests.

Texts are equal when identical after deleting the six ASCII white-space characters. Each task keeps a memtable (digest ->
best row so far and a count), which it flushes as sorted runs, cut into pages by digest range, each with a Bloom filter.
Compaction merges the pages of a range: of equal digests the row with the most code points, then the smallest id, stays,
and counts add up. Digests of two or more rows are hits; their texts, and only theirs, are read again and compared byte
for byte, and should one digest stand for different texts, its rows are grouped by the texts themselves.

Nulls and edges: a null text counts as empty, so all null, empty and blank texts form one group; a null id is smaller
than any other; of repeated rows (same id, same text) exactly one stays. An empty table gives an empty result. Further
columns pass through `deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, id_text, mixed, scratch, written
from .files import Rows, numbered, saved

SPACE = b"\t\n\x0b\x0c\r "
TAIL = bytes(range(0x80, 0xC0))
NO_ID = -(2**63)
PAGE = "bucket int, n long, digests binary, chars binary, ids binary, counts binary, filter binary"
_ARROW_PAGE = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *((x, pa.binary()) for x in ("digests", "chars", "ids", "counts", "filter"))])
PROBES = 4


def digest_of(raw: bytes, size: int = 32) -> bytes:
    """The first `size` bytes of the normalised text's SHA-256, zero-filled to 32."""
    d = hashlib.sha256(raw.translate(None, SPACE)).digest()
    return d if size == 32 else d[:size].ljust(32, b"\0")


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, TAIL))


def _probes(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of each digest (rows of four numbers) in a filter of `bits` bits, a power of two."""
    a, b = mixed(digests[:, 2]), mixed(digests[:, 3]) | U64(1)
    return np.stack([(a + U64(i) * b) & U64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def bloom(digests: np.ndarray, bits: int) -> bytes:
    found = np.zeros(bits, bool)
    found[_probes(digests, bits).reshape(-1)] = True
    return np.packbits(found, bitorder="little").tobytes()


def maybe_in(digests: np.ndarray, filter_: bytes) -> np.ndarray:
    """False: surely not in it."""
    held = np.frombuffer(filter_, np.uint8)
    at = _probes(digests, len(held) * 8)
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _page(bucket: int, digests: np.ndarray, chars: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> dict:
    bits = 1 << max(6, int(10 * max(1, len(ids)) - 1).bit_length())
    return {"bucket": bucket, "n": len(ids), "digests": digests.astype(">u8").tobytes(), "chars": chars.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "counts": counts.astype("<i8").tobytes(), "filter": bloom(digests, bits)}


def _merged(digests: np.ndarray, chars: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by digest, one entry each: the most code points, then the smallest id, and the sum of counts."""
    order = np.lexsort((ids, -chars, digests[:, 3], digests[:, 2], digests[:, 1], digests[:, 0]))
    digests, chars, ids, counts = digests[order], chars[order], ids[order], counts[order]
    first = np.ones(len(ids), bool)
    first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return digests[at], chars[at], ids[at], np.add.reduceat(counts, at) if len(at) else counts


def _flush(memtable: dict, buckets: int) -> pa.RecordBatch:
    digests = np.frombuffer(b"".join(memtable), ">u8").reshape(-1, 4).astype(U64)
    chars, ids, counts = np.array(list(memtable.values()), np.int64).T
    digests, chars, ids, counts = _merged(digests, -chars, ids, counts)
    of = (digests[:, 0] >> U64(32)).astype(np.int64) * buckets >> 32
    ends = np.searchsorted(of, np.arange(buckets + 1))
    return pa.RecordBatch.from_pylist([_page(b, digests[i:j], chars[i:j], ids[i:j], counts[i:j]) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j], schema=_ARROW_PAGE)


def buckets_for(docs: DataFrame, each: int = 1_000_000, least: int = 256) -> int:
    """A power of two, so that a bucket has about `each` rows at most: 56 MB of entries in the task that merges it."""
    return max(least, 1 << max(0, docs.count() // each).bit_length())


class LsmIndex:
    """Runs of pages in the shared folder: level 0 as flushed, level 1 as merged. `add` may be called again."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 256, memtable_rows: int = 200_000, digest_size: int = 32):
        """buckets: see buckets_for; it must not change while an index grows. digest_size below 32 exists for tests: it makes digests of different texts collide."""
        self.spark, self.path = spark, path or scratch(spark, "lsm")
        self.buckets, self.memtable_rows, self.digest_size = buckets, memtable_rows, digest_size
        self.runs: list[str] = []
        self.flushed = 0
        self.merged: str | None = None

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LsmIndex:
        buckets, rows, size = self.buckets, self.memtable_rows, self.digest_size

        def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memtable: dict[bytes, tuple[int, int, int]] = {}
            for batch in batches:
                for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = raw.as_py()
                    d, new = digest_of(raw, size), (-code_points(raw), NO_ID if id_ is None else id_, 1)
                    if old := memtable.get(d):
                        new = (*min(old[:2], new[:2]), old[2] + 1)
                    memtable[d] = new
                    if len(memtable) >= rows:
                        yield _flush(memtable, buckets)
                        memtable.clear()
            if memtable:
                yield _flush(memtable, buckets)

        self.flushed += 1
        path = f"{self.path}/level0-{self.flushed}"
        saved(id_text(docs, id_col, text_col), flush_runs, PAGE, path)
        self.runs.append(path)
        return self

    def compact(self) -> LsmIndex:
        """Merges all runs; a bucket's pages meet in one task, and a digest has one entry a memtable at most there."""

        def merged(pages: list[dict]) -> pa.RecordBatch:
            col = lambda name, kind: np.frombuffer(b"".join(page[name] for page in pages), kind)
            found = _merged(col("digests", ">u8").reshape(-1, 4).astype(U64), col("chars", "<i8"), col("ids", "<i8"), col("counts", "<i8"))
            return pa.RecordBatch.from_pylist([_page(pages[0]["bucket"], *found)], schema=_ARROW_PAGE)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            for batch in batches:
                for page in batch.to_pylist():
                    if held and held[0]["bucket"] != page["bucket"]:
                        yield merged(held)
                        held = []
                    held.append(page)
            if held:
                yield merged(held)

        path = f"{self.path}/level1-{self.flushed}"
        pages = self.spark.read.schema(PAGE).parquet(*self.runs, *([self.merged] if self.merged else []))
        saved(pages.repartition("bucket").sortWithinPartitions("bucket"), merge, PAGE, path)
        self.runs, self.merged = [], path
        return self

    def hits(self) -> DataFrame:
        """(digest, keep_id, keep_chars, group_size) of digests that two or more rows have."""

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for page in batch.to_pylist():
                    counts = np.frombuffer(page["counts"], "<i8")
                    at = np.flatnonzero(counts > 1)
                    d = page["digests"]
                    yield pa.RecordBatch.from_arrays([pa.array([d[32 * i : 32 * i + 32] for i in at], pa.binary()), *(pa.array(np.frombuffer(page[k], "<i8")[at]) for k in ("ids", "chars")), pa.array(counts[at])], names=["digest", "keep_id", "keep_chars", "group_size"])

        return self.spark.read.schema(PAGE).parquet(self.merged).mapInArrow(explode, "digest binary, keep_id long, keep_chars long, group_size long")

    def hit_filter(self, bits: int = 1 << 25) -> list[bytes]:
        """A Bloom filter of the hits' digests, one slice for each bucket: 4 MB in all, whatever the input."""
        slice_bits = max(64, bits // self.buckets)

        def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for page in batch.to_pylist():
                    d = np.frombuffer(page["digests"], ">u8").reshape(-1, 4).astype(U64)[np.frombuffer(page["counts"], "<i8") > 1]
                    if len(d):
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([page["bucket"]], pa.int32()), "bits": [bloom(d, slice_bits)]})

        slices = [b""] * self.buckets
        for row in self.spark.read.schema(PAGE).parquet(self.merged).mapInArrow(sliced, "bucket int, bits binary").collect():
            slices[row.bucket] = bytes(row.bits)
        return slices


def _maybe(digests: list[bytes], slices: list[bytes]) -> np.ndarray:
    """Which digests the filter holds, maybe."""
    buckets = len(slices)
    d = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(U64)
    maybe = np.zeros(len(d), bool)
    of = (d[:, 0] >> U64(32)).astype(np.int64) * buckets >> 32
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        if slices[b]:
            rows = order[ends[b] : ends[b + 1]]
            maybe[rows] = maybe_in(d[rows], slices[b])
    return maybe


DIGESTS = "id long, n_chars long, digest binary, maybe_hit boolean"


def digests_of(slices: list[bytes], digest_size: int = 32, texts: bool = False) -> Rows:
    """(id, raw) -> DIGESTS, or, if asked for, with the index's digest and the normalised text (norm) of possible hits."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            found = [digest_of(raw) for raw in raws]
            short = found if digest_size == 32 else [d[:digest_size].ljust(32, b"\0") for d in found]
            maybe = _maybe(short, slices)
            columns = [batch.column(0), pa.array([code_points(raw) for raw in raws], pa.int64()), pa.array(short if texts else found, pa.binary()), pa.array(maybe)]
            names = ["id", "n_chars", "digest", "maybe_hit"]
            if texts:
                columns.append(pa.array([raw.translate(None, SPACE) if m else None for raw, m in zip(raws, maybe.tolist(), strict=True)], pa.binary()))
                names.append("norm")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return digests


def hit_groups(docs: DataFrame, id_col: str, text_col: str, *, buckets: int | None, memtable_rows: int, digest_size: int) -> tuple[DataFrame, list[bytes]]:
    """What the index says of digests with several rows, each verified: (digest, full, keep_id, keep_chars, group_size);
    and the filter of these digests. `full` is set where the digest alone does not tell."""
    index = LsmIndex(docs.sparkSession, buckets=buckets or buckets_for(docs), memtable_rows=memtable_rows, digest_size=digest_size).add(docs, id_col, text_col).compact()
    slices = index.hit_filter()
    # Byte verification: the distinct texts of each hit; copies collapse before the shuffle.
    texts = id_text(docs, id_col, text_col).mapInArrow(digests_of(slices, digest_size, texts=True), f"{DIGESTS}, norm binary").filter("maybe_hit")
    distinct = texts.groupBy("digest", "norm").agg(F.min(F.struct((-F.col("n_chars")).alias("minus"), F.coalesce("id", F.lit(NO_ID)).alias("id"))).alias("best"), F.count("*").alias("size"))
    clashing = distinct.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    by_text = distinct.join(clashing, "digest", "left_semi").select("digest", F.sha2("norm", 256).alias("full"), F.col("best.id").alias("keep_id"), (-F.col("best.minus")).alias("keep_chars"), F.col("size").alias("group_size"))
    by_digest = index.hits().join(clashing, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("full"), "keep_id", "keep_chars", "group_size")
    return by_digest.unionByName(by_text), slices


def _decided(rows: DataFrame, groups_: DataFrame, digest_size: int, carried: list[str], salts: int = 16) -> DataFrame:
    """rows (row, id, n_chars, digest, and carried columns) with full, keep_id, keep_chars, group_size and kept.

    rows must be a table, so that `row` stays what it is. Which of the rows that repeat id, text and length stays is an
    aggregate that tasks reduce first; then a group's rows, salted by row, meet copies of its one entry.
    """
    key = F.col("digest") if digest_size == 32 else F.rpad(F.substring("digest", 1, digest_size), 32, F.lit(b"\0"))
    rows = rows.withColumn("full", F.lower(F.hex("digest"))).withColumn("key", key)
    order = F.struct(F.col("n_chars") * -1, F.coalesce("id", F.lit(NO_ID)), "row")
    first = rows.groupBy(F.col("key").alias("f_key"), F.col("full").alias("f_full")).agg(F.min_by("row", order).alias("first_row"))
    g = groups_.withColumnRenamed("full", "g_full").withColumnRenamed("digest", "g_digest")
    same = lambda k, full: (F.col(k) == F.col("g_digest")) & (F.col("g_full").isNull() | (F.col("g_full") == F.col(full)))
    g = g.join(first, same("f_key", "f_full")).drop("f_key", "f_full")
    g = g.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(g, same("key", "full") & (F.pmod(F.hash("row"), F.lit(salts)) == F.col("g_salt")), "left")
    best = (F.coalesce("id", F.lit(NO_ID)) == F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("row") == F.col("first_row"))
    return joined.select(
        "id", "n_chars", "full", *carried,
        F.when(F.col("keep_id").isNull(), F.col("id")).when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("keep_id").isNull(), True).otherwise(best).alias("kept"),
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int | None = None, memtable_rows: int = 200_000, digest_size: int = 32) -> DataFrame:
    """A row for each row of docs: id, n_chars, text_sha256, keep_id, group_size, kept."""
    of_group, slices = hit_groups(docs, id_col, text_col, buckets=buckets, memtable_rows=memtable_rows, digest_size=digest_size)
    rows = saved(id_text(docs, id_col, text_col), numbered(digests_of(slices, digest_size)), f"{DIGESTS}, row long", scratch(docs.sparkSession, "digests"))
    # Only possible hits meet the index's entries; a row that surely is alone stays where it is.
    alone = rows.filter("not maybe_hit").select("id", "n_chars", F.lower(F.hex("digest")).alias("full"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    doubt = _decided(rows.filter("maybe_hit").drop("maybe_hit"), of_group, digest_size, [])
    return alone.unionByName(doubt).withColumnRenamed("full", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int | None = None, memtable_rows: int = 200_000, digest_size: int = 32) -> DataFrame:
    """The rows of docs that stay, with all their columns; only possible hits are shuffled."""
    of_group, slices = hit_groups(docs, id_col, text_col, buckets=buckets, memtable_rows=memtable_rows, digest_size=digest_size)
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    columns = own.columns
    schema = own.schema.add("id", "long").add("n_chars", "long").add("digest", "binary").add("maybe_hit", "boolean")
    raw = F.coalesce(own[f"c{docs.columns.index(text_col)}"].cast("string").cast("binary"), F.lit(b""))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(batch.num_columns - 1).to_pylist()
            found = [digest_of(raw) for raw in raws]
            short = [d[:digest_size].ljust(32, b"\0") for d in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([code_points(raw) for raw in raws], pa.int64()), pa.array(found, pa.binary()), pa.array(_maybe(short, slices))], names=[x.name for x in schema])

    marked = own.withColumn("id", own[f"c{docs.columns.index(id_col)}"].cast("long")).withColumn("raw", raw).mapInArrow(mark, schema)
    maybe = written(marked.filter("maybe_hit").withColumn("row", F.monotonically_increasing_id()), "possible-hits")
    doubt = _decided(maybe, of_group, digest_size, columns).filter("kept").select(columns)
    return marked.filter("not maybe_hit").select(columns).unionByName(doubt).toDF(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256", "n_chars")


ORACLE = """
with t as (select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  row_number() over (partition by text_sha256 order by n_chars desc, doc_id) = 1 as kept, text_sha256, n_chars from t
"""
