"""Token ids as binary files: one concatenated id array a file, document boundaries in Elias-Fano form.

A file ("shard") holds the documents of one range of doc_id in ascending order:

    magic "VLDTOK01" | six little-endian int64: documents, of them with null id, ids, bytes an id, bytes of the two
    Elias-Fano blobs | boundaries (documents + 1 offsets into the ids) | doc_ids less their minimum | the ids

Ids take 2 bytes where the vocabulary allows, else 4. A boundary costs about 2 + log2(ids / documents) bits, and its
select structure (the place of every 64th one) finds offset i without decoding the others, so a reader seeks to one
document with no 64-bit table.

Each document's text is encoded whole. Words between single spaces recur, so a task encodes each distinct one once: a
space between two non-space characters always starts a new pre-token of byte-level BPE, so the parts' ids, put together,
are those of the whole text. An added token in a text (`<|endoftext|>`) has its own id, and what stands before and after
it is encoded as a text by itself, as the tokenizer does.

Nulls and edges: a null or empty text is the end id alone; null doc_ids come first; rows with one doc_id stand next to
each other, in the order of their bytes; an empty table gives no file and no row. Further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ragged, blocks, by_doc, held, id_text, scratch

MAGIC = b"VLDTOK01"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts without white space but single line ends inside (white space as Unicode has it, and what Python adds).
_SPACES = r"\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EVEN = rf"^[^{_SPACES}]+(?:\n[^{_SPACES}]+)*$"


class EliasFano:
    """Non-decreasing integers from 0 up, with constant-time access by select on the high bits."""

    EVERY = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(high, bitorder="little"), ones[:: cls.EVERY].astype("<u8"))

    def select(self, i: int) -> int:
        """The place of one number i (from 0) among the high bits."""
        at = int(self.samples[i // self.EVERY])
        left, byte = i % self.EVERY, at >> 3
        if not left:
            return at
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        left += 1
        while (ones := word.bit_count()) < left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left - 1):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        value, start = 0, i * self.low_bits
        for k in range(self.low_bits):
            value |= (int(self.low[(start + k) >> 3]) >> ((start + k) & 7) & 1) << k
        return (self.select(i) - i) << self.low_bits | value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.uint64)
        low = (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits) | low

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, high = (int(x) for x in np.frombuffer(data, "<i8", 4))
        return cls(n, bits, np.frombuffer(data, np.uint8, low, 32), np.frombuffer(data, np.uint8, high, 32 + low), np.frombuffer(data, "<u8", -1 if n else 0, 32 + low + high) if n else np.empty(0, "<u8"))


class WordEncoder:
    """Ids of whole texts, each distinct part encoded once while it is in the table.

    A part is what stands between two cuts, and its ids are those of a space and it; a text's first part has no space
    before it and is kept under a key with a space in front, which no other part has.
    """

    LOT = 500

    def __init__(self, tokenizer, dtype, limit: int = 600_000):
        self.tokenizer, self.limit = tokenizer, limit
        self.table = pa.array([], pa.string())
        self.ids, self.open = Ragged(dtype), np.zeros(0, np.uint8)
        self.newline = self._encode(["\n"])[0][0]
        added = tokenizer.get_added_tokens_decoder()
        self.added = {t.content: k for k, t in added.items()}
        self.marker = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        # Those that take white space beside them, or stand for whole words only, or are looked for in normalized text.
        self.wide = any(t.lstrip or t.rstrip or t.single_word or (t.normalized and tokenizer.normalizer is not None) for t in added.values())

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.ids.values.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Places of the parts in the table, which learns new ones."""
        found = pc.index_in(parts, value_set=self.table)
        numbers = found.fill_null(-1).to_numpy(zero_copy_only=False)
        if found.null_count:
            fresh = parts.filter(found.is_null()).dictionary_encode()
            numbers = numbers.copy()
            numbers[numbers < 0] = fresh.indices.to_numpy(zero_copy_only=False) + len(self.table)
            self._learn(fresh.dictionary)
            self.table = pa.concat_arrays([self.table, fresh.dictionary])
        return numbers

    def _learn(self, fresh: pa.Array) -> None:
        """Plain parts are encoded in lots with a line end between them, always a pre-token of its own there."""
        plain = pc.match_substring_regex(fresh, _EVEN)
        even, odd = fresh.filter(plain).to_pylist(), fresh.filter(pc.invert(plain)).to_pylist()
        breaks = pc.count_substring(fresh.filter(plain), "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        lots = range(0, len(even), self.LOT)
        flat, n = [], []
        for i, ids in zip(lots, self._encode([" " + "\n ".join(even[i : i + self.LOT]) for i in lots]), strict=True):
            # The line ends that part the words, not those inside them.
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            ends = ends[np.cumsum(breaks[i : i + self.LOT] + 1) - 1]
            flat.append(np.delete(ids, ends[:-1]))
            n.append(np.diff(ends, prepend=-1) - 1)
        for ids in self._encode([w[1:] if w[:1] == " " else f" {w}" for w in odd]):
            flat.append(ids)
            n.append(np.array([len(ids)]))
        found = Ragged(self.ids.values.dtype)
        found.extend(np.concatenate(flat), np.concatenate(n))
        # 1: white space first, 2: white space last, 3: both, or nothing at all. A first part's own start does not matter.
        bare = [w[1:] if w[:1] == " " else w for w in odd]
        state = np.zeros(len(fresh), np.uint8)
        state[len(even) :] = np.fromiter((w[0].isspace() | w[-1].isspace() << 1 if w else 3 for w in bare), np.uint8, len(bare))
        # Back into the order in which the parts were met.
        at, mask = np.empty(len(fresh), np.int64), plain.to_numpy(zero_copy_only=False)
        at[mask], at[~mask] = np.arange(len(even)), np.arange(len(even), len(fresh))
        self.open = np.append(self.open, state[at])
        self.ids.extend(*found.gather(at))

    def _trim(self) -> None:
        """Forgets the later half of a table that has grown too large: frequent parts come early."""
        if len(self.table) > self.limit:
            left = self.limit // 2
            self.table = pa.concat_arrays([self.table.slice(0, left), pa.array([], pa.string())])
            self.ids.trim(left)
            self.open = self.open[:left].copy()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a text with added tokens is encoded as the texts between them."""
        marked = {k: self.marker.findall(x) for k, x in enumerate(texts) if self.marker.search(x)} if self.marker else {}
        if not marked:
            return self._encode_plain(texts)
        if self.wide:
            ids, n = self._encode_plain(["" if k in marked else x for k, x in enumerate(texts)])
            whole = self._encode([texts[k] for k in marked])
            at = (np.cumsum(n) - n)[list(marked)]
            k = np.array([len(x) for x in whole])
            n[list(marked)] = k
            return np.insert(ids, np.repeat(at, k), np.concatenate(whole)), n
        pieces = [self.marker.split(x) if k in marked else [x] for k, x in enumerate(texts)]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, n = self._encode_plain([x for own in pieces for x in own])
        # A marker stands after every piece of a text but its last.
        inner = np.ones(len(n), bool)
        inner[np.cumsum(counts) - 1] = False
        between = np.array([self.added[x] for own in marked.values() for x in own], ids.dtype)
        return np.insert(ids, np.cumsum(n)[inner], between), by_doc(n, counts) + counts - 1

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._trim()
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(n) - n
        numbers = self._numbers(flat)
        numbers = numbers.copy()
        numbers[heads] = self._numbers(pa.array([f" {w}" for w in flat.take(pa.array(heads)).to_pylist()], pa.string()))
        # White space beside a cut: the cut may be inside a pre-token, so in such texts only the safe cuts are made.
        state = self.open[numbers]
        unsafe = np.zeros(len(numbers), bool)
        unsafe[1:] = ((state[:-1] & 2) | (state[1:] & 1)) > 0
        unsafe[heads] = False
        odd = np.flatnonzero(by_doc(unsafe.astype(np.int64), n)).tolist()
        if odd:
            cut = [_CUT.split(texts[k]) for k in odd]
            again = self._numbers(pa.array([f" {w}" if not i else w for parts in cut for i, w in enumerate(parts)], pa.string()))
            parts = np.split(numbers, heads[1:])
            for k, own in zip(odd, np.split(again, np.cumsum([len(x) for x in cut])[:-1]), strict=True):
                parts[k], n[k] = own, len(own)
            numbers = np.concatenate(parts)
        ids, k = self.ids.gather(numbers)
        return ids, by_doc(k, n)


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.model._resize_cache(0)  # words come once, so its own cache only costs time
    return t


def _encoder(path: str, kind: str) -> WordEncoder:
    """One a worker process, so that a later task finds frequent words already encoded."""
    return held(("tokens", path, kind), lambda: WordEncoder(_tokenizer(path), np.dtype(kind)))


def encode_texts(raws: list[bytes], encoder: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the end id after each text, lengths with it)."""
    ids, n = encoder.encode([raw.decode("utf-8", "replace") for raw in raws])
    out = np.full(len(ids) + len(n), end_id, ids.dtype)
    at = np.ones(len(out), bool)
    at[np.cumsum(n + 1) - 1] = False
    out[at] = ids
    return out, n + 1


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    bounds = EliasFano.of(np.append(0, np.cumsum(lengths))).to_bytes()
    names = EliasFano.of((known - known[:1]).view(np.uint64)).to_bytes() + (known[:1] if len(known) else np.zeros(1, np.int64)).astype("<i8").tobytes()
    head = np.array([len(doc_ids), len(doc_ids) - len(known), len(ids), ids.dtype.itemsize, len(bounds), len(names)], "<i8")
    return b"".join((MAGIC, head.tobytes(), bounds, names, np.ascontiguousarray(ids, ids.dtype.newbyteorder("<")).tobytes()))


class TokenFile:
    """Reads one shard through any store that pyarrow can open; `document(i)` seeks and reads that document alone."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        head = self.file.read_at(56, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.n_docs, self.n_null, self.n_ids, self.width, bounds, names = (int(x) for x in np.frombuffer(head, "<i8", 6, 8))
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, 56))
        blob = self.file.read_at(names, 56 + bounds)
        self.names, self.least = EliasFano.from_bytes(blob[:-8]), np.frombuffer(blob[-8:], "<i8")[0]
        self.at, self.kind = 56 + bounds + names, f"<u{self.width}"

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.names.all().view(np.int64) + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds[i], self.bounds[i + 1]
        return np.frombuffer(self.file.read_at((end - start) * self.width, self.at + start * self.width), self.kind)

    def ids(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.n_ids * self.width, self.at), self.kind)


def _put(uri: str, data: bytes) -> None:
    """Whole or not at all, so that a task that runs again replaces its file."""
    system, path = fs.FileSystem.from_uri(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(tmp) as out:
        out.write(data)
    system.move(tmp, path)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int, wide: bool = False, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 32_000_000, block_bytes: int = 8_000_000) -> list[dict]:
    """Writes docs to `folder` and returns a record a file, in order: path, first (ids before it), n_docs, n_ids.

    A partition is a range of doc_id and becomes one file, or several of about shard_ids ids.
    """
    dtype = np.dtype("<u4" if wide else "<u2")
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path, dtype.str)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            uri = f"{folder}/part-{part:06d}-{roll:04d}.vtok"
            _put(uri, shard_bytes(names, ids, np.concatenate(lengths)))
            return pa.RecordBatch.from_pylist([{"part": part, "roll": roll, "path": uri, "n_docs": len(names), "n_ids": len(ids)}])

        for doc_ids, raws in blocks(batches, block_bytes):
            ids, n = encode_texts(raws, encoder, end_id)
            names += doc_ids.to_pylist()
            held.append(ids)
            lengths.append(n)
            if sum(map(len, held)) >= shard_ids:
                yield flush()
                names, held, lengths, roll = [], [], [], roll + 1
        if names:
            yield flush()

    # An id that many rows share (null, say) is split by the beginnings of their texts.
    rows, begin = id_text(docs, id_col, text_col), F.substring("raw", 1, 64)
    parts = docs.rdd.getNumPartitions()
    many = (parts,) if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    placed = rows.repartitionByRange(*many, F.col("id"), begin).sortWithinPartitions("id", "raw")
    files = sorted((r.asDict() for r in placed.mapInArrow(write, "part long, roll long, path string, n_docs long, n_ids long").collect()), key=lambda r: (r["part"], r["roll"]))
    first = 0
    for f in files:
        f["first"], first = first, first + f["n_ids"]
    return files


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in these files; a file is read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                f = TokenFile(files[k]["path"])
                ids, bounds = f.ids().astype("<u4"), f.bounds.all().astype(np.int64)
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(), pa.int64()), pa.array(bounds[:-1] + files[k]["first"]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, files)
