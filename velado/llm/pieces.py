"""SentencePiece encoding and decoding over a shared-prefix trie of words.

White space becomes a mark before each word, so distinct marked words recur and are encoded once. A task sorts its new
words, which lays out their trie, and walks it depth first: what a prefix's characters gave is kept on a stack and reused
by every word that begins alike. For a unigram model the state of a prefix is its best score and last piece (Viterbi). A
BPE model has no scores to add: its state is the last piece of the prefix's exact encoding, and a piece ends a prefix if
and only if it stands unchanged beside the last piece of what it leaves over, so the same walk finds the merges' result.

Decoding looks pieces up in a table of bytes. Encoding a text and decoding it gives the text again, except that U+2581
reads as a space, as in the format itself.

Nulls and edges: a null or empty text has no ids and decodes to empty text; characters without a piece become byte pieces
where the model has them, else the unknown id. Texts are encoded whole. Repeated rows each get a row. Further columns are
ignored by `encode` and `decode`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Ragged, Words, blocks, by_doc, held, id_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Model:
    """What encoding needs of a model file: pieces, scores, kinds and the treatment of white space."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        self.kind = m.trainer_spec.model_type
        self.pieces = [p.piece for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        self.kinds = [p.type for p in m.pieces]
        n = m.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or UNUSED in self.kinds or not n.escape_whitespaces:
            raise ValueError("a unigram or BPE model without unused pieces, and with escaped white space, is needed")
        self.plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and USER not in self.kinds
        self.prefix = n.add_dummy_prefix
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        # Words may be encoded one by one if no piece crosses from a character into a mark.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.longest = max(map(len, self.ids), default=1)

    def byte_table(self) -> Ragged:
        """The bytes that each id decodes to."""
        table = Ragged(np.uint8)
        back = {k: bytes([b]) for b, k in self.bytes.items()}
        unknown = " ⁇ ".encode()
        table.append([back.get(k) or (b"" if self.kinds[k] == CONTROL else unknown if self.kinds[k] == UNKNOWN else p.replace(MARK, " ").encode()) for k, p in enumerate(self.pieces)])
        return table


class Trie:
    """The walk over sorted words. Frames are (last piece, characters before it, score) of each prefix."""

    def __init__(self, model: Model):
        self.model = model
        #: Pieces by their characters from the last to the first: {character: [id or None, next]}.
        self.ends: dict = {}
        for piece, k in model.ids.items():
            level = self.ends
            for ch in reversed(piece):
                node = level.setdefault(ch, [None, {}])
                level = node[1]
            node[0] = k
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # In single precision, in which the format's own encoder adds: where sums are equal but for rounding, it decides.
        self.scores = [np.float32(s) for s in model.scores]
        self.penalty = np.float32(min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0)) - np.float32(10)

    def merge(self, text: str) -> list[int]:
        """BPE by its definition: again and again the best-scoring adjacent pair, the leftmost of equals. -1: no piece."""
        ids, scores, parts = self.model.ids, self.model.scores, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def stands(self, a: int, b: int) -> bool:
        """Whether pieces a and b, side by side, are the encoding of their text."""
        key = a << 32 | b
        if (known := self.beside.get(key)) is None:
            if len(self.beside) > 300_000:
                self.beside.clear()
            known = self.beside[key] = self.merge(self.model.pieces[a] + self.model.pieces[b]) == [a, b]
        return known

    def alone(self, k: int) -> bool:
        if (known := self.whole.get(k)) is None:
            known = self.whole[k] = self.merge(self.model.pieces[k]) == [k]
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted words; a character without a piece is -1 less its code point."""
        bpe = self.model.kind == BPE
        step, ends = (self._bpe if bpe else self._viterbi), self.ends
        out: list[list[int]] = []
        frames: list = [(None, 0, np.float32(0))]
        before = ""
        for word in words:
            if bpe and word[:2] == MARK * 2:
                # Marks side by side score alike, where only the order of merging decides.
                out.append([k if k >= 0 else -1 - ord(c) for k, c in self._spelled(word)])
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del frames[shared + 1 :]
            for i in range(shared, len(word)):
                frames.append(step(word, i, frames, ends))
            before, found, i = word, [], len(word)
            while i:
                k, i, _ = frames[i]
                found.append(k)
            found.reverse()
            out.append(found)
        return out

    def _spelled(self, word: str) -> list[tuple[int, str]]:
        ids, at = [], 0
        for k in self.merge(word):
            ids.append((k, word[at]))
            at += len(self.model.pieces[k]) if k >= 0 else 1
        return ids

    def _bpe(self, word: str, i: int, frames: list, level: dict) -> tuple:
        j = i
        while j >= 0:
            node = level.get(word[j])
            if node is None:
                break
            k, level = node
            if k is not None:
                last = frames[j][0]
                if (last is None or last < 0 or self.stands(last, k)) and (self.alone(k) if j == i or last is None or last < 0 else True):
                    return k, j, 0.0
            j -= 1
        return -1 - ord(word[i]), i, 0.0

    def _viterbi(self, word: str, i: int, frames: list, level: dict) -> tuple:
        # Of equal scores the longer last piece wins.
        best = (-1 - ord(word[i]), i, frames[i][2] + self.penalty)
        j = i
        while j >= 0:
            node = level.get(word[j])
            if node is None:
                break
            k, level = node
            if k is not None:
                score = frames[j][2] + self.scores[k]
                if score >= best[2] or (j == i and best[0] < 0):
                    best = (k, j, score)
            j -= 1
        return best


class Encoder:
    """Blocks of texts -> ids; words in the table are not walked again."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.model = Model(data)
        self.trie, self.words = Trie(self.model), Words(250_000)
        self.ids, self.table = Ragged(np.int32), self.model.byte_table()
        self.normalize = None
        if not self.model.plain:
            from sentencepiece import SentencePieceProcessor

            self.normalize = SentencePieceProcessor(model_proto=data).normalize

    def marked(self, text: str) -> list:
        """The text's words, each less its first mark; (text,) where it can't be taken word by word."""
        if self.normalize:
            text = self.normalize(text)
        elif text:
            text = (MARK + text if self.model.prefix else text).replace(" ", MARK)
        if not text:
            return []
        if not self.model.by_word or text[0] != MARK:
            return [(text,)]
        words = text.split(MARK)[1:]
        if "" in words:
            # Marks in a row belong to the word after them.
            merged, extra = [], 0
            for w in words[:-1]:
                if w:
                    merged.append(MARK * extra + w)
                    extra = 0
                else:
                    extra += 1
            merged.append(MARK * extra + words[-1])
            words = merged
        return words

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if left := self.words.trim():
            self.ids.trim(left)
        parts = [self.words.numbers(self.marked(t)) for t in texts]
        if fresh := self.words.take():
            spelled = [w[0] if type(w) is tuple else MARK + w for w in fresh]
            order = sorted(range(len(spelled)), key=spelled.__getitem__)
            found: list = [None] * len(fresh)
            for k, ids in zip(order, self.trie.encode([spelled[k] for k in order]), strict=True):
                found[k] = ids if min(ids) >= 0 else self._with_bytes(ids)
            self.ids.append(found)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, k = self.ids.gather(np.concatenate(parts) if n.sum() else np.empty(0, np.int32))
        return ids, by_doc(k, n)

    def _with_bytes(self, ids: list[int]) -> list[int]:
        out: list[int] = []
        for k in ids:
            if k >= 0:
                out.append(k)
            elif self.model.bytes:
                out += [self.model.bytes[b] for b in chr(-1 - k).encode()]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)
        return out

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        flat, k = self.table.gather(ids)
        ends = np.cumsum(by_doc(k, n)).tolist()
        data, start, out = flat.tobytes(), 0, []
        for end in ends:
            out.append(data[start + (self.model.prefix and data[start : start + 1] == b" " and end > start) : end])
            start = end
        return out


def encoder(path: str) -> Encoder:
    """One a worker process, so that a later task finds frequent words already encoded."""
    return held(("pieces", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1_000_000) -> DataFrame:
    """(id, ids) of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for names, raws in blocks(batches, block_bytes):
            ids, n = e([raw.decode("utf-8", "replace") for raw in raws])
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(apply, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids decode to empty text, ids that the model lacks fail."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            flat = np.array([k for x in lists for k in x], np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(e.model.pieces)):
                raise ValueError("an id outside the model")
            texts = e.decode(flat, np.fromiter(map(len, lists), np.int64, len(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(apply, "id long, text string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1_000_000) -> DataFrame:
    """(id, n_tokens, ids_crc32, n_bytes, text_crc32, round_trip): ids and the text decoded from them, as digests."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for names, raws in blocks(batches, block_bytes):
            ids, n = e([raw.decode("utf-8", "replace") for raw in raws])
            back, wide = e.decode(ids, n), ids.astype("<u4")
            ends = np.cumsum(n)
            crcs = [zlib.crc32(wide[i:j]) for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(n), pa.array(crcs, pa.int64()), pa.array([len(t) for t in back], pa.int64()), pa.array([zlib.crc32(t) for t in back], pa.int64()), pa.array([a == b for a, b in zip(back, raws, strict=True)], pa.bool_()), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))],
                names=["id", "n_tokens", "ids_crc32", "n_bytes", "text_crc32", "round_trip", "ids"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(apply, "id long, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long, round_trip boolean, ids array<int>")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
