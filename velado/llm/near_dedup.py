"""MinHash near-deduplication with BagMinHash: weighted-Jaccard signatures, banding, and exact multiset overlap.

A document is the multiset of its five-word shingles (a shorter one: one shingle of all its words). Each shingle owns
Poisson processes over its discretised weights: one for the first copy, one for each further doubling (1, 2], (2, 4] ...,
whose points are split over the levels inside; a point counts if its level is within the document's count, and each
component of the signature keeps its earliest point. Two documents agree in a component with the probability of their
weighted Jaccard similarity. Points come in time order, so only those before a document's bound are ever drawn: about
m log m of them, however many shingles it has.

Identical multisets become one node first. Nodes that share a band meet their bucket's smallest node (a star, not all
pairs); each such pair is verified by exact overlap, and verified pairs make components. Buckets that still hold several
components are compared in blocks, across components only, so no link between different texts is lost; what a block
finds leaves it as a spanning forest. Classes are connected components of links of similarity 0.8 or more.

Nulls and edges: a document without words (null, empty, marks only) is a class of its own; repeated rows and copies fall
into one class; a class is named by its smallest doc_id; where ids are null, they do not name a class. Further columns are
ignored by `classes` and pass through `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tables, Words, blocks, id_text, let_go, mixed, spans, without, written
from .decontaminate import hashes
from .features import terms

BANDS, ROWS = 25, 5
M = BANDS * ROWS
GOLDEN = U64(0x9E3779B97F4A7C15)


class Bags:
    """Blocks of texts -> multisets of hashed shingles, concatenated: (hashes, counts, distinct shingles a document)."""

    def __init__(self, width: int = 5):
        self.width, self.words, self.known = width, Words(), np.empty(0, U64)

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if left := self.words.trim():
            self.known = self.known[:left].copy()
        parts = [self.words.numbers(terms(raw)) for raw in raws]
        if fresh := self.words.take():
            self.known = np.append(self.known, hashes(fresh))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = self.known[np.concatenate(parts)] if n.sum() else np.empty(0, U64)
        # Sums of the words times odd constants by place; a short document's words fill the first places.
        wide = np.concatenate((flat, np.zeros(self.width, U64)))
        total = np.zeros(len(flat), U64)
        ends = np.repeat(np.cumsum(n), n)
        at = np.arange(len(flat))
        for k in range(self.width):
            total += np.where(at + k < ends, wide[k : k + len(flat)], U64(0)) * (mixed(np.array([k + 1], U64) * GOLDEN)[0] | U64(1))
        shingles = np.where(n > 0, np.maximum(n - self.width + 1, 1), 0)
        pick = spans(np.cumsum(n) - n, shingles)
        found = mixed(total[pick])
        doc = np.repeat(np.arange(len(n)), shingles)
        order = np.lexsort((found, doc))
        found, doc = found[order], doc[order]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(first)
        return found[where], np.diff(np.append(where, len(found))), np.bincount(doc[where], minlength=len(n))


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from mixed 64-bit numbers."""
    return ((x >> U64(11)).astype(float) + 0.5) * 2.0**-53


def bag_min_hash(shingles: np.ndarray, counts: np.ndarray, distinct: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures (documents x m, uint32) of multisets; a row of zeros where there is no shingle."""
    docs = len(distinct)
    own = np.repeat(np.arange(docs), distinct)
    weight = np.bincount(own, counts, docs)
    best, name = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint32)
    # Processes: (shingle, shell). Shell 0 is the weight (0, 1], shell s the weights (2^(s-1), 2^s].
    shell = np.zeros(len(own), np.int64)
    entry = np.arange(len(own))
    s = 1
    while len(more := np.flatnonzero(counts > 1 << (s - 1))):
        entry, shell, s = np.append(entry, more), np.append(shell, np.full(len(more), s)), s + 1
    doc, most = own[entry], counts[entry]
    seed = mixed(shingles[entry] + shell.astype(U64) * GOLDEN)
    low = np.where(shell > 0, 1 << np.maximum(shell - 1, 0), 0)
    width = np.where(shell > 0, low, 1)
    time, k = np.zeros(len(entry)), np.zeros(len(entry), np.int64)
    bound = m * (np.log(m) + 2.0) / np.maximum(weight, 1)
    live = np.arange(len(entry))
    while len(live):
        ahead = live
        lot = 1
        while len(ahead):
            step = mixed(seed[ahead, None] + (k[ahead, None] + np.arange(1, lot + 1)).astype(U64) * GOLDEN)
            t = time[ahead, None] + np.cumsum(-np.log(_uniform(step)) / width[ahead, None], axis=1)
            in_time = t <= bound[doc[ahead], None]
            drawn = in_time.sum(axis=1)
            r, c = np.nonzero(in_time)
            point = mixed(step[r, c] ^ GOLDEN)
            p = ahead[r]
            level = low[p] + 1 + ((point >> U64(32)).astype(np.int64) * width[p] >> 32)
            fits = level <= most[p]
            at = doc[p][fits] * m + ((point[fits] & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
            t_fit, tag = t[r, c][fits], (mixed(point[fits]) & U64(0xFFFFFFFF)).astype(np.uint32)
            # The earliest point of each component: in time order, later ones first, so that the earliest is written last.
            order = np.argsort(-t_fit, kind="stable")
            at, t_fit, tag = at[order], t_fit[order], tag[order]
            better = t_fit < best[at]
            best[at[better]], name[at[better]] = t_fit[better], tag[better]
            # Go on after the points drawn; the first beyond the bound is drawn again when the bound has moved.
            last = np.where(drawn > 0, t[np.arange(len(ahead)), np.maximum(drawn - 1, 0)], time[ahead])
            time[ahead], k[ahead] = last, k[ahead] + drawn
            ahead, lot = ahead[drawn == lot], min(64, 2 * lot)
        open_ = np.isinf(best.reshape(docs, m)).any(axis=1) & (weight > 0)
        bound = np.where(open_, bound * 2, bound)
        live = live[open_[doc[live]]]
    return name.reshape(docs, m)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted hashes, counts)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def pack_bag(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    return shingles.astype("<u8").tobytes() + counts.astype("<u4").tobytes()


def unpack_bag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, "<u8", n), np.frombuffer(bag, "<u4", n, 8 * n).astype(np.int64)


def node_of(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 500_000) -> DataFrame:
    """(id, node, sig) of each row; node, the digest of the multiset, and sig are null where there are no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bags = Bags()
        for ids, raws in blocks(batches, block_bytes):
            h, c, n = bags(raws)
            sig = bag_min_hash(h, c, n)
            ends = np.cumsum(n)
            nodes = [node_of(pack_bag(h[e - k : e], c[e - k : e])) if k else None for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.binary()), pa.array([sig[i].tobytes() if k else None for i, k in enumerate(n)], pa.binary())], names=["id", "node", "sig"])

    return id_text(docs, id_col, text_col).mapInArrow(sign, "id long, node binary, sig binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(band, key, node), a row for each of a node's bands."""
    part = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))")
    return nodes.select("node", F.posexplode(part).alias("band", "key")).select("band", "key", "node")


def bags_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, bits: int = 1 << 25) -> DataFrame:
    """(node, bag) of the wanted nodes. A filter of fixed size, from all wanted nodes, keeps most other texts from the shuffle."""
    slices = 64

    def fold(table: pa.Table) -> pa.Table:
        found = np.zeros(bits // slices, bool)
        for node in table["node"].to_pylist():
            found[int.from_bytes(node[1:8], "little") % len(found)] = True
        return pa.table({"slice": table["slice"].slice(0, 1), "bits": [np.packbits(found, bitorder="little").tobytes()]})

    of = wanted.select("node", F.pmod(F.ascii(F.decode(F.substring("node", 1, 1), "ISO-8859-1")), F.lit(slices)).alias("slice"))
    filters = [b""] * slices
    for row in of.groupBy("slice").applyInArrow(fold, "slice int, bits binary").collect():
        filters[row.slice] = bytes(row.bits)

    def maybe(node: bytes) -> bool:
        held = filters[node[0] % slices]
        at = int.from_bytes(node[1:8], "little") % (bits // slices)
        return bool(held) and bool(held[at >> 3] >> (at & 7) & 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bags, seen = Bags(), set()
        for _, raws in blocks(batches, 500_000):
            h, c, n = bags(raws)
            ends = np.cumsum(n).tolist()
            found = {}
            for e, k in zip(ends, n.tolist(), strict=True):
                if k and (node := node_of(bag := pack_bag(h[e - k : e], c[e - k : e]))) not in seen and maybe(node):
                    found[node] = bag
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], names=["node", "bag"])

    all_ = id_text(docs, id_col, text_col).mapInArrow(pack, "node binary, bag binary")
    # Copies have equal bags, so any one of them serves; a task sends one of each, however many it has.
    return all_.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("bag").alias("bag"))


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact overlap is at least `least`. A node that many pairs share is a skewed key of a plain join, which Spark splits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True):
                if last[0] != y:
                    last = (y, unpack_bag(y))
                keep.append(overlap(unpack_bag(x), last[1]) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: label is the smallest node of its component.

    Alternates large-star and small-star steps, a table in the shared folder each, until one changes nothing: then every
    edge leads from a node to its component's smallest. Rounds grow with the logarithm of the nodes; none is cut short.
    """
    tables = Tables(edges.sparkSession, "components")
    e = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "0")
    before = None
    for k in count(1):
        # Large star: of each node, the larger neighbours point to the smallest of it and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: of each node, it and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("p")).select(F.col("p.x").alias("u"), F.col("p.m").alias("v")).filter("u != v").distinct()
        e = tables.write(small, str(k))
        tables.drop(str(k - 1))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def across(members: DataFrame, least: float, block_rows: int) -> DataFrame:
    """Verified pairs across components inside buckets that hold several: (band, key, node, label, sig, bag, size) -> (a, b).

    A bucket's rows fall into blocks of about block_rows; each pair of blocks is a task's group and returns a spanning forest.
    """
    rough = int(M * max(0.0, least - 0.2))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        i, j, band = table["i"][0].as_py(), table["j"][0].as_py(), table["band"][0].as_py()
        block = table["block"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, M)
        bags = [unpack_bag(b) for b in table["bag"].to_pylist()]
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        a_found, b_found = [], []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left.tolist():
            others = right[right > x] if i == j else right
            same = sig[others] == sig[x]
            others = others[same.sum(axis=1) >= rough]
            if not len(others):
                continue
            # A pair that meets in several bands is compared in the first of them.
            first = (sig[others] == sig[x]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            for y in others[first == band].tolist():
                if find(labels[x]) != find(labels[y]) and overlap(bags[x], bags[y]) >= least:
                    root[find(labels[x])] = find(labels[y])
                    a_found.append(nodes[x])
                    b_found.append(nodes[y])
        return pa.table({"a": pa.array(a_found, pa.binary()), "b": pa.array(b_found, pa.binary())})

    blocks_of = F.ceil(F.col("size") / block_rows)
    placed = members.withColumn("n", blocks_of).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    pairs = pairs.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "sig", "bag")
    return pairs.groupBy("band", "key", "i", "j").applyInArrow(compare, "a binary, b binary")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, block_rows: int = 1000, salts: int = 8) -> DataFrame:
    """(id, class_id, node) of each row of docs."""
    sigs = written(signatures(docs, id_col, text_col), "signatures")
    nodes = sigs.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes, "nodes")
    banded = bands(nodes)
    buckets = written(banded.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = written(banded.join(buckets, ["band", "key"]), "members")
    star = written(members.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    wanted = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    bags = written(bags_of(docs, wanted, id_col, text_col), "bags")
    links = written(verified(star, bags, least), "links")
    labels = components(links)
    # Buckets whose members are not yet one component.
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_ = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band", "key")
    rest = written(labelled.join(mixed_, ["band", "key"], "left_semi").join(nodes.select("node", "sig"), "node").join(bags, "node").select("band", "key", "node", "label", "sig", "bag", "size"), "rest")
    more = written(across(rest, least, block_rows), "links")
    labels = components(links.unionByName(more)) if not more.isEmpty() else labels
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labels.join(nodes.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("class_id"))
    of_node = named.join(smallest, "label", "left").select("node", F.coalesce("class_id", "id").alias("class_id"), "n", "id").filter("n > 1 or not (class_id <=> id)").select("node", "class_id")
    of_node = of_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sigs.select("id", "node", F.pmod(F.hash("id"), F.lit(salts)).alias("salt"))
    return rows.join(of_node, ["node", "salt"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "node")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """docs with one row of each class, the one with the smallest id; all columns. A row without an id always stays."""
    found = written(classes(docs, id_col=id_col, text_col=text_col, least=least), "classes")
    kept = without(docs, found.filter("id != class_id").select("id"), id_col)
    again = written(found.filter("id = class_id").groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if again.isEmpty():
        return kept
    # Rows that repeat a class's smallest id: one of them stays.
    return without(kept, again, id_col).unionByName(kept.join(again.select(F.col("id").alias("repeated_id")), kept[id_col].cast("long") == F.col("repeated_id"), "left_semi").dropDuplicates([id_col]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", F.expr("id <=> class_id").alias("kept"))


ORACLE = r"""
with recursive lower_d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
sh as (select doc_id, s, count(*) as c from (select doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from lower_d where len(w) > 0)) group by all),
tot as (select doc_id, sum(c) as t from sh group by all),
pair as (select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as shared from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
edge as (select a, b from pair join tot ta on ta.doc_id = a join tot tb on tb.doc_id = b where shared / (ta.t + tb.t - shared) >= 0.8),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join edge e on r.b = e.a)
select a as doc_id, min(b) as class_id, a = min(b) as kept from reach group by a
"""
