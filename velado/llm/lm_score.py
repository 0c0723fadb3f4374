"""Language-model scores by stupid backoff.

Count tables of all n-grams up to the order live in buckets by hash; every document's n-grams are joined to them there
(by the pages of `pages`), and logarithms are summed by document. A word's score is count(context, word) / count(context)
at the longest context whose n-gram is in the table, times 0.4 for each word the context lost; n-grams of two words and
more are in the table from `min_count` occurrences on. A word that the corpus lacks counts as half a time. Counts are of
the whole corpus, and every text is scored whole; contexts never cross documents.

Words are those of `decontaminate`: lower-case runs of letters and digits.

Nulls and edges: a null, empty or wordless text has no words and score 0; copies count as often as they occur and score
alike; an empty corpus makes every word count half a time in one. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Words, held, mixed, scratch
from .decontaminate import hashes
from .features import terms
from .pages import Answers, answered, buckets_for, distinct, gather, scan

#: The n-gram of no words, of which there are as many as words.
NOTHING = U64(0x9D39247E33776D41)
SCORE = "id long, n_words long, log_score double"


class NGrams:
    """A block's n-grams: by order, hashes of those that end at each word (NOTHING where the document has too few)."""

    def __init__(self, order: int):
        self.order, self.words, self.known = order, Words(), np.empty(0, U64)

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(orders x words, words by document)."""
        if left := self.words.trim():
            self.known = self.known[:left].copy()
        parts = [self.words.numbers(terms(raw)) for raw in raws]
        if fresh := self.words.take():
            self.known = np.append(self.known, hashes(fresh))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = self.known[np.concatenate(parts)] if n.sum() else np.empty(0, U64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        out = np.full((self.order, len(flat)), NOTHING)
        total = np.zeros(len(flat), U64)
        for k in range(self.order):
            back = np.concatenate((np.zeros(k, U64), flat[: len(flat) - k] if k else flat))[: len(flat)]
            total = total + back * (mixed(np.array([k + 1], U64) * U64(0x9E3779B97F4A7C15))[0] | U64(1))
            has = place >= k
            out[k, has] = mixed(total[has] + U64(k))
        return out, n


def ngrams(order: int) -> NGrams:
    """One a worker process: it keeps the hashes of frequent words."""
    return held(("ngrams", order), lambda: NGrams(order))


def _asked(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes and counts of a block: n-grams, and NOTHING as often as there are words."""
    words = grams.shape[1]
    names, back, counts = distinct(np.append(grams.reshape(-1), NOTHING))
    counts[np.searchsorted(names, NOTHING)] = words
    return names, back[:-1].reshape(grams.shape), counts


def log_scores(totals: np.ndarray, back: np.ndarray, grams: np.ndarray, nothing: int, min_count: int, alpha: float) -> np.ndarray:
    """ln of each word's score from the totals of its n-grams."""
    order, words = grams.shape
    c = totals[back]
    out = np.log(np.maximum(c[0], 0.5) / max(1, nothing))
    for k in range(1, order):
        has = grams[k] != NOTHING
        # The context of the n-gram that ends here is the (n-1)-gram that ends one word before.
        context = np.concatenate(([1], c[k - 1][:-1])) if words else c[k - 1]
        seen = has & (c[k] >= min_count)
        out = np.where(has, out + np.log(alpha), out)
        out[seen] = np.log(c[k][seen] / context[seen])
    return out


def score(docs: DataFrame, corpus: DataFrame | None = None, *, order: int = 3, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6_000_000, buckets: int | None = None) -> DataFrame:
    """(id, n_words, log_score) of each row of docs under the counts of `corpus` (docs itself, if not given)."""
    buckets = buckets or buckets_for(docs if corpus is None else corpus, 8)
    how = {"id_col": id_col, "text_col": text_col, "block_bytes": block_bytes}

    def ask(weight: int):
        """weight 1: the block's n-grams count; 0: it only asks."""

        def of_block(mark: int, ids: pa.Array, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            names, _, counts = _asked(ngrams(order)(raws)[0])
            return names, counts * weight

        return lambda part: of_block

    own = corpus is None
    asked = gather(docs, ask(int(own)), buckets, **how)
    if not own:
        asked = asked.unionByName(gather(corpus, ask(1), buckets, prefix="corpus-", **how))
    folder = answered(asked, scratch(docs.sparkSession, "totals"), "corpus-")

    def sum_up(part: str):
        known = Answers(folder, part)
        return lambda mark, ids, raws: of_block(known, mark, ids, raws)

    def of_block(known: Answers, mark: int, ids: pa.Array, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        grams, n = ngrams(order)(raws)
        names, back, _ = _asked(grams)
        totals = known.totals(mark, names)
        logs = log_scores(totals, back, grams, int(totals[np.searchsorted(names, NOTHING)]), min_count, alpha)
        sums = np.array([float(x.sum()) for x in np.split(logs, np.cumsum(n)[:-1])]) if len(n) else np.empty(0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums)], names=["id", "n_words", "log_score"])

    return scan(docs, sum_up, SCORE, **how)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs).select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.greatest("n_words", F.lit(1)), 6).alias("mean_log_score"))


ORACLE = r"""
with w as materialized (
  select doc_id, i, words[i] as w, words[i-1] as w1, words[i-2] as w2 from (
    select doc_id, words, unnest(range(1, len(words) + 1)) as i from (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents))),
c1 as (select w, count(*) as c from w group by all),
c2 as (select w1, w, count(*) as c from w where i > 1 group by all),
c3 as (select w2, w1, w, count(*) as c from w where i > 2 group by all),
s as (
  select w.doc_id,
    case when w.i > 2 and c3.c >= 2 then ln(c3.c / h2.c)
         when w.i > 1 and c2.c >= 2 then ln(c2.c / h1.c) + case when w.i > 2 then ln(0.4) else 0 end
         else ln(c1.c / (select count(*) from w)) + ln(0.4) * least(w.i - 1, 2) end as s
  from w join c1 on c1.w = w.w
    left join c2 on c2.w1 = w.w1 and c2.w = w.w and w.i > 1
    left join c3 on c3.w2 = w.w2 and c3.w1 = w.w1 and c3.w = w.w and w.i > 2
    left join c1 as h1 on h1.w = w.w1
    left join c2 as h2 on h2.w1 = w.w2 and h2.w = w.w1),
t as (select doc_id, count(*) as n, sum(s) as s from s group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, round(coalesce(s, 0), 4) as log_score, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) as mean_log_score
from documents d left join t on t.doc_id = d.doc_id
"""
