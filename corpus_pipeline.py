"""From raw documents to counted tokens: language ID, exact and near deduplication, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame, which `run`
writes as Parquet to the shared folder and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velado.llm import decontaminate, exact_dedup, language, near_dedup, pieces
from velado.llm.common import scratch, without, written
from velado.plans.session import prepared

#: A document stays if it has a letter and its language's share of the label probabilities is at least this.
LEAST_SHARE = 0.4
#: Words of a window of a benchmark item.
WINDOW = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = language.predict(docs, language.train(docs), keep=True)
    return labelled.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).drop("lang_pred", "score").toDF(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document with any window of eight words of any benchmark item goes, or with two items that are shorter: a single
    short item may be a common phrase."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.search(decontaminate.build_index(docs, scratch(spark, "positions")), items, size=WINDOW)
    hit = written(found.filter("size(items) > 0").select("doc_id", "items"), "hits")
    n_words = F.size(F.filter(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    whole = items.filter(n_words >= WINDOW).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    by_window = hit.select("doc_id", F.explode("items").alias("item")).join(whole, "item", "left_semi").select("doc_id")
    return without(docs, written(hit.filter("size(items) > 1").select("doc_id").union(by_window).distinct(), "leaks"), "doc_id")


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that may be called by itself, in a session as it comes."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(prepared(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _stage(known_language)),
    ("exact_dedup", _stage(exact_duplicates)),
    ("near_dedup", _stage(near_duplicates)),
    ("decontamination", _stage(benchmark_leaks)),
    ("sentencepiece", _stage(sentence_pieces)),
]

#: No SQL: the language model, the signatures and the pieces are beyond it. tests/llm holds the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
