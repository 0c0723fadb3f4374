"""A lot of files: each is masked on its own, and the lot's report says how each fared."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import Tables
from ..sources import files as S
from .document_mode import DocOptions, mask

_log = logging.getLogger("velado")

#: An encryption dictionary where a PDF keeps it: in its trailer, or in the dictionary of a cross-reference stream.
_LOCKED = "|".join((r"trailer.{0,4000}?" + (own := r"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)"), r"/Type\s*/XRef.{0,4000}?" + own, own + r".{0,4000}?/Type\s*/XRef"))


def statuses(files: DataFrame) -> DataFrame:
    """(path, ext, status, error) before any text is read: unsupported kinds and encrypted PDFs fail, other PDFs wait for a
    page table."""
    locked = F.decode("content", "ISO-8859-1").rlike("(?s)" + _LOCKED) if "content" in files.columns else F.lit(False)
    pdf = F.col("ext") == "pdf"
    return files.select(
        "path", "ext",
        F.when(~F.col("supported") | (pdf & locked), "failed").when(pdf, "skipped").otherwise("ok").alias("status"),
        F.when(~F.col("supported"), F.concat(F.lit("unsupported: "), F.col("ext"))).when(pdf & locked, "encrypted").when(pdf, "needs a page table").alias("error"),
    )


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def run(spark: SparkSession, path: str, options: DocOptions = DocOptions(), recursive: bool = True, first_names: Column | Iterable[str] | None = None) -> DataFrame:
    """Masks the TXT and DOCX files under a path, each beside its source, and returns the report of the whole lot.

    A file that cannot be read or written is reported as failed, and the others go on. The log gets counts only: values and
    texts are never logged, and errors are told by their type.
    """
    tables = Tables(spark, "batch")
    found = S.scan(spark, path, recursive)
    texts = mask(S.txt(found), "text", options, first_names).select(S.output_path(F.col("path")).alias("out_path"), F.col("text").cast("binary").alias("data"))
    read = tables.write(mask(S.docx(found, errors=True), "text", options, first_names), "paragraphs")
    broken = read.filter("error is not null").select(F.col("path").alias("b_path"), F.col("error").alias("b_error"))
    paragraphs = read.filter("error is null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("para_no", "text"))).alias("texts"))

    def rebuild(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"out_path": part["out_path"], "data": [S.rebuilt_docx(c, dict(t)) for c, t in zip(part["content"], part["texts"], strict=True)]})

    whole = found.filter("ext = 'docx'").join(broken, F.col("path") == F.col("b_path"), "left_anti").join(paragraphs, "path", "left")
    whole = whole.select(S.output_path(F.col("path")).alias("out_path"), "content", F.coalesce("texts", F.create_map().cast("map<int,string>")).alias("texts"))
    results = texts.unionByName(whole.mapInPandas(rebuild, "out_path string, data binary"))
    wrote = tables.write(S.write_files(results), "wrote").withColumnsRenamed({"status": "w_status", "error": "w_error"})
    report = statuses(found).withColumn("out_path", S.output_path(F.col("path"))).join(wrote, "out_path", "left").join(broken, F.col("path") == F.col("b_path"), "left")
    status = F.when(F.col("status") == "ok", F.coalesce("w_status", F.lit("failed"))).otherwise(F.col("status"))
    report = tables.write(report.select("path", "ext", status.alias("status"), F.coalesce("error", "w_error", "b_error").alias("error"), "out_path"), "report")
    tables.drop("paragraphs", "wrote")
    for row in summary(report).orderBy("status").collect():
        _log.info("%d files: %s", row.n, row.status)
    return report
