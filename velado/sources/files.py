"""Files as rows: which to take, texts out of TXT and DOCX, and masked files beside a report of how each fared.

PDF pages come and go as tables (see operators.layout): no PDF library is at hand to read or write the format itself.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "txt", "docx")
DONE = "_anonimizado"
#: What a broken or locked file raises; the type's name is all that is told of it, as messages may hold parts of the file.
UNREADABLE = (zipfile.BadZipFile, KeyError, ET.ParseError, RuntimeError, NotImplementedError, EOFError, ValueError, OSError, zlib.error, TypeError)
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def output_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", f"{DONE}$1")


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content, ext, supported) of the files under a path, less those that are results of an earlier run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    return files.filter(~F.element_at(F.split("path", "/"), -1).contains(DONE)).withColumn("ext", extension(F.col("path"))).withColumn("supported", F.col("ext").isin(*SUPPORTED))


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters for what is none, and line feeds for all line ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def txt(files: DataFrame) -> DataFrame:
    return files.filter("ext = 'txt'").select("path", decoded(F.col("content")).alias("text"))


def _paragraphs(root: ET.Element) -> Iterator[tuple[ET.Element, bool]]:
    """The body's paragraphs, then those of its tables' cells."""
    body = root.find(f"{W}body")
    if body is None:
        return
    for p in body.findall(f"{W}p"):
        yield p, False
    for table in body.findall(f"{W}tbl"):
        for row in table.findall(f"{W}tr"):
            for cell in row.findall(f"{W}tc"):
                for p in cell.findall(f"{W}p"):
                    yield p, True


def _text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def docx(files: DataFrame, errors: bool = False) -> DataFrame:
    """(path, para_no, in_table, text): a rule never sees beyond its paragraph. A file that cannot be read is one row of nulls
    with an `error` if errors are asked for; otherwise it fails the job."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = ET.fromstring(z.read("word/document.xml"))
                except UNREADABLE as e:
                    if not errors:
                        raise
                    rows.append((path, None, None, None, type(e).__name__))
                    continue
                rows += [(path, k, in_table, _text(p), None) for k, (p, in_table) in enumerate(_paragraphs(root))]
            out = pd.DataFrame(rows, columns=["path", "para_no", "in_table", "text", "error"]).astype({"para_no": "Int32", "in_table": "boolean"})
            yield out if errors else out.drop(columns="error")

    schema = "path string, para_no int, in_table boolean, text string" + ", error string" * errors
    return files.filter("ext = 'docx'").select("path", "content").mapInPandas(read, schema)


def rebuilt_docx(content: bytes, texts: dict[int, str]) -> bytes:
    """The file with these paragraphs' texts; a paragraph that changes loses its runs' formatting."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {name: z.read(name) for name in z.namelist()}
    root = ET.fromstring(parts["word/document.xml"])
    for k, (p, _) in enumerate(_paragraphs(root)):
        if k in texts and texts[k] != _text(p):
            for child in [c for c in p if c.tag != f"{W}pPr"]:
                p.remove(child)
            t = ET.SubElement(ET.SubElement(p, f"{W}r"), f"{W}t")
            t.text = texts[k]
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    parts["word/document.xml"] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def write_files(results: DataFrame) -> DataFrame:
    """Writes (out_path, data) rows, each file whole or not at all, and returns (out_path, status, error)."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            rows = []
            for path, data in zip(part["out_path"], part["data"], strict=True):
                try:
                    store, at = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
                    tmp = f"{at}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(tmp) as out:
                        out.write(data)
                    store.move(tmp, at)
                    rows.append((path, "ok", None))
                except OSError as e:  # one file's failure does not stop the lot; it is reported
                    rows.append((path, "failed", type(e).__name__))
            yield pd.DataFrame(rows, columns=["out_path", "status", "error"])

    return results.select("out_path", "data").mapInPandas(put, "out_path string, status string, error string")
