"""Résumé files: upload guard and text extraction."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens import vocab

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_resume_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension():
    return F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))


def guard_uploads(files: DataFrame) -> DataFrame:
    """Add ``reject_reason``: NULL for a file of an accepted kind and size."""
    reason = (F.when(~extension().isin(*vocab.UPLOAD_EXTENSIONS), vocab.UPLOAD_REASONS["extension"])
              .when(F.col("length") > vocab.UPLOAD_MAX_BYTES, vocab.UPLOAD_REASONS["size"]))
    return files.withColumn("reject_reason", reason)


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files."""
    guarded = guard_uploads(files)
    return (guarded.where("reject_reason IS NULL").drop("reject_reason"),
            guarded.where("reject_reason IS NOT NULL"))


def _docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))
    return "\n".join(p for p in paragraphs if p).strip()


def extract_text(files: DataFrame, pdf_text=None) -> DataFrame:
    """Files (path, content) to (path, text, reason) by extension; a file that gives no text says why.

    Word documents are unzipped here; ``pdf_text(bytes) -> str`` plugs in a PDF library and
    without one PDF files give ''. All else is decoded as UTF-8, bad bytes dropped. A damaged or
    encrypted file never fails the job, whatever its reader raises.
    """
    def one(path, content):
        name = path.lower()
        if content is None or not len(content):
            return ""
        if name.endswith(".pdf"):
            return pdf_text(content) if pdf_text else ""
        if name.endswith((".docx", ".doc")):
            return _docx_text(content)
        return bytes(content).decode("utf-8", errors="ignore")

    def safe(path, content):
        try:
            return one(path, content)
        except Exception:       # noqa: BLE001  readers raise what they like on damaged files
            return ""

    def run(batches):
        for batch in batches:
            texts = [safe(p or "", c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "text": texts,
                                "reason": [None if t.strip() else vocab.UPLOAD_REASONS["unreadable"] for t in texts]})
    return files.select("path", "content").mapInPandas(run, "path string, text string, reason string")
