"""Uploaded files: suffix rules, ZIP wrappers, EPUBs inside folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Unsupported

EPUB_TYPE = "application/epub+zip"
KINDS = {"epub": "EPUB", "pdf": "PDF"}


def _suffix(name: str) -> str:
    return name.rpartition(".")[2].strip().lower() if "." in name else ""


def _junk(name: str) -> bool:
    return name.startswith("__MACOSX/") or name.rpartition("/")[2].startswith("._")


def epub_prefix(content: bytes) -> str | None:
    """Folder (with a slash, or empty) of the first ``mimetype`` entry that says EPUB; null for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if name == "mimetype" or name.endswith("/mimetype"):
                    return name[: -len("mimetype")] if z.read(name).decode("utf-8", "replace").strip() == EPUB_TYPE else None
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
    return None


def reroot(content: bytes, prefix: str) -> bytes:
    """The archive with ``prefix`` off its names; folders, entries outside it and resource forks go."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for i in z.infolist():
            if not i.is_dir() and i.filename.startswith(prefix) and not _junk(i.filename) and i.filename != prefix:
                to.writestr(i.filename[len(prefix) :], z.read(i))
    return out.getvalue()


def single_wrapped(content: bytes) -> tuple[str, bytes] | None:
    """(suffix, bytes) where exactly one real entry is left and it is a book or a PDF."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            real = [i for i in z.infolist() if not i.is_dir() and not _junk(i.filename)]
            if len(real) == 1 and _suffix(real[0].filename) in KINDS:
                return _suffix(real[0].filename), z.read(real[0])
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
    return None


def resolve(suffix: str, content: bytes, filename: str) -> tuple[str, str, bytes]:
    """(type, suffix, bytes) of an upload; other kinds raise ``Unsupported``."""
    if suffix in KINDS:
        return KINDS[suffix], suffix, content
    if suffix == "zip":
        prefix = epub_prefix(content)
        if prefix is not None:
            return "EPUB", "epub", reroot(content, prefix) if prefix else content
        inner = single_wrapped(content)
        if inner:
            return KINDS[inner[0]], *inner
    raise Unsupported(f"{filename}: files of kind {suffix or 'none'} aren't read")


def resolve_uploads(files: DataFrame, strict: bool = False) -> DataFrame:
    """``files`` (path, content) with source_type, suffix, content and, in place of an exception, ``error``."""

    @F.pandas_udf("struct<source_type:string,suffix:string,content:binary,error:string>")
    def resolved(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in rows:
            out = []
            for n, c in zip(names, contents, strict=True):
                name = n.rpartition("/")[2]
                try:
                    out.append((*resolve(_suffix(name), bytes(c or b""), name), None))
                except Unsupported as e:
                    out.append((None, _suffix(name), None, str(e)))
            yield pd.DataFrame(out, columns=["source_type", "suffix", "content", "error"])

    r = files.withColumn("__r", resolved("path", "content"))
    error = F.when(F.col("__r.error").isNotNull(), F.raise_error(F.col("__r.error")).cast("string")) if strict else F.col("__r.error")
    return r.select(*[c for c in files.columns if c != "content"], "__r.source_type", "__r.suffix", "__r.content", error.alias("error"))


def read_files(spark, path: str) -> DataFrame:
    """(path, content) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def serve(document: DataFrame, files: DataFrame, document_id: str) -> DataFrame:
    """The stored file of a document, with its media type; no row where either is missing."""
    d = document.filter(F.col("id") == document_id).select(F.col("source_path").alias("path"), "source_type")
    media = F.when(F.col("source_type") == "PDF", "application/pdf").otherwise(EPUB_TYPE)
    return files.join(F.broadcast(d), "path").select("path", "content", media.alias("media_type"))  # one row
