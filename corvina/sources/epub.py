"""EPUB books to markdown: container, package, spine, chapters."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import html_to_markdown, html_to_text


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def opf_path(z: zipfile.ZipFile) -> str | None:
    root = ET.fromstring(z.read("META-INF/container.xml"))
    return next((e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile" and e.get("full-path")), None)


def spine(z: zipfile.ZipFile, opf: str) -> list[str]:
    """hrefs of the manifest in reading order; non-linear parts count too."""
    root = ET.fromstring(z.read(opf))
    href = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
    return [h for e in root.iter() if _local(e.tag) == "itemref" and (h := href.get(e.get("idref")))]


def chapters(content: bytes) -> list[str]:
    """The markup of the spine's chapters in order; a damaged book gives none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            opf = opf_path(z)
            if not opf:
                return []
            names, parts = set(z.namelist()), []
            for href in spine(z, opf):
                at = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
                name = at if at in names else href
                if name in names:
                    parts.append(z.read(name).decode("utf-8", "replace"))
            return parts
    except Exception:  # noqa: BLE001 - whatever is wrong with one book, the others are read
        return []


def read_epub(content: bytes) -> str:
    """Markdown of all chapters with a blank line between."""
    return "\n\n".join(md for c in chapters(content) if (md := html_to_markdown(c)).strip())


def epub_chapters(c: Column) -> Column:
    """The plain text of each chapter."""

    @F.pandas_udf("array<string>")
    def read(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda b: [html_to_text(x) for x in chapters(bytes(b))] if b is not None else [])

    return read(c)


def epub_markdown(c: Column) -> Column:
    @F.pandas_udf("string")
    def read(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda b: read_epub(bytes(b)) if b is not None else "")

    return read(c)
