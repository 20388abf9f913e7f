"""Small books and PDF files, written to be read back."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .archive import EPUB_TYPE


def zipped(entries: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return b.getvalue()


def book(title: str) -> dict[str, str | bytes]:
    """The entries of a book of one chapter."""
    t = html.escape(title)
    return {
        "mimetype": EPUB_TYPE,
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>',
        "OPS/b.opf": '<package><manifest><item id="a" href="text/a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
        "OPS/text/a.xhtml": f"<html><head><title>t</title></head><body><h1>{t}</h1><p>Body of {t}.</p></body></html>",
    }


def paper(title: str) -> bytes:
    """A PDF file of one page and two lines, with no cross-reference table."""
    t = title.replace("\\", "").replace("(", "").replace(")", "")
    body = f"BT /F1 20 Tf 50 700 Td ({t}) Tj /F1 10 Tf 0 -40 Td (Body of {t}.) Tj ET".encode("cp1252", "replace")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n"


def made(kind: int, title: str) -> bytes:
    """0 a book, 1 one in a folder of a ZIP with litter, 2 one alone in a ZIP, 3 a PDF, 4 something else."""
    if kind == 0:
        return zipped(book(title))
    if kind == 1:
        return zipped({f"My Book.epub/{k}": v for k, v in book(title).items()} | {"__MACOSX/._x": "litter"})
    if kind == 2:
        return zipped({"inner/b.epub": zipped(book(title)), "__MACOSX/._b.epub": "litter"})
    return paper(title) if kind == 3 else b"plain"


def upload(kind: Column, title: Column) -> Column:
    @F.pandas_udf("binary")
    def write(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, titles in rows:
            yield pd.Series([made(int(k), t) for k, t in zip(kinds, titles, strict=True)])

    return write(kind, title)
