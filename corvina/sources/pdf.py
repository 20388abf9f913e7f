"""PDF files as text: objects, content streams and outlines, as far as unencrypted files of simple fonts go.

A page becomes lines of text with their place and font size; the layout operators work
on such lines. A file that can't be read gives nothing, and ingestion says so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9]*\*?|\(|\S")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name such as ``/Type``."""


class Op(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass(frozen=True)
class Line:
    """A line of a page: y from the page's foot, left end, largest font size."""

    page: int
    x: float
    y: float
    size: float
    text: str


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its opening bracket."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(m.group(), 8) & 255)
                at += 1 + len(m.group())
                continue
            out += _ESCAPE.get(n, b"" if n in (b"\n", b"\r") else n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def _items(data: bytes, at: int = 0) -> Iterator[object]:
    """Values and operators of a piece of PDF syntax; arrays and dictionaries are built whole."""
    stack: list[list[object]] = []
    while m := _TOKEN.search(data, at):
        at, t = m.end(), m.group()
        if t[:1] == b"%":
            continue
        value: object
        if t in (b"[", b"<<"):
            stack.append([t])
            continue
        if t in (b"]", b">>"):
            if not stack:
                continue
            got = stack.pop()
            value = got[1:] if got[0] == b"[" else {str(k): v for k, v in zip(got[1::2], got[2::2], strict=False) if isinstance(k, Name)}
        elif t == b"(":
            value, at = _string(data, at)
        elif t[:1] == b"<":
            h = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif t[:1] == b"/":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x.group(1), 16)), t[1:].decode("latin-1")))
        elif re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        else:
            into = stack[-1] if stack else None
            if t == b"R" and into and len(into) > 2 and isinstance(into[-1], int) and isinstance(into[-2], int):
                value = Ref(into[-2])
                del into[-2:]
            else:
                value = {b"true": True, b"false": False, b"null": None}.get(t, Op(t.decode("latin-1")))
        if stack:
            stack[-1].append(value)
        else:
            yield value


class Document:
    """Objects of a file, found by scanning it, so that a damaged cross-reference table doesn't matter."""

    def __init__(self, data: bytes) -> None:
        self.raw: dict[int, tuple[bytes, bytes | None]] = {}
        found = list(_OBJECT.finditer(data))
        for m, nxt in zip(found, [*found[1:], None], strict=True):
            body = data[m.end() : nxt.start() if nxt else len(data)]
            head, mark, rest = body.partition(b"stream")
            inside = mark and head.rstrip().endswith(b">>")
            self.raw[int(m.group(1))] = (head, re.sub(rb"^\r?\n", b"", rest, count=1)) if inside else (body.partition(b"endobj")[0], None)
        self.seen: dict[int, object] = {}
        self.trailers = [d for m in re.finditer(rb"\btrailer\b", data) if isinstance(d := next(_items(data, m.end()), None), dict)]
        if any("Encrypt" in t for t in self.trailers):
            raise ValueError("encrypted")
        for number in list(self.raw):
            d = self.get(Ref(number))
            if isinstance(d, dict) and d.get("Type") == "XRef":
                self.trailers.append(d)
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                packed = self.stream(Ref(number))
                places = [x for x in _items(packed[: int(self.get(d["First"]))]) if isinstance(x, int)]
                for n, at in zip(places[::2], places[1::2], strict=False):
                    if n not in self.raw:
                        self.seen[n] = next(_items(packed, int(self.get(d["First"])) + at), None)

    def get(self, x: object) -> object:
        """``x`` with references followed."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.seen:
                head = self.raw.get(x.number, (b"", None))[0]
                got = list(_items(b"[" + head + b"]"))  # in an array, so that references are seen
                self.seen[x.number] = got[0][0] if got and isinstance(got[0], list) and got[0] else None
            x = self.seen[x.number]
        return None

    def stream(self, x: object) -> bytes:
        """A stream's bytes, unpacked."""
        if isinstance(x, list):
            return b"\n".join(self.stream(k) for k in x)
        if not isinstance(x, Ref) or x.number not in self.raw:
            inner = self.get(x)
            return self.stream(inner) if isinstance(inner, list) else b""
        d, data = self.get(x), self.raw[x.number][1]
        if isinstance(d, list):
            return self.stream(d)
        if data is None or not isinstance(d, dict):
            return b""
        size = self.get(d.get("Length"))
        data = data[:size] if isinstance(size, int) and 0 <= size <= len(data) else data.partition(b"endstream")[0]
        kinds = self.get(d.get("Filter")) or []
        for f in kinds if isinstance(kinds, list) else [kinds]:
            if self.get(f) == "FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif self.get(f) == "ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0]).decode())
            else:
                raise ValueError(f"streams of {f} aren't read")
        return data

    def root(self) -> dict:
        for t in reversed(self.trailers):
            if isinstance(r := self.get(t.get("Root")), dict):
                return r
        return next((d for n in self.raw if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"), {})

    def pages(self) -> list[tuple[int | None, dict]]:
        """(object number, page with what it inherits) in order."""
        out: list[tuple[int | None, dict]] = []
        todo: list[tuple[object, dict]] = [(self.root().get("Pages"), {})]
        seen: set[int] = set()
        while todo:
            x, above = todo.pop()
            d = self.get(x)
            if not isinstance(d, dict) or isinstance(x, Ref) and x.number in seen:
                continue
            if isinstance(x, Ref):
                seen.add(x.number)
            d = {k: v for k, v in above.items() if k in ("Resources", "MediaBox")} | d
            if "Kids" in d:
                todo.extend((k, d) for k in reversed(self.get(d["Kids"]) or []))
            else:
                out.append((x.number if isinstance(x, Ref) else None, d))
        return out


def _to_unicode(doc: Document, font: object) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code to text) from a font's ToUnicode map, where it has one."""
    font = doc.get(font)
    if not isinstance(font, dict) or "ToUnicode" not in font:
        return (2 if isinstance(font, dict) and font.get("Subtype") == "Type0" else 1), {}
    text, out, width = doc.stream(font["ToUnicode"]), {}, 1
    number = lambda b: int.from_bytes(b, "big")
    spelt = lambda b: b.decode("utf-16-be", "replace")
    for m in re.finditer(rb"begin(bfchar|bfrange|codespacerange)(.*?)end\1", text, re.S):
        v = list(_items(m.group(2)))
        if m.group(1) == b"codespacerange":
            width = max([width, *(len(x) for x in v if isinstance(x, bytes))])
        elif m.group(1) == b"bfchar":
            out |= {number(a): spelt(b) for a, b in zip(v[::2], v[1::2], strict=False) if isinstance(b, bytes)}
        else:
            for a, b, c in zip(v[::3], v[1::3], v[2::3], strict=False):
                for k in range(number(b) - number(a) + 1):
                    if isinstance(c, list):
                        out[number(a) + k] = spelt(c[k]) if k < len(c) else ""
                    else:
                        out[number(a) + k] = spelt(c[:-2] + (number(c[-2:]) + k).to_bytes(2, "big"))
    return width, out


def _times(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_lines(doc: Document, page: dict, number: int) -> list[Line]:
    """The page's text, pieces of one height joined from left to right; a gap of a third of the font size is a blank."""
    fonts = {k: _to_unicode(doc, v) for k, v in (doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}).items()}
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, lm, size, lead, font = one, [], one, one, 1.0, 0.0, (1, {})
    pieces: list[tuple[float, float, float, float, str]] = []
    args: list[object] = []

    def show(raw: bytes) -> None:
        nonlocal tm
        width, codes = font
        units = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
        text = "".join(codes.get(u, chr(u) if width == 1 and u >= 32 else "") for u in units) if codes or width > 1 else raw.decode("cp1252", "replace")
        m = _times(tm, ctm)
        wide = 0.5 * len(text)  # half the size a letter: metrics of the fonts aren't needed to part words
        scale = abs(m[3]) or abs(m[1]) or 1.0
        if text:
            pieces.append((m[5], m[4], m[4] + wide * size * scale, size * scale, text))
        tm = _times((1, 0, 0, 1, wide * size, 0), tm)

    for x in _items(doc.stream(page.get("Contents"))):
        if not isinstance(x, Op):
            args.append(x)
            continue
        f = [float(a) for a in args if isinstance(a, int | float)]
        if x == "q":
            saved.append(ctm)
        elif x == "Q" and saved:
            ctm = saved.pop()
        elif x == "cm" and len(f) == 6:
            ctm = _times(tuple(f), ctm)
        elif x == "BT":
            tm = lm = one
        elif x == "Tf" and len(args) > 1:
            font, size = fonts.get(str(args[0]), (1, {})), f[-1]
        elif x == "TL" and f:
            lead = f[0]
        elif x in ("Td", "TD") and len(f) == 2:
            lead = -f[1] if x == "TD" else lead
            tm = lm = _times((1, 0, 0, 1, *f), lm)
        elif x == "Tm" and len(f) == 6:
            tm = lm = tuple(f)
        elif x in ("T*", "'", '"'):
            tm = lm = _times((1, 0, 0, 1, 0, -lead), lm)
        if x in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif x == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, int | float):
                    if part < -180 and pieces:
                        y, a, b, s, t = pieces[-1]
                        pieces[-1] = (y, a, b, s, t + " ")
                    tm = _times((1, 0, 0, 1, -part / 1000 * size, 0), tm)
        args = []
    out: list[Line] = []
    row: list[tuple[float, float, float, float, str]] = []

    def close() -> None:
        if not row:
            return
        text, edge = "", None
        for _, a, b, s, t in sorted(row, key=lambda p: p[1]):
            text += (" " if edge is not None and a - edge > s / 3 and not text.endswith(" ") else "") + t
            edge = b
        if text.strip():
            out.append(Line(number, min(p[1] for p in row), row[0][0], max(p[3] for p in row), re.sub(r"\s+", " ", text).strip()))
        row.clear()

    for p in sorted(pieces, key=lambda p: -p[0]):
        if row and row[0][0] - p[0] > 0.4 * max(row[0][3], p[3]):
            close()
        row.append(p)
    close()
    return out


def _title(raw: object) -> str:
    if not isinstance(raw, bytes):
        return ""
    return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")).strip()


def outline(doc: Document) -> list[tuple[int, str, int, float]]:
    """(level, title, page number from 1, y) of the bookmarks, in order; those without a place in the file are left out."""
    numbers = {n: i for i, (n, _) in enumerate(doc.pages(), 1)}
    out, todo, seen = [], [((doc.get(doc.root().get("Outlines")) or {}).get("First"), 0)], set()
    while todo:
        x, level = todo.pop()
        d = doc.get(x)
        if not isinstance(d, dict) or isinstance(x, Ref) and x.number in seen:
            continue
        if isinstance(x, Ref):
            seen.add(x.number)
        todo.append((d.get("Next"), level))
        todo.append((d.get("First"), level + 1))
        dest = doc.get(d.get("Dest")) or doc.get((doc.get(d.get("A")) or {}).get("D"))
        if isinstance(dest, list) and dest and isinstance(dest[0], Ref) and dest[0].number in numbers:
            y = next((float(v) for v in dest[3:4] if isinstance(v, int | float)), 1e9)
            out.append((level, _title(doc.get(d.get("Title"))), numbers[dest[0].number], y))
    return out


def read_pdf(content: bytes) -> tuple[list[Line], list[tuple[int, str, int, float]]]:
    """(lines, outline) of a file; nothing for one that can't be read."""
    try:
        doc = Document(content)
        lines = [x for i, (_, p) in enumerate(doc.pages(), 1) for x in page_lines(doc, p, i)]
        return lines, outline(doc)
    except Exception:  # noqa: BLE001 - whatever is wrong with one file, the others are read
        return [], []


_READ = "struct<lines:array<struct<page:int,x:double,y:double,size:double,text:string>>,outline:array<struct<level:int,title:string,page:int,y:double>>>"


def pdf_text(c: Column) -> Column:
    """A struct of a file's lines, in reading order, and its outline."""

    @F.pandas_udf(_READ)
    def read(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in rows:
            got = [read_pdf(bytes(b or b"")) for b in s]
            yield pd.DataFrame({
                "lines": [[{"page": x.page, "x": x.x, "y": x.y, "size": x.size, "text": x.text} for x in a] for a, _ in got],
                "outline": [[{"level": v, "title": t, "page": p, "y": y} for v, t, p, y in b] for _, b in got],
            })

    return read(c)


def pdf_columns(files: DataFrame) -> DataFrame:
    """(id, pdf_markdown, pdf_pages) of files (id, content): by the outline where there is one, else by font sizes; pages are plain text."""
    got = files.select("id", pdf_text(F.col("content")).alias("r")).select("id", "r.lines", "r.outline")
    lines = got.select(F.col("id").alias("doc_id"), F.posexplode("lines").alias("line_no", "l")).select("doc_id", "line_no", "l.*")
    # a line belongs to the last bookmark at or above it
    after = lambda x: F.filter("outline", lambda o: (o["page"] < x["page"]) | ((o["page"] == x["page"]) & (o["y"] >= x["y"])))
    placed = got.filter(F.size("outline") > 0).select("id", "outline", F.explode("lines").alias("l")).withColumn("section_no", F.size(after(F.col("l"))))
    body = placed.groupBy("id", "section_no").agg(F.collect_list(F.struct("l.page", (-F.col("l.y")).alias("down"), "l.text")).alias("x"))
    body = body.select("id", "section_no", F.array_join(F.transform(F.array_sort("x"), lambda v: v["text"]), "\n").alias("body"))
    heads = got.select("id", F.posexplode("outline").alias("i", "o")).select("id", (F.col("i") + 1).alias("section_no"), "o.level", "o.title")
    sections = heads.join(body, ["id", "section_no"], "left").select(F.col("id").alias("doc_id"), "section_no", "level", "title", F.coalesce("body", F.lit("")).alias("body"))
    by_outline = layout.outline_markdown(sections).select(F.col("doc_id").alias("id"), F.col("markdown").alias("__outline"))
    sized = lines.select("doc_id", "line_no", "text", F.col("size").alias("font_size"), F.lit(False).alias("starts_paragraph"))
    by_font = layout.font_markdown(sized).select(F.col("doc_id").alias("id"), F.col("markdown").alias("__font"))
    pages = lines.groupBy(F.col("doc_id").alias("id"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda v: v["text"]), "\n").alias("t"))
    pages = pages.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda v: v["t"]).alias("pdf_pages"))
    out = files.select("id").join(by_outline, "id", "left").join(by_font, "id", "left").join(pages, "id", "left")
    return out.select("id", F.coalesce("__outline", "__font", F.lit("")).alias("pdf_markdown"), F.coalesce("pdf_pages", F.array().cast("array<string>")).alias("pdf_pages"))
