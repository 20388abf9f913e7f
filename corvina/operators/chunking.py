"""Chunkers. Documents are rows, so one document never leaves its row: segments are arrays
built by higher-order functions, and only token splitting and embedding need Python."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..schema import VARIANTS, Boundary, Options, Semantic

STRINGS = "array<string>"
_TOKENS = re.compile(r"\s*(?:\w+|[^\w\s])")


def strategy(document: DataFrame, domain: DataFrame, options: Options = Options()) -> DataFrame:
    """Each document with its effective strategy and variant: its own, else its domain's, else the default."""
    d = domain.select(F.col("id").alias("domain_id"), F.col("chunk_strategy").alias("__s"), F.col("structural_variant").alias("__v"))
    return (
        document.join(d, "domain_id", "left")
        .withColumn("chunk_strategy", F.coalesce("chunk_strategy", "__s", F.lit(options.chunk_strategy)))
        .withColumn("structural_variant", F.coalesce("structural_variant", "__v", F.lit("GENERIC")))
        .drop("__s", "__v")
    )


# headings

_HEADING = r"^(#{1,6}) (.+)$"


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    n = F.length(F.regexp_extract(F.rtrim(line), _HEADING, 1))
    return F.when(n > 0, n)


def heading_title(line: Column) -> Column:
    return F.lower(tx.trim_ws(F.regexp_extract(F.rtrim(line), _HEADING, 2)))


def is_excluded(title: Column, excluded: tuple[str, ...]) -> Column:
    """The title is an excluded one, or begins with it and a blank."""
    out = F.lit(False)
    for e in excluded:
        out = out | (title == e) | title.startswith(e + " ")
    return out


def _segments(lines: Column, starts: Callable[[Column], Column]) -> Column:
    """Group an array of lines: one that ``starts`` holds for begins a segment. Joined, trimmed, blank ones dropped."""
    def cut(x: Column) -> Column:
        n = F.size(x)
        at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | starts(F.get(x, i - 1)))
        parts = _between(at, n + 1, lambda a, b: tx.trim_ws(F.array_join(F.slice(x, a, b - a), "\n")))
        return F.filter(parts, lambda s: s != "")

    return tx.let(lines, cut)


def _between(at: Column, end: Column, piece: Callable[[Column, Column], Column]) -> Column:
    """``piece(a, b)`` for each start and the next one, the last up to ``end``."""
    return tx.let(at, lambda s: F.zip_with(s, F.array_append(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), end), piece))


def split_at_level(markdown: Column, level: Column | int, excluded: tuple[str, ...] = ()) -> Column:
    """Segments of a markdown text at headings of ``level`` or above, unless excluded."""
    lv = F.lit(level) if isinstance(level, int) else level
    return _segments(tx.lines(markdown), lambda x: F.coalesce((heading_level(x) <= lv) & ~is_excluded(heading_title(x), excluded), F.lit(False)))


def split_level(markdown: Column, preferred: int = 2, excluded: tuple[str, ...] = ()) -> Column:
    """One above the first excluded heading below level 1, else the preferred level."""
    if not excluded:
        return F.lit(preferred)
    found = F.filter(tx.lines(markdown), lambda x: F.coalesce((heading_level(x) > 1) & is_excluded(heading_title(x), excluded), F.lit(False)))
    return F.coalesce(heading_level(F.get(found, F.lit(0))) - 1, F.lit(preferred))


def split_headings(df: DataFrame, markdown: str = "markdown", preferred: int = 2, min_chars: int = 200, excluded: tuple[str, ...] = (), out: str = "chunks") -> DataFrame:
    """``df`` with an array of heading-bounded chunks; with under three, a neighbouring level that gives more is taken."""
    m = F.col(markdown)
    df = df.withColumn("__level", split_level(m, preferred, excluded)).withColumn("__0", split_at_level(m, F.col("__level"), excluded))
    pick = F.col("__0")
    tries = []
    for step in (-1, 1, 2):
        level = F.col("__level") + step
        name = f"__{step}"
        df = df.withColumn(name, F.when((F.size("__0") < 3) & level.between(1, 5), split_at_level(m, level, excluded)))
        tries.append(F.when(F.size(name) > F.size("__0"), F.col(name)))
    df = df.withColumn("__pick", F.when(F.size("__0") < 3, F.coalesce(*tries, pick)).otherwise(pick))
    blank = F.coalesce(tx.trim_ws(m), F.lit("")) == ""
    chunks = F.when(blank, F.array().cast(STRINGS)).otherwise(tx.merge_short(F.col("__pick"), min_chars))
    return df.withColumn(out, chunks).drop("__level", "__0", "__-1", "__1", "__2", "__pick")


# line heuristics


def heuristic_segments(page: Column, b: Boundary) -> Column:
    """Segments of one page of plain text, begun at lines that look like headings in their context."""
    opts = {"max_title": b.max_title, "numbered": b.numbered, "excluded": b.excluded}

    def cut(x: Column) -> Column:
        def starts(i: Column) -> Column:
            here = tx.trim_ws(F.get(x, i))
            # a trimmed page begins with its first content, which needs no context
            return F.when(i == 0, tx.could_be_heading(here, **opts)).otherwise(tx.heading_in_context(here, F.get(x, i - 1), **opts))

        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), lambda i: (i == 0) | starts(i))
        return F.filter(_between(at, F.size(x), lambda a, e: tx.trim_ws(F.array_join(F.slice(x, a + 1, e - a), "\n"))), lambda s: s != "")

    return tx.let(tx.lines(tx.trim_ws(page)), cut)


def split_heuristic(df: DataFrame, pages: str = "pages", boundary: Boundary = Boundary(), out: str = "chunks") -> DataFrame:
    """Segments of all pages in order, short ones merged."""
    flat = F.flatten(F.transform(F.coalesce(F.col(pages), F.array().cast(STRINGS)), lambda p: heuristic_segments(F.coalesce(p, F.lit("")), boundary)))
    df = df.withColumn("__flat", flat)
    return df.withColumn(out, F.filter(tx.merge_short(F.col("__flat"), boundary.min_chars), lambda s: tx.trim_ws(s) != "")).drop("__flat")


# tokens and overlap


Spans = Callable[[str], list[tuple[int, int]]]
Ends = Callable[[str], list[int]]


def regex_spans(text: str) -> list[tuple[int, int]]:
    """The offline default: words and signs, each with the white space before it."""
    return [m.span() for m in _TOKENS.finditer(text)]


@lru_cache(maxsize=4)
def vocabulary_spans(path: str) -> Spans:
    """Character spans of a byte-pair vocabulary's tokens, from a ``tokenizers`` file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    # tokens inside one character all end with it
    return lambda text: t.encode(text, add_special_tokens=False).offsets


#: Before a lone blank or line feed between signs that nobody counts as white space: there the byte-level word pattern parts, whatever surrounds it.
_CUT = re.compile(r"(?<=[!-~\w])(?=[ \n][!-~\w])")
#: Words of which a worker remembers the tokens; twice as many for a while.
REMEMBERED = 1 << 17


@lru_cache(maxsize=4)
def vocabulary_ends(path: str) -> Ends:
    """Where a vocabulary's tokens end, in characters: as ``vocabulary_spans``, but a byte-level vocabulary's follow from the tokens' bytes, and words that were seen lately aren't encoded again."""
    from tokenizers import Tokenizer

    spans = vocabulary_spans(path)
    by_library = lambda text: [b for _, b in spans(text)]
    t = Tokenizer.from_file(path)
    d = json.loads(t.to_str())
    level, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = not any(d.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and all(a["special"] for a in d.get("added_tokens") or [])
    by_bytes = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not (plain and by_bytes and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and hasattr(t, "encode_batch_fast")):
        return by_library
    t.encode_special_tokens = True
    size = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # a byte is a sign of the token's string
    for w, i in model["vocab"].items():
        size[i] = len(w)
    if size.max() > 255:
        return by_library
    size = size.astype(np.uint8)
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def sizes(text: str) -> bytes:
        return size[t.encode_batch_fast([text], add_special_tokens=False)[0].ids].tobytes() if text else b""

    def learn(words: list[str]) -> None:
        """Encode words that begin with a blank or line feed in one go, as they part in any company."""
        found = sizes("".join(words))
        stops = np.cumsum([len(w.encode()) for w in words])
        at = 0
        for w, to in zip(words, np.searchsorted(np.cumsum(np.frombuffer(found, np.uint8), dtype=np.int64), stops).tolist(), strict=True):
            known[w] = found[at : to + 1]
            at = to + 1

    def ends(text: str) -> list[int]:
        nonlocal known, before
        words = _CUT.split(text)
        if len(words) < 3:
            parts = [sizes(text)]
        else:
            if len(known) > REMEMBERED:
                known, before = {}, known
            inner = words[1:-1]  # the outer ones may have white space at the text's ends
            found = list(map(known.get, inner))
            if None in found:
                missing = dict.fromkeys(w for w, x in zip(inner, found, strict=True) if x is None)
                known.update((w, before[w]) for w in missing if w in before)
                learn([w for w in missing if w not in known])
                found = list(map(known.get, inner))
            parts = [sizes(words[0]), *found, sizes(words[-1])]
        data = np.frombuffer(text.encode(), np.uint8)
        stop = np.cumsum(np.frombuffer(b"".join(parts), np.uint8), dtype=np.int64)
        if not len(stop) or stop[-1] != len(data):
            return by_library(text)
        return (stop if len(data) == len(text) else np.cumsum((data & 0xC0) != 0x80)[stop - 1]).tolist()

    return ends


def token_split(text: str | None, size: int = 600, min_chars: int = 350, min_keep: int = 5, most: int | None = None, spans: Spans = regex_spans, ends_of: Ends | None = None) -> list[str]:
    """Chunks of at most ``size`` tokens, cut back to the last sentence end beyond ``min_chars``; crumbs are dropped.

    The text is tokenised once, by ``spans`` or, where only the ends are given, ``ends_of``; a chunk begins at the token in which the one before
    ended. Goes on until the text ends, unless ``most`` is given: what is left after so
    many chunks is then one more, of any length.
    """
    text = text or ""
    end, at, k = len(text.rstrip()), 0, 0
    ends = ends_of(text) if ends_of else [b for _, b in spans(text)]
    out: list[str] = []
    while at < end and k < len(ends):
        if most is not None and len(out) >= most:
            if len(text[at:].strip()) > min_keep:
                out.append(text[at:].strip())
            break
        piece = text[at : ends[min(k + size, len(ends)) - 1]]
        if len(piece) < end - at:
            stop = max(piece.rfind(s) for s in ".?!\n")
            if stop > min_chars:
                piece = piece[: stop + 1]
        if len(piece.strip()) > min_keep:
            out.append(piece.strip())
        at += len(piece)
        k = bisect_right(ends, at, k)
    return out


def token_chunks(c: Column, size: int = 600, vocabulary: str | None = None) -> Column:
    """``token_split`` of a column, by a vocabulary file's tokens where one is given. A text that is a crumb as a whole stays."""

    @F.pandas_udf(STRINGS)
    def split(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ends_of = vocabulary_ends(vocabulary) if vocabulary else None
        for s in rows:
            yield s.map(lambda t: token_split(t, size, ends_of=ends_of) or [x for x in [(t or "").strip()] if x])

    return split.asNondeterministic()(c)


def overlap(chunks: Column, n: int = 200) -> Column:
    """Each chunk but the first led by the tail of the original chunk before it."""
    if n <= 0:
        return chunks

    def led(all_: Column, x: Column, i: Column) -> Column:
        joined = lambda tail: F.when((i == 0) | (tail == ""), x).otherwise(F.concat(tail, F.lit(" "), x))
        return tx.let(F.coalesce(tx.trailing_context(F.get(all_, i - 1), n), F.lit("")), joined)

    return tx.let(chunks, lambda all_: F.transform(all_, lambda x, i: led(all_, x, i)))


def _tail(previous: str, n: int) -> str:
    w = previous.strip()
    if len(w) <= n:
        return w
    w = w[-n:]
    stop = re.search(r"[.?!\n]", w)
    return w[stop.end() :].strip() if stop and stop.end() < len(w) else w


def _once(name: str) -> Column:
    """The column, referred to twice so that the optimizer keeps its projection apart: Python's input then holds no lambda."""
    return F.when(F.col(name).isNotNull(), F.col(name))


def cap_structural(chunks: Column, max_chars: int = 4000, size: int = 600, n: int = 200) -> Column:
    """Chunks over ``max_chars`` split by tokens with overlap; every piece keeps the heading line."""

    def capped(chunk: str) -> list[str]:
        if len(chunk) <= max_chars:
            return [chunk]
        first = next((x for x in chunk.split("\n") if x.strip()), "")
        heading = first if first.startswith("#") else ""
        parts = token_split(chunk.removeprefix(first).lstrip("\n ") if heading else chunk, size)
        led = [p if i == 0 or not (t := _tail(parts[i - 1], n)) else f"{t} {p}" for i, p in enumerate(parts)]
        return [f"{heading}\n\n{p}" for p in led] if heading else led

    @F.pandas_udf(STRINGS)
    def cap(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda a: [y for x in a for y in capped(x)] if a is not None else None)

    return cap.asNondeterministic()(chunks)  # so that no copy of it lands in a filter


def cap_semantic(chunks: Column, max_chars: int = 4000, size: int = 600) -> Column:
    """The same cap without overlap or heading."""

    @F.pandas_udf(STRINGS)
    def cap(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda a: [y for x in a for y in ([x] if len(x) <= max_chars else token_split(x, size))] if a is not None else None)

    return cap.asNondeterministic()(chunks)  # so that no copy of it lands in a filter


def split_structural(df: DataFrame, variant: str = "GENERIC", markdown: str = "markdown", pages: str = "pages", out: str = "chunks") -> DataFrame:
    """By headings where they give three chunks or more, else by line heuristics; then capped."""
    b = VARIANTS[variant]
    df = split_headings(df, markdown, b.level, b.min_chars, b.excluded, "__md")
    df = split_heuristic(df, pages, b, "__lines")
    picked = F.when(F.size("__md") >= 3, F.col("__md")).otherwise(F.col("__lines"))
    df = df.withColumn("__pre", picked).drop("__md", "__lines")
    return df.withColumn(out, cap_structural(_once("__pre"), b.max_chars)).drop("__pre")


# meaning


@lru_cache(maxsize=1 << 16)
def _slot(word: str, dim: int) -> tuple[int, float]:
    """Where a word counts in a hashed vector, and as what."""
    h = zlib.crc32(word.encode())
    return h % dim, 1.0 if h >> 16 & 1 else -1.0


def hashing_embedder(dim: int = 64) -> Callable[[str], list[float]]:
    """The offline default: signed hashed words, scaled to length one. A text without words gets zeros."""

    def embed(text: str) -> list[float]:
        v = [0.0] * dim
        for w in re.findall(r"\w+", (text or "").lower()):
            i, x = _slot(w, dim)
            v[i] += x
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    return embed


def embed_column(c: Column, embed: Callable[[str], list[float]] | None = None) -> Column:
    f = embed or hashing_embedder()

    @F.pandas_udf("array<float>")
    def embedded(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(f)

    return embedded(c)


def windows(paragraphs: Column, w: int) -> Column:
    """Each paragraph joined with up to ``w`` on either side."""
    return tx.let(paragraphs, lambda p: F.transform(p, lambda _, i: F.array_join(F.slice(p, F.greatest(i - w, F.lit(0)) + 1, F.least(i, F.lit(w)) + 1 + w), " ")))


def distances(embeddings: Column) -> Column:
    """Cosine distance of each neighbouring pair, products in single precision."""
    n = F.size(embeddings)
    at = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.lit(1.0) - vectors.cosine_similarity(F.get(embeddings, i), F.get(embeddings, i + 1), "float"))


def group_at_breaks(paragraphs: Column, gaps: Column, threshold: Column) -> Column:
    """Paragraphs joined by blank lines; a segment ends after each gap above the threshold."""
    def cut(p: Column, g: Column) -> Column:
        n = F.size(p)
        at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | F.coalesce(F.get(g, i - 2) > threshold, F.lit(False)))
        return _between(at, n + 1, lambda a, b: F.array_join(F.slice(p, a, b - a), "\n\n"))

    return tx.let(paragraphs, lambda p: tx.let(gaps, lambda g: cut(p, g)))


def split_semantic(df: DataFrame, key: str, text: str = "markdown", embed: Callable[[str], list[float]] | None = None, config: Semantic = Semantic(), out: str = "chunks") -> DataFrame:
    """``df`` with chunks that end where neighbouring windows of paragraphs differ most.

    Windows are exploded for embedding, so a long document's are spread over Arrow
    batches; they return to their row by ``key``, which must be unique.
    """
    df = df.withColumn("__p", tx.paragraphs(F.coalesce(F.col(text), F.lit(""))))
    long_ = df.filter(F.size("__p") >= 3).select(key, F.posexplode_outer(windows(F.col("__p"), config.window)).alias("i", "w")).filter(F.col("i").isNotNull())
    emb = long_.select(key, "i", embed_column(F.col("w"), embed).alias("e"))
    seq = Window.partitionBy(key).orderBy("i")
    # a norm a window, and one product a pair: a filter on the distances would have all of it computed twice
    pair = emb.withColumn("s", vectors.norm(F.col("e"), "float")).select(key, "i", "e", "s", F.lead(F.struct("e", "s")).over(seq).alias("n"))
    gap = pair.select(key, F.when(F.col("n").isNotNull(), F.struct("i", (F.lit(1.0) - vectors.cosine_of(F.col("e"), F.col("n.e"), F.col("s") * F.col("n.s"), "float")).alias("d"))).alias("g"))
    per = gap.groupBy(key).agg(F.array_sort(F.collect_list("g")).alias("__g")).select(key, F.transform("__g", lambda x: x["d"]).alias("__d"))
    df = df.join(per, key, "left").withColumn("__t", vectors.nearest_rank(F.col("__d"), config.percentile))
    grouped = tx.merge_short(group_at_breaks(F.col("__p"), F.col("__d"), F.col("__t")), config.min_chars)
    whole = F.when(F.size("__p") == 0, F.array().cast(STRINGS)).otherwise(F.array(F.array_join("__p", "\n\n")))
    df = df.withColumn("__c", F.when(F.size("__p") < 3, whole).otherwise(grouped)).drop("__p", "__d", "__t")
    return df.withColumn(out, cap_semantic(_once("__c"), config.max_chars)).drop("__c")


def chunk_documents(df: DataFrame, options: Options = Options(), embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """Rows (id, chunk_strategy, structural_variant, markdown, pages) split by their own strategy, as (…, chunks)."""
    token = df.filter("chunk_strategy = 'TOKEN'").withColumn("chunks", overlap(token_chunks(F.array_join("pages", "\n"), options.chunk_tokens, options.vocabulary), options.overlap_chars))
    semantic = split_semantic(df.filter("chunk_strategy = 'SEMANTIC'"), "id", "markdown", embed, options.semantic)
    out = token.unionByName(semantic)
    for variant in VARIANTS:
        rows = df.filter((F.col("chunk_strategy") == "STRUCTURAL") & (F.coalesce("structural_variant", F.lit("GENERIC")) == variant))
        out = out.unionByName(split_structural(rows, variant))
    return out


def to_chunk_rows(df: DataFrame, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """One row per chunk, with a deterministic id, an embedding and lexemes: what a chunk table stores."""
    from ..functions.analysis import to_lexemes

    rows = df.select("id", "domain_id", "tags", "chunk_strategy", F.posexplode_outer("chunks").alias("chunk_index", "content")).filter(F.col("chunk_index").isNotNull())
    return rows.select(
        F.sha2(F.concat_ws("\u0001", "id", "chunk_index"), 256).alias("id"), F.col("id").alias("document_id"), "domain_id", F.col("tags").alias("tag_paths"), "content",
        embed_column(F.col("content"), embed).alias("embedding"), "chunk_index", "chunk_strategy", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("token_count"),
        F.current_timestamp().alias("created_at"), to_lexemes(tx.strip_markdown(F.col("content"))).alias("lexemes"),
    )
