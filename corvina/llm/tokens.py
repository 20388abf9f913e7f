"""Operator 7: exact token counts at every prefix of a text.

A byte-pair encoding has this property: the encoding of a string, less its last token,
is the encoding of what is left. So the encoding of every prefix follows from those of
shorter ones: its last token is the one token that ends there and is compatible with the
last token of the prefix before it. One pass stores, for each prefix, that token's
reference and the count; truncation and budget questions are then look-ups. The library
encodes nothing: it only tells how characters normalise and part.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import table

#: Bytes of pieces whose counts a worker remembers (with 5 bytes each), and text bytes handled at once.
REMEMBERED = 24_000_000
#: Pairs of tokens, and strings' normal forms, that a worker remembers.
PAIRS, FORMS = 1_000_000, 200_000
LONG_PIECE = 200
GROUP = 1 << 19

# 0 white space, 1 letter, 2 digit, 3 other sign, 4 a byte that makes its whole word a slow one
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[39, 60]] = 4  # contractions; the special strings begin with <
_KIND[128:192] = 1  # continuation bytes, judged by the lead byte before them
_KIND[[0xC3, 0xC4, 0xC5]] = 1  # Latin letters, but for the three that _hard() finds
_LOWER = {c: chr(c).lower().encode() for c in range(0xC0, 0x180) if chr(c).lower() != chr(c)}

_PRE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """Merges of a word-end byte-pair vocabulary, and whether two of its tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], j.get("pre_tokenizer") or {}
        pattern = next((x["pattern"].get("Regex") for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or pattern != _PRE or model.get("ignore_merges"):
            raise ValueError(f"{path}: only word-end byte-pair vocabularies with this word pattern can be counted by prefix")
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            end = token.endswith("</w>") and token != "</w>"
            spelt = bytes(to_byte[c] for c in (token[:-4] if end else token))
            (self.final if end else self.inner)[spelt] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[left, right] = r
            self.parts.setdefault(made, (r, left, right))
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # a token that its own spelling isn't encoded as never occurs
        self.inner, self.final = ({x: i for x, i in d.items() if self.stands_alone(i)} for d in (self.inner, self.final))
        self.specials = sorted((x["content"] for x in j["added_tokens"]), key=len, reverse=True)
        rules = Tokenizer.from_file(path)
        self.normaliser, self.parter = rules.normalizer, rules.pre_tokenizer
        self.norms: dict[str, str] = {}
        self.kinds: dict[str, str] = {}

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the encoding of both spellings together is just these two tokens.

        Merges are taken back, the latest first: were a merge across the seam possible
        before the one taken back, the encoder would have made it.
        """
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            got = self.fits[a, b] = self._seam_holds(a, b)
        return got

    def _seam_holds(self, a: int, b: int, before: float = float("inf")) -> bool:
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < before:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and pa_[0] > pb[0]:
                before, a = min(before, pa_[0]), pa_[2]
            else:
                before, b = min(before, pb[0] + 1), pb[1]

    def stands_alone(self, token: int) -> bool:
        """Whether the token's spelling is encoded as itself: its halves are, and nothing merges across their seam before them."""
        got = self.whole.get(token)
        if got is None:
            p = self.parts.get(token)
            got = self.whole[token] = p is None or self.stands_alone(p[1]) and self.stands_alone(p[2]) and self._seam_holds(p[1], p[2], p[0])
        return got

    def norm(self, chars: str) -> str:
        got = self.norms.get(chars)
        if got is None:
            if len(self.norms) >= FORMS:
                self.norms.clear()
            got = self.norms[chars] = self.normaliser.normalize_str(chars)
        return got

    def kind(self, c: str) -> str:
        """``L`` letter, ``N`` number, ``S`` sign, ``W`` white space, as the library's word pattern has it."""
        got = self.kinds.get(c)
        if got is None:
            n = len(self.parter.pre_tokenize_str(c + c))
            got = "W" if n == 0 else "N" if n == 2 else "L" if len(self.parter.pre_tokenize_str("a" + c)) == 1 else "S"
            self.kinds[c] = got
        return got


class PiecePrefix:
    """The dynamic programme over one piece: per inner prefix its last token and count; grows by bytes and can be cut back."""

    __slots__ = ("v", "piece", "last", "count")

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.piece, self.last, self.count = v, bytearray(), [-1], [0]

    def _ending(self, tokens: dict[bytes, int]) -> tuple[int, int]:
        """(last token, count) of the piece as it stands, with its last token from ``tokens``."""
        get, fits, end = tokens.get, self.v.fits, len(self.piece)
        at = max(0, end - self.v.longest)
        tail = bytes(self.piece[at:])
        for j in range(end - at):
            t = get(tail[j:])
            if t is not None:
                if not at + j:
                    return t, 1
                before = self.last[at + j]
                ok = fits.get((before, t))
                if self.v.side_by_side(before, t) if ok is None else ok:
                    return t, self.count[at + j] + 1
        raise ValueError(f"no encoding of {tail!r}")

    def push(self, data: bytes) -> None:
        for x in data:
            self.piece.append(x)
            t, n = self._ending(self.v.inner)
            self.last.append(t)
            self.count.append(n)

    def cut(self, size: int) -> None:
        del self.piece[size:], self.last[size + 1 :], self.count[size + 1 :]

    def total(self) -> int:
        """Tokens of the piece as it stands, its last byte ending a word."""
        return self._ending(self.v.final)[1] if self.piece else 0


def piece_counts(data: bytes, v: Vocabulary, held: PiecePrefix | None = None, totals: list[int] | None = None) -> list[int]:
    """Tokens of each prefix of one plain piece, a number per byte; inside a character that of the characters before.

    ``held`` and ``totals`` are another piece's programme and counts: what the two begin
    with in common isn't done again.
    """
    low = data.lower() if data.isascii() else b"".join(c.lower().encode() for c in data.decode())
    p, out, n, same = held or PiecePrefix(v), totals if totals is not None else [], len(low), 0
    for x, y in zip(p.piece, low, strict=False):
        if x != y:
            break
        same += 1
    while same and same < n and low[same] & 0xC0 == 0x80:  # common characters, not bytes
        same -= 1
    p.cut(same)
    del out[same:]
    for k in range(same, n):
        p.push(low[k : k + 1])
        inside = k + 1 < n and low[k + 1] & 0xC0 == 0x80
        out.append((out[-1] if out else 0) if inside else p.total())
    return out


class Running:
    """Counts of a growing string of normalised characters, with any number of steps back."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.base, self.kind, self.p = v, 0, "", PiecePrefix(v)
        self.steps: list[tuple[int, str, PiecePrefix, int]] = []

    def total(self) -> int:
        return self.base + self.p.total()

    def _begin(self, kind: str) -> None:
        self.base, self.kind, self.p = self.base + self.p.total(), kind, PiecePrefix(self.v)

    def push(self, c: str) -> None:
        self.steps.append((self.base, self.kind, self.p, len(self.p.piece)))
        kind = self.v.kind(c)
        if kind == "W":
            self._begin("")
            return
        tail = self.kind + c if self.kind[:1] == "'" else ""  # a piece begun by an apostrophe
        if tail in ("'s", "'t", "'m", "'d"):
            self.p.push(c.encode())
            self.kind = "C"
        elif tail in ("'l", "'r", "'v"):  # so far an apostrophe and a letter; with the next one perhaps a contraction
            self._begin(tail)
            self.p.push(c.encode())
        elif tail in ("'ll", "'re", "'ve"):
            base, _, p, size = self.steps[-2]
            self.base, self.kind, self.p = base, "C", PiecePrefix(self.v)
            self.p.push(bytes(p.piece[:size]) + tail[1:].encode())
        elif c == "'" and self.kind[:1] not in ("S", "'") or c == "'" and len(self.kind) == 2 and self.kind[0] == "'":
            self._begin("'")
            self.p.push(b"'")
        else:
            now = {"'": "S"}.get(self.kind, "L" if self.kind[:1] == "'" else self.kind)
            if kind == now and kind != "N":
                self.kind = now
            else:
                self._begin(kind)
            self.p.push(c.encode())

    def back(self, steps: int) -> None:
        for _ in range(steps):
            self.base, self.kind, self.p, size = self.steps.pop()
            self.p.cut(size)

    def special(self) -> None:
        """A special string's token: what comes before and after it is apart."""
        self._begin("")
        self.base += 1
        self.steps.clear()


def word_counts(data: bytes, v: Vocabulary) -> list[int]:
    """Tokens of each prefix of any word, a number per byte, whatever normalisation, contractions or special strings do."""
    word = data.decode("utf-8", "replace")
    out: list[int] = []
    run = Running(v)

    def note(c: str, n: int) -> None:
        size = len(c.encode())
        out.extend([out[-1] if out else 0] * (size - 1) + [n])

    def ordinary(text: str, record: bool) -> int:
        """Push the normal form of ``text``; the steps taken. A cluster of characters that normalise together is tried at each length."""
        taken, i = 0, 0
        while i < len(text):
            e = i + 1
            while e < len(text) and (unicodedata.combining(text[e]) or v.norm(text[max(i, e - 9) : e + 1]) != v.norm(text[max(i, e - 9) : e]) + v.norm(text[e])):
                e += 1
            for k in range(i + 1, e + 1) if record else [e]:
                cluster = v.norm(text[i:k]) if e - i < 10 else v.normaliser.normalize_str(text[i:k])
                for c in cluster:
                    run.push(c)
                if record:
                    note(text[k - 1], run.total())
                if k < e:
                    run.back(len(cluster))
                else:
                    taken += len(cluster)
            i = e
        return taken

    at = 0
    while at < len(word):
        found = min(((word.find(s, at), -len(s), s) for s in v.specials if s in word[at:]), default=None)
        stop = found[0] if found else len(word)
        ordinary(word[at:stop], True)
        if not found:
            break
        s = found[2]
        if len(s) > 1:  # cut short, it is ordinary text
            before = len(run.steps)
            ordinary(s[:-1], True)
            run.back(len(run.steps) - before)
        run.special()
        note(s[-1], run.total())
        at = stop + len(s)
    return out


def _hard(b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of bytes that rule the simple split out: unknown kinds, and the signs or the dotted I among C3 to C5."""
    bad = kind == 4
    lead = np.flatnonzero((b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)) | (b[:-1] == 0xC4) & (b[1:] == 0xB0))
    bad[lead] = True
    return np.flatnonzero(bad)


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and slowness of independently encoded pieces: letter runs, single digits, sign runs; slow words whole.

    White space always parts pieces. A word with an apostrophe, ``<``, a control
    character or a letter beyond Latin is slow: see ``word_counts``.
    """
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    hard = _hard(b, kind)
    if len(hard):
        s, e = bw.spans(data, bw.NOT_SPACE)
        w = bw.distinct(np.searchsorted(s, hard, "right") - 1)
        mark = np.zeros(len(b) + 1, np.int8)
        mark[s[w]] += 1
        mark[e[w]] -= 1
        kind = np.where(np.cumsum(mark[:-1]) > 0, np.uint8(5), kind)
    new = np.ones(len(b), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(b)]
    solid = kind[starts] != 0
    starts = starts[solid]
    return starts, ends[solid], kind[starts] == 5


class PrefixCounter:
    """Counts at every prefix of any text; what a piece has given once is kept, byte for byte, and looked up."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.off, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.bytes, self.counts = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int32)

    def _learn(self, spelt: list[tuple[bytes, bool]], keys: np.ndarray) -> None:
        rows: list[list[int]] = [[]] * len(spelt)
        held, totals = PiecePrefix(self.v), []
        for i in sorted(range(len(spelt)), key=lambda i: spelt[i][0].lower()):  # neighbours have beginnings in common
            x, slow = spelt[i]
            rows[i] = word_counts(x, self.v) if slow else list(piece_counts(x, self.v, held, totals))
        size = np.array([len(x) for x, _ in spelt], np.int64)
        need = self.used + int(size.sum())
        if need > len(self.bytes):
            grow = max(need, 2 * len(self.bytes)) - len(self.bytes)
            self.bytes, self.counts = np.r_[self.bytes, np.zeros(grow, np.uint8)], np.r_[self.counts, np.zeros(grow, np.int32)]
        self.bytes[self.used : need] = np.frombuffer(b"".join(x for x, _ in spelt), np.uint8)
        self.counts[self.used : need] = np.fromiter((n for r in rows for n in r), np.int32, int(size.sum()))
        first = len(self.off)
        self.off, self.size = np.r_[self.off, self.used + np.cumsum(size) - size], np.r_[self.size, size]
        self.used = need
        into = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, into, keys), np.insert(self.slot, into, first + np.arange(len(keys)))

    def at_every_byte(self, data: bytes) -> np.ndarray:
        """Tokens of ``data[: i + 1]`` for each i that ends a character (inside one, of the characters before)."""
        if not data:
            return np.zeros(0, np.int64)
        starts, ends, slow = pieces(data)
        b, n = np.frombuffer(data, np.uint8), len(starts)
        if not n:
            return np.zeros(len(b), np.int64)
        size = ends - starts
        kept = np.flatnonzero(size <= LONG_PIECE)
        long_ = np.flatnonzero(size > LONG_PIECE)
        h = bw.hashes(b, starts[kept], ends[kept]) ^ slow[kept].astype(np.uint64)
        order = np.argsort(h)
        first = np.r_[True, h[order[1:]] != h[order[:-1]]] if len(h) else np.zeros(0, bool)
        distinct, place = h[order[first]], kept[order[first]]
        if self.used > REMEMBERED:
            self._forget()
        i = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = i < len(self.keys)
        new[inside] = self.keys[i[inside]] != distinct[inside]
        if new.any():
            self._learn([(data[starts[p] : ends[p]], bool(slow[p])) for p in place[new].tolist()], distinct[new])
            i = np.searchsorted(self.keys, distinct)
        slot = np.empty(len(h), np.int64)
        slot[order] = self.slot[i][np.cumsum(first) - 1]

        # gather the kept counts byte by byte, and hold the kept bytes against the text's
        width = size[kept]
        before = np.cumsum(width) - width
        step = np.arange(int(width.sum()))
        here = np.repeat(starts[kept] - before, width) + step
        there = np.repeat(self.off[slot] - before, width) + step
        fits = self.size[slot] == width
        if not fits.all():
            there = np.where(np.repeat(fits, width), there, 0)
        apart = (self.bytes[there] != b[here]) | ~np.repeat(fits, width)
        inner = np.zeros(len(b), np.int64)
        inner[here] = self.counts[there]
        owner = np.repeat(kept, width)[apart] if apart.any() else np.zeros(0, np.int64)  # two spellings of one hash
        for p in [*long_.tolist(), *np.unique(owner).tolist()]:
            inner[starts[p] : ends[p]] = (word_counts if slow[p] else piece_counts)(data[starts[p] : ends[p]], self.v)
        total = np.r_[0, np.cumsum(inner[ends - 1])]
        done = np.zeros(len(b) + 1, np.int64)
        done[ends] = 1
        out = total[np.cumsum(done[:-1])]  # pieces that ended before this byte
        solid = np.zeros(len(b) + 1, np.int64)
        solid[starts] += 1
        solid[ends] -= 1
        return np.where(np.cumsum(solid[:-1]) > 0, out + inner, out)

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of ``text[:k]`` for k from 0 to its length; texts of any length, in segments between white space."""
        parts, base = [np.zeros(1, np.int64)], 0
        for seg in bw.segments((text or "").encode("utf-8", "replace"), GROUP):
            got = self.at_every_byte(seg)
            b = np.frombuffer(seg, np.uint8)
            ends = np.r_[(b[1:] & 0xC0) != 0x80, True] if len(b) else np.zeros(0, bool)
            parts.append(base + got[ends])
            base += int(got[-1]) if len(got) else 0
        return np.concatenate(parts)

    def totals(self, texts: list[str | None]) -> list[int]:
        """The last prefix count of each text; short ones are taken together."""
        out: list[int] = []
        group: list[bytes] = []

        def flush() -> None:
            if group:
                counts = np.r_[0, self.at_every_byte(b"\n".join(group) + b"\n")]
                at = np.cumsum([0, *[len(x) + 1 for x in group]])
                out.extend(np.diff(counts[at]).tolist())
                group.clear()

        size = 0
        for t in texts:
            x = (t or "").encode("utf-8", "replace")
            if size + len(x) > GROUP:
                flush()
                size = 0
            if len(x) > GROUP:
                out.append(sum(int(c[-1]) for seg in bw.segments(x, GROUP) if len(c := self.at_every_byte(seg))))
                continue
            group.append(x)
            size += len(x) + 1
        flush()
        return out


def tokens_at(prefix: np.ndarray, chars: int) -> int:
    """Tokens of the first ``chars`` characters, from a text's prefix counts."""
    return int(prefix[min(chars, len(prefix) - 1)])


def longest_within(prefix: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens. A longer prefix may take fewer tokens, so all are looked at."""
    fits = np.flatnonzero(np.asarray(prefix) <= budget)
    return int(fits[-1]) if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def with_token_counts(docs: DataFrame, path: str | None = None, column: str = "n_tokens", limit: int | None = None) -> DataFrame:
    """``docs`` with the exact token count of each whole text, its last prefix count; a clashing column is replaced.

    With ``limit`` also ``over_limit`` and ``within_limit``, the characters of the
    longest prefix of at most so many tokens. Null counts as empty: 0 tokens.
    """
    where = path or default_path()

    @F.arrow_udf("struct<n:bigint,within:bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(where)
        for texts in batches:
            rows = texts.to_pylist()
            n = c.totals(rows)
            within = [len(t or "") if limit is None or k <= limit else longest_within(c.prefixes(t), limit) for t, k in zip(rows, n, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(within, pa.int64())], ["n", "within"])

    got = docs.withColumn("__c", counted(F.col("text")))
    more = {} if limit is None else {"over_limit": F.col("__c.n") > limit, "within_limit": F.col("__c.within")}
    return got.withColumns({column: F.col("__c.n"), **more}).drop("__c")


def prefix_table(docs: DataFrame, path: str | None = None, column: str = "prefix") -> DataFrame:
    """``docs`` with an array of token counts, that of ``text[:k]`` at place k (0 first), from which every cut is answered."""
    where = path or default_path()

    @F.arrow_udf("array<int>")
    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(where)
        for texts in batches:
            rows = [c.prefixes(t) for t in texts.to_pylist()]
            at = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows).astype(np.int32) if rows else [], pa.int32()))

    return docs.withColumn(column, stored(F.col("text")))


def op7_tokens(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (and within_limit) for every document."""
    docs = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=limit)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "over_limit", "within_limit")
