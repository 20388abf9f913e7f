"""Operator 8: SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into few segments, so that one of them differs in at most one bit
between near copies; each fingerprint is indexed under every segment with each of its
bits wildcarded in turn, and what shares a variant is compared. With two bits in every
segment a pair would be too far apart to link, so every link is found: ``EXACT`` (64 bits,
three segments) links at 4 bits, ``WIDE`` (128 bits, ten segments) at 19, which is texts
whose five-word shingles are about 0.8 alike.
Buckets are never expanded into pairs: a bucket yields a forest that joins its linked
fingerprints. A bucket beyond the limit is indexed again by the remaining bits (``EXACT``),
and what is still beyond it is split into pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as bk
from . import bytewords as bw
from .common import materialise, row_key, table
from .components import connected_components

LIMIT = 4096


@dataclass(frozen=True)
class Spec:
    """Words of a shingle, segments (start, length) of the fingerprint's 64-bit words in a row, the most bits a link differs in, and the rows of a bucket that a task holds."""

    shingle: int
    segments: tuple[tuple[int, int], ...]
    most: int
    limit: int = LIMIT

    def __post_init__(self) -> None:
        if self.most >= 2 * len(self.segments):
            raise ValueError("a link could differ in two bits of every segment")

    @property
    def words(self) -> int:
        return 1 + (self.segments[-1][0] + self.segments[-1][1] - 1) // 64


EXACT = Spec(4, ((0, 22), (22, 21), (43, 21)), 4)
# short segments fill buckets evenly: more rows of 24 bytes are held at once than split into blocks
WIDE = Spec(5, tuple((64 * k + s, n) for k in range(2) for s, n in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))), 19, 1 << 16)


def fingerprint(text: str | None, shingle: int = EXACT.shingle) -> int:
    """64-bit SimHash of the whole text, as a signed integer.

    Words part at ASCII white space, A-Z lower-cased; fewer words than a shingle make one
    of the whole sequence; a text without words (null too) has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64)
    return int(_majority([h])[0])


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit word per array: the bits that over half of its hashes have."""
    out = []
    for h in hashes:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])
    return np.array(out, np.uint64).view(np.int64)


def wide_fingerprint(text: str | None, spec: Spec = WIDE) -> np.ndarray:
    """``spec.words`` signed 64-bit words of SimHash; words and short texts as in ``fingerprint``, hashes by polynomials over the words' hashes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    parts = []
    for seg in bw.segments(data):
        starts, ends = bw.spans(seg, bw.NOT_SPACE)
        parts.append(bw.hashes(np.frombuffer(seg, np.uint8), starts, ends))
    w = np.concatenate(parts)
    if not len(w):
        return np.zeros(spec.words, np.int64)
    k = min(spec.shingle, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    mixed = []
    for n in range(spec.words):
        x = (h + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed.append(x ^ x >> np.uint64(31))
    return _majority(mixed)


def fingerprint_columns(spec: Spec) -> list[Column]:
    """``f0``, ``f1``, …: the fingerprint's words, as columns that follow from ``text``."""
    n = spec.words

    @F.arrow_udf("struct<" + ",".join(f"f{k}:bigint" for k in range(n)) + ">")
    def computed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [np.array([fingerprint(t, spec.shingle)]) if n == 1 else wide_fingerprint(t, spec) for t in texts.to_pylist()]
            m = np.array(rows, np.int64).reshape(-1, n)
            yield pa.StructArray.from_arrays([pa.array(m[:, k]) for k in range(n)], [f"f{k}" for k in range(n)])

    return [computed(F.col("text")).alias("fp")]


def _words(spec: Spec) -> list[str]:
    return [f"f{k}" for k in range(spec.words)]


def node(spec: Spec, suffix: str = "") -> Column:
    """A fingerprint as one value that compares: the number itself, or its words in hexadecimal."""
    if spec.words == 1:
        return F.col(f"f0{suffix}")
    return F.concat(*[F.lpad(F.hex(f"{w}{suffix}"), 16, "0") for w in _words(spec)])


def _bits(x: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND((1 << length) - 1)


def _variants(words: list[Column], segments: tuple[tuple[int, int], ...]) -> Column:
    """One number per bit: its place over its segment's bits with that bit cleared."""
    wide = max(n for _, n in segments)
    out = []
    for start, n in segments:
        s = _bits(words[start // 64], start % 64, n)
        out += [s.bitwiseAND(((1 << n) - 1) ^ (1 << b)) + F.lit((start + b) << wide) for b in range(n)]
    return F.array(*[v.cast("long") for v in out])


def _rest(x: Column, bit: Column) -> Column:
    """The 42 or 43 bits of an ``EXACT`` fingerprint outside the segment that holds ``bit``."""
    (_, a), (b, _), (c, _) = EXACT.segments
    upper = F.shiftrightunsigned(x, c)
    return F.when(bit < b, F.shiftrightunsigned(x, a)).when(bit < c, _bits(x, 0, b) + F.shiftleft(upper, b)).otherwise(_bits(x, 0, c))


def _compare(batches: Iterator[pa.RecordBatch], spec: Spec, limit: int) -> Iterator[pa.RecordBatch]:
    """(hot, key, f…, f…b): edges that join linked fingerprints of a bucket, and the rows of buckets beyond the limit."""
    names = _words(spec)

    def rows(hot: bool, key: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), hot)), pa.array(key), *map(pa.array, a), *map(pa.array, b)], ["hot", "key", *names, *(f"{x}b" for x in names)])

    for c, large in bk.whole_groups(batches, limit):
        if len(large["key"]):
            own = [large[x] for x in names]
            yield rows(True, large["key"], own, own)
        key = c["key"]
        if not len(key):
            continue
        fps = [c[x].view(np.uint64) for x in names]
        apart = lambda i, j: sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int16) for f in fps)
        found = [(i[near], j[near]) for i, j in bk.pairs(key) for near in [apart(i, j) <= spec.most]]
        for g in bk.large_groups(key):
            part = [f[g] for f in fps]

            def near(r: slice, s: slice, part: list[np.ndarray] = part) -> np.ndarray:
                close = np.bitwise_count(part[0][r, None] ^ part[0][None, s]) <= spec.most
                if len(part) > 1:  # the other words of the few that the first leaves
                    i, j = np.nonzero(close)
                    close[i, j] = sum(np.bitwise_count(f[r][i] ^ f[s][j]).astype(np.int16) for f in part) <= spec.most
                return close

            label = bk.forest(len(part[0]), bk.blocks(len(part[0]), near))
            i = np.flatnonzero(label != np.arange(len(part[0])))
            found.append((g.start + i, g.start + label[i]))
        i, j = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        if len(i):
            yield rows(False, key[i], [c[x][i] for x in names], [c[x][j] for x in names])


def _edges(keyed: DataFrame, spec: Spec, limit: int) -> DataFrame:
    """``_compare`` over (key, f…), rows sorted by key within their partition."""
    fields = ", ".join(f"{x} bigint" for x in [*_words(spec), *(f"{x}b" for x in _words(spec))])
    return materialise(
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, spec, limit), f"hot boolean, key bigint, {fields}"),
        "edges",
    )


def link_fingerprints(fps: DataFrame, spec: Spec = EXACT, limit: int | None = None) -> DataFrame:
    """Edges (a, b) of nodes, over the distinct fingerprints of columns ``f0``, …, whose components are those of all links."""
    limit = spec.limit if limit is None else limit
    wide = max(n for _, n in spec.segments)
    names = _words(spec)
    ends = lambda df: df.filter(~F.col("hot")).select(node(spec).alias("a"), node(spec, "b").alias("b"))
    fps = fps.select(*names).dropna().distinct()
    first = _edges(fps.select(F.explode(_variants([F.col(x) for x in names], spec.segments)).alias("key"), *names), spec, limit)
    edges = ends(first)
    left = first.filter("hot").select("key", *names)
    if left.isEmpty():
        return edges
    if spec == EXACT:
        # the bucket's bits agree but for one: the others, in three pieces, tell its rows apart
        rest = _rest(F.col("f0"), F.shiftright("key", wide))
        pieces = ((0, 15), (15, 14), (29, 14))
        again = left.select(F.explode(_variants([rest], pieces)).alias("v"), "key", "f0")
        second = _edges(again.select((F.shiftleft("key", 22) + F.col("v")).alias("key"), "f0"), spec, limit)
        edges, left = edges.union(ends(second)), second.filter("hot").select("key", *names)
        if left.isEmpty():
            return edges
    half = limit // 2
    n = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") * 3 / F.lit(half)))
    b = left.join(n, "key").withColumn("block", F.pmod(F.xxhash64(*names), "blocks"))
    b = b.select("key", *names, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    b = b.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), *names)
    return edges.union(ends(_edges(b, spec, 1 << 30)))


def _rooted(fps: DataFrame, spec: Spec, limit: int | None) -> DataFrame:
    """``fps``, a row for each fingerprint, with ``fp``, its node, and ``root``, the smallest node that links lead to."""
    fps = fps.withColumn("fp", node(spec))
    parts = connected_components(link_fingerprints(fps, spec, limit)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = fps.join(parts, "fp", "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))
    return materialise(rooted, "rooted")


def near_duplicates(docs: DataFrame, spec: Spec = EXACT, limit: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    Equal fingerprints are one node, whatever their number; the component is the smallest
    doc_id reachable by links of at most ``spec.most`` differing bits, the row's own
    included. Null ids never name a component unless it has no other; a repeated id has
    a row, and its own fingerprint, for each time it comes. Other columns aren't looked at.
    """
    names = _words(spec)
    d = materialise(docs.select("doc_id", "text").select("doc_id", *fingerprint_columns(spec)).select("doc_id", "fp.*"), "fingerprints")
    rooted = _rooted(d.groupBy(*names).agg(F.min("doc_id").alias("least")), spec, limit)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select(*names, "fp", "root").join(least, "root").select(*names, "fp", "component_id")
    return d.join(of_fp, names).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, spec: Spec = WIDE, limit: int | None = None) -> DataFrame:
    """One row of each component, all columns as they came: that of the smallest doc_id, null ids last.

    Rows are told apart by all their columns, so null and repeated ids stay as often as
    their components differ; of a component's rows of one id, that of the least hash
    stays. Texts without a word (null, empty) are copies of each other.
    """
    names = _words(spec)
    d = materialise(docs.select("doc_id", "text", *row_key(docs)).select("doc_id", "__h1", "__h2", *fingerprint_columns(spec)).select("doc_id", "__h1", "__h2", "fp.*"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__h1", "__h2")
    rooted = _rooted(d.groupBy(*names).agg(F.min(first).alias("first")), spec, limit)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.__h1", "first.__h2")
    left = docs.select("*", *row_key(docs)).join(kept, ["__h1", "__h2"], "left_semi")
    equal_rows = not d.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return (left.dropDuplicates(["__h1", "__h2"]) if equal_rows else left).select(docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
