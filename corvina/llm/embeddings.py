"""Operator 4: near-duplicate embeddings, by random-hyperplane sign hashing.

Several tables of sign patterns bring similar vectors of one label together. Slim rows
(bucket, id, a sketch of 128 sign bits) are compared first; only vectors with a sketch
close to theirs in a bucket travel to it, where cosines are verified in double
precision. A pair counts in the first table that brings it together, so links are
counted without a shuffle of pairs, and components grow from one forest per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as bk
from .common import materialise, table
from .components import connected_components

THRESHOLD = 0.98
RECALL = 0.99999
LIMIT = 4096
SKETCH = 128


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` distinct vectors: buckets of few rows, and the wanted recall for a pair right at the threshold."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n) / 4))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def sketch_distance(threshold: float = THRESHOLD, miss: float = 1e-7) -> int:
    """Sketch bits that a pair right at the threshold differs in at most, but for a chance of ``miss``."""
    p = math.acos(threshold) / math.pi
    tail, k = 1.0, 0
    while tail > miss and k < SKETCH:
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        k += 1
    return k - 1


def signatures(vectors: Column, bits: int, tables: int, seed: int = 11) -> Column:
    """Per vector, ``sig``: sign patterns, one number per table, and ``k0``, ``k1``: a sketch of other planes; all follow from the seed and the dimension."""

    @F.arrow_udf("struct<sig:array<int>,k0:bigint,k1:bigint>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits)
        for batch in batches:
            size = np.diff(batch.offsets.to_numpy())
            out, sketch = np.zeros((len(batch), tables), np.int32), np.zeros((len(batch), 2), np.int64)
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.r_[0, np.cumsum(size)]
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits + SKETCH))
                rows = np.flatnonzero(size == dim)
                x = _units(flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), int(dim)))
                above = x @ planes[dim] > 0
                out[rows] = (above[:, : tables * bits].reshape(len(rows), tables, bits) * power).sum(2)
                sketch[rows] = np.packbits(above[:, tables * bits :], axis=1, bitorder="little").view("<i8")
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.StructArray.from_arrays([sig, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["sig", "k0", "k1"])

    return signed(vectors)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _alive(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(t, id) of rows, sorted by key, whose bucket has another row with a sketch at most ``most`` bits apart."""
    for c, _ in bk.whole_groups(batches, 1 << 30):  # groups beyond the limit never come here
        key = c["key"]
        if len(key) < 2:
            continue
        k0, k1 = c["k0"].view(np.uint64), c["k1"].view(np.uint64)
        close = lambda i, j: np.bitwise_count(k0[i] ^ k0[j]).astype(np.int16) + np.bitwise_count(k1[i] ^ k1[j]) <= most
        seen = np.zeros(len(key), bool)
        for i, j in bk.pairs(key):
            near = close(i, j)
            seen[i[near]] = seen[j[near]] = True
        for g in bk.large_groups(key):
            rows = np.arange(g.start, g.stop)
            for at in range(0, len(rows), bk.BLOCK):
                part = rows[at : at + bk.BLOCK]
                near = close(part[:, None], rows[None])
                near[np.arange(len(part)), at + np.arange(len(part))] = False
                seen[part] |= near.any(1)
        yield pa.RecordBatch.from_arrays([pa.array(c["t"][seen].astype(np.int32)), pa.array(c["id"][seen])], ["t", "id"])


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): partial link counts n of a (b null), and edges (a, b) that join linked vectors of a bucket."""

    def rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other, pa.array(n, pa.int64())], ["a", "b", "n"])

    for c, _ in bk.whole_groups(batches, 1 << 30):
        if len(c["key"]) < 2:
            continue
        x = _units(c["v"].astype(np.float64))
        sig, t, ids, many = c["sig"], c["t"], c["id"], c["many"]
        # blocks of a split bucket: only rows of the two sides meet, or one block with itself
        side, split = c["side"], c["split"]
        count, found = np.zeros(len(ids), np.int64), []

        def meet(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of linked pairs, those first brought together here: no earlier table has them equal."""
            if not len(i):
                return i, j
            new = np.argmax(sig[i] == sig[j], axis=1) == t[i]
            i, j = i[new], j[new]
            np.add.at(count, i, many[j])
            np.add.at(count, j, many[i])
            return i, j

        for i, j in bk.pairs(c["key"]):
            ok = ((split[i] == 0) | (side[i] != side[j])) & (np.einsum("ij,ij->i", x[i], x[j]) >= threshold)
            found.append(meet(i[ok], j[ok]))
        for g in bk.large_groups(c["key"]):
            y, s, cross = x[g], side[g], bool(split[g.start])
            near = bk.blocks(len(y), lambda p, q, y=y, s=s, cross=cross: (y[p] @ y[q].T >= threshold) & (s[p, None] != s[None, q] if cross else True))
            label = bk.forest(len(y), (tuple(v - g.start for v in meet(i + g.start, j + g.start)) for i, j in near))
            i = np.flatnonzero(label != np.arange(len(y)))
            found.append((g.start + i, g.start + label[i]))
        some = np.flatnonzero(count)
        if len(some):
            yield rows(ids[some], None, count[some])
            i, j = (np.concatenate(p) for p in zip(*found, strict=True))
            yield rows(ids[i], ids[j], np.zeros(len(i), np.int64))


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal dimension compare, by cosine in
    double precision. A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing and is its own component. Equal vectors of a label are
    one class: its copies link with each other and are never expanded into pairs. A null
    vec_id keeps its row. Ids are taken to be unique; rows that repeat one share its class.
    """
    wide = "double" if vectors.schema["embedding"].dataType.simpleString() != "array<float>" else "float"
    ok = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{wide}>").alias("v"))
    v = v.withColumn("ok", F.coalesce(ok & F.col("vec_id").isNotNull(), F.lit(False)))
    # equal vectors of a label are told by two 64-bit hashes
    v = v.withColumn("class", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("vector"), "v").alias("b"))))
    classes = v.filter("ok").groupBy("label", "class").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"))
    classes = materialise(classes, "classes")
    bits, tables = plan(classes.count(), threshold, recall)
    unit = classes.withColumn("s", signatures(F.col("v"), bits, tables))
    unit = materialise(unit.select("label", "id", "many", "v", F.size("v").alias("dim"), "s.*"), "signed")

    key = F.xxhash64("label", "dim", "t", "s")
    slim = unit.select(F.posexplode("sig").alias("t", "s"), "label", "dim", "id", "k0", "k1").select(key.alias("key"), "t", "id", "k0", "k1")
    hot = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot = materialise(hot.select("key", F.ceil(F.col("n") * 2 / F.lit(limit)).alias("blocks")), "hot")
    most = sketch_distance(threshold)
    crowded = not hot.isEmpty()
    few = slim.join(hot, "key", "left_anti") if crowded else slim
    alive = few.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _alive(it, most), "t int, id bigint")
    if crowded:  # such a bucket is compared in blocks, whole
        alive = alive.union(slim.join(hot, "key", "left_semi").select("t", "id"))
    alive = materialise(alive, "alive")
    rows = alive.join(unit, "id").withColumn("s", F.element_at("sig", F.col("t") + 1)).select(key.alias("key"), "t", "id", "many", "v", "sig")
    if not crowded:
        rows = rows.select("*", F.lit(0).alias("side"), F.lit(0).alias("split"))
    else:
        rows = rows.join(hot, "key", "left").withColumn("side", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        other = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
        rows = rows.withColumn("other", F.explode(other))
        split = F.col("blocks").isNotNull()
        where = F.when(split, F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("key"))
        rows = rows.select(where.alias("key"), "t", "id", "many", "v", "sig", "side", (split & (F.col("side") != F.col("other"))).cast("int").alias("split"))
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _linked(it, threshold), "a bigint, b bigint, n bigint")
    found = materialise(found, "links")
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("root"))
    of = classes.select("label", "class", "id", "many").join(links, "id", "left").join(parts, "id", "left")
    of = of.select(F.col("label").alias("l"), F.col("class").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    out = v.select("vec_id", "label", "class").join(of, (F.col("label") == F.col("l")) & (F.col("class") == F.col("c")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    return link_embeddings(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.a = vec_id
"""
