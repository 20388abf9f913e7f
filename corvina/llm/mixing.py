"""Operator 3: mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key; keys are ranges within a source, so a source of any
size is spread over buckets of about equal rows. Prefix sums of sizes are taken within
each bucket and offset by the sums of the buckets before it. A source's budget then
cuts the order exactly: whole epochs first, then a prefix of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, row_key, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Rows of one bucket of one source, about; and the most buckets of one source.
BUCKET_ROWS = 20_000
MAX_BUCKETS = 1 << 16
#: Copies of one row that a task unrolls at a time.
UNROLL = 10_000


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered_prefix(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``place`` (0-based) in a total order (nulls last) and, for each column of ``sums``, the sum of the rows before as ``before_…``.

    Rows are cut into ranges; a range's sums are offset by those of the ranges before it,
    of which there are no more than shuffle partitions.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    parts = materialise(df.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("__p").orderBy(*cols)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"__i": F.row_number().over(inner) - 1} | {f"__{c}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in sums})
    ends = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in sums])
    offset = each.select("__p", *[F.coalesce(F.sum(x).over(ends), F.lit(0)).alias(f"__o{x}") for x in ["__n", *[f"__s_{c}" for c in sums]]])
    got = rows.join(F.broadcast(offset), "__p")  # a row per range
    return got.select(*df.columns, (F.col("__i") + F.col("__o__n")).alias("place"), *[(F.col(f"__{c}") + F.col(f"__o__s_{c}")).alias(f"before_{c}") for c in sums])


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``target`` per row of ``sources`` (source, source_size): ``share`` of all sizes, by weight, none above ``most`` times its size.

    Sources rank by code point, null last, and take ``weights`` in turn. Resharing the
    excess by weight until no target is above its cap ends where every source gets
    min(cap, level * weight); the level follows from the sources in the order in which
    they reach their caps. Sources of size 0 get 0. Sources of any number are ranked in ranges.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ordered_prefix(sources.select("source", "source_size"), ["source"], []).withColumnRenamed("place", "rank").withColumn("w", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    ranked = materialise(ordered_prefix(ranked, ["ratio", "rank"], ["cap", "w"]), "ranked")
    sums = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    # with all sources before this one at their caps, the level that the rest would share
    level = (F.lit((sums[0] or 0) * share) - F.col("before_cap")) / (F.lit(sums[1] or 1.0) - F.col("before_w"))
    held = ranked.withColumn("level", level).filter("level <= ratio")
    first = held.agg(F.min(F.struct("ratio", "rank", "level"))["level"]).first()[0]
    return ranked.select("source", "source_size", F.least("cap", F.lit(float("inf") if first is None else float(first)) * F.col("w")).alias("target"))


def _sized(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """Slim rows (source, size, key, doc_id, …), equal ones once with their number ``copies``."""
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *more)
    return materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "sizes")


def _placed(rows: DataFrame, share: float, most: float, weights: tuple[int, ...], order: list[str]) -> DataFrame:
    """``rows`` of ``_sized`` with source_size, target, epochs, and ``left``: the budget that is left of the last epoch when the row's turn comes."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = materialise(sums, "sources")
    plan = materialise(targets(sums, share, most, weights), "targets").withColumnRenamed("source", "s")
    buckets = min(MAX_BUCKETS, max(1, -(-(sums.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS)))
    # the leading 28 bits of the key, cut into even ranges
    rows = rows.withColumn("bucket", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)).cast("int"))
    weight = F.col("size") * F.col("copies")
    offsets = rows.groupBy("source", "bucket").agg(F.sum(weight).alias("words"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
    offsets = offsets.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("inner"))
    return rows.drop("bucket", "inner", "offset", "s", "b", "key")


def _taken(copy: Column) -> Column:
    """Words taken of the given copy (0-based) of a placed row."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - copy * F.col("size")))
    return (F.col("epochs") * F.col("size") + part).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "0") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of ``docs``.

    ``taken`` counts the words that the mix takes of the row: its size times the whole
    epochs of its source, plus, up to the exact budget, its part in the last one (the
    row on the cut gives only its first words). Null and empty texts have size 0 and give
    nothing; a null source is a source. Equal ids tie by size, so reruns agree; rows equal
    in id, source and size are placed once, however many, and unrolled at the end. An
    empty table gives none.
    """
    placed = materialise(_placed(_sized(docs, seed), share, most, weights, []), "placed")
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / UNROLL))))
    if not placed.filter(F.col("copies") > UNROLL).isEmpty():
        chunks = chunks.repartition("doc_id", "source", "size", "chunk")
    first = F.col("chunk") * UNROLL
    rows = chunks.withColumn("copy", F.explode(F.sequence(first, F.least(first + UNROLL, F.col("copies")) - 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS w
  FROM d GROUP BY source
), fill(round, source, source_size, w, fixed) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, fixed OR 2.0 * source_size <= w * level
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN fixed THEN 2.0 * source_size END) OVER (), 0))
                  / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (), 0) AS level FROM fill)
  WHERE round < 50
), last AS (SELECT * FROM fill WHERE round = 50),
level AS (
  SELECT (1.5 * sum(source_size) - coalesce(sum(CASE WHEN fixed THEN 2.0 * source_size END), 0)) / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END), 0) AS l FROM last
), t AS (
  SELECT source, source_size, CASE WHEN fixed THEN 2.0 * source_size ELSE w * (SELECT l FROM level) END::DOUBLE AS target FROM last
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""


def take_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "0") -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns as they came, with size, source_size, target and taken.

    Columns of those names that ``docs`` has are replaced. Rows are told apart by all
    their columns, whatever their ids; wholly equal rows at the cut are numbered, so each
    source's budget is met to the word.
    """
    added = ("size", "source_size", "target", "taken")
    keys = ["__h1", "__h2"]
    placed = _placed(_sized(docs, seed, *row_key(docs)), share, most, weights, keys)
    placed = placed.filter((F.col("epochs") > 0) | (F.col("left") > 0)).filter("size > 0").select(*keys, *[F.col(c).alias(f"__{c}") for c in ("size", "source_size", "target", "epochs", "left", "copies")])
    placed = materialise(placed, "placed")
    on_cut = (F.col("__copies") > 1) & (F.col("__left") > 0) & (F.col("__left") < F.col("__copies") * F.col("__size"))
    own = [F.col(c) for c in docs.columns if c not in added]
    put = lambda rows, copy: rows.select(
        *own, *[F.col(f"__{c}").alias(c) for c in added[:3]],
        (F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left") - copy * F.col("__size")))).cast("long").alias("taken"),
    )
    keyed = docs.select("*", *row_key(docs))
    rest = put(keyed.join(placed.filter(~on_cut), keys), F.lit(0))
    if placed.filter(on_cut).isEmpty():
        return rest
    cut = materialise(keyed.join(F.broadcast(placed.filter(on_cut)), keys).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "cut")  # one row a source at most
    inner = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__m")) - 1
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = cut.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = cut.withColumn("__i", inner).join(each, [*keys, "__p"]).withColumn("__copy", F.col("__i") + F.col("__before"))
    return rest.union(put(numbered, F.col("__copy")).filter("taken > 0"))
