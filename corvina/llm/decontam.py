"""Operator 5: benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``WINDOW - K + 1`` neighbouring k-grams the one with the least hash is kept, on
both sides. Two texts that share a span of WINDOW words share all k-grams in it, so they
keep the same one: joining kept fingerprints finds every such span. Each hit is then
extended over the windows around it and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, row_key, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 5
SPAN = WINDOW - K + 1
#: A look-up of one byte a slot over the benchmark's fingerprints, probed twice before the
#: join: 32 slots a fingerprint, 16 MB at most (then about one foreign k-gram in 70 passes
#: at a million fingerprints). Beyond that more candidates reach the join, and none is lost.
MIN_SLOTS, MAX_SLOTS, BLOCK = 1 << 14, 1 << 24, 1 << 8
#: Keys that a fingerprint is spread over in the join, as many documents may share one.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram_hashes(w: str, k: int) -> Column:
    """Hash of the k words at each place; empty where there are fewer."""
    n = F.size(w)
    at = F.when(n >= k, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))


def _is_kept(g: str, i: Column) -> Column:
    """Whether k-gram ``i`` is the (last) least of some full window of SPAN of them."""
    h = F.get(F.col(g), i)
    left: Column = F.lit(0)
    right: Column = F.lit(0)
    for j in range(SPAN - 1, 0, -1):  # how many neighbours in a row it beats, counted from the nearest
        left = F.when((i >= j) & (F.get(F.col(g), i - j) >= h), left + 1).otherwise(0)
        right = F.when(F.get(F.col(g), i + j) > h, right + 1).otherwise(0)
    return left + right + 1 >= SPAN


def _places(g: str, test) -> Column:
    """The indexes ``i`` of an array column that ``test(i, value)`` holds for."""
    n = F.size(g)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: test(i, F.get(F.col(g), i)))


def _probes(h: Column, size: int) -> tuple[Column, Column]:
    return h.bitwiseAND(size - 1).cast("int"), F.shiftright(h, 32).bitwiseAND(size - 1).cast("int")


def _lookup(hashes: DataFrame) -> bytearray:
    """A byte per slot, 1 where a probe of some ``h`` falls. It comes to the driver in blocks that executors make, MAX_SLOTS bytes at most."""
    size = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (32 * hashes.count()).bit_length()))
    probes = hashes.select(F.explode(F.array(*_probes(F.col("h"), size))).alias("s"))
    within = F.collect_set(F.col("s").bitwiseAND(BLOCK - 1))
    blocks = probes.groupBy(F.shiftright("s", 8).alias("block")).agg(within.alias("x"))
    spelt = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.when(F.array_contains("x", i), "01").otherwise("00")), "")
    slots = bytearray(size)
    for block, part in blocks.select("block", F.unhex(spelt)).toLocalIterator():
        slots[block * BLOCK : (block + 1) * BLOCK] = part
    return slots


def _seen(slots: bytearray, h: Column) -> Column:
    one = F.lit(bytearray(b"\x01"))
    a, b = (F.substring(F.lit(slots), p + 1, F.lit(1)) == one for p in _probes(h, len(slots)))
    return a & b


def _around(w: str, i: Column) -> tuple[Column, Column]:
    """The words from SPAN - 1 before ``i`` up to the end of the last window that can hold it, and the place of ``i`` there."""
    off = F.least(i, F.lit(SPAN - 1))
    return F.slice(F.col(w), i - off + 1, off + WINDOW).alias("around"), off.alias("off")


def _marks(classes: DataFrame) -> DataFrame:
    """(k, h, around, off, m, class): what to look for. Long items by kept k-grams; short ones by their first words, k below 0."""
    long_ = classes.filter(F.size("w") >= WINDOW).withColumn("g", _gram_hashes("w", K))
    kept = long_.select("class", "w", "g", F.explode(_places("g", lambda i, h: _is_kept("g", i))).alias("i"))
    found = kept.select(F.lit(K).alias("k"), F.get("g", F.col("i")).alias("h"), *_around("w", F.col("i")), F.lit(WINDOW).alias("m"), "class")
    short = classes.filter(F.size("w") < WINDOW)
    for k in (1, 2, 3):
        some = short.filter(F.least(F.size("w"), F.lit(3)) == k)
        lead = F.xxhash64(*[F.get("w", F.lit(j)) for j in range(k)])
        found = found.union(some.select(F.lit(-k), lead, "w", F.lit(0), F.size("w"), "class"))
    return found


def _candidates(g: str, k: int, slots: bytearray) -> Column:
    """The document's fingerprints of kind ``k`` that the look-up knows, with the words around them."""
    places = _places(g, lambda i, h: _seen(slots, h) & _is_kept(g, i) if k == K else _seen(slots, h))
    return F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), F.get(F.col(g), i).alias("h"), i.alias("i"), *_around("w", i)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of ``docs``.

    A window is WINDOW neighbouring words of an item; an item of fewer, but not none, is
    one window. n_hit counts the document's words inside any occurrence of a window,
    n_items the items with such windows; those of null item_id are sought too, count as
    one item together and have no place in items_sha256. Null texts have no words and hit nothing;
    repeated rows and ids each get their row, by their own text; items of equal words are sought once and
    all counted; an empty benchmark hits nothing. Other columns aren't looked at.
    """
    return _report(docs.select("doc_id", "text"), benchmark)


def _report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with every column of ``docs`` but the text in place of doc_id."""
    own = [c for c in docs.columns if c != "text"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).distinct()
    items = materialise(items.withColumn("class", F.sha2(F.array_join("w", " "), 256)), "items")
    marks = materialise(_marks(items.groupBy("class").agg(F.first("w").alias("w"))), "marks")
    kinds = sorted(r[0] for r in marks.select("k").distinct().collect())

    d = docs.select(*own, words(F.col("text")).alias("w"))
    candidates = []
    for k in kinds:
        slots, g, n = _lookup(marks.filter(F.col("k") == k).select("h")), f"g{k}".replace("-", "_"), abs(k)
        d = d.withColumn(g, _gram_hashes("w", n))
        candidates.append(_candidates(g, k, slots))
    empty = F.array().cast("array<struct<k:int,h:bigint,i:int,around:array<string>,off:int>>")
    d = d.select(F.monotonically_increasing_id().alias("row"), *own, F.size("w").alias("n_words"), F.concat(empty, *candidates).alias("c"))
    d = materialise(d, "candidates")

    c = d.select("row", F.explode("c").alias("c")).select("row", "c.*")
    c = c.withColumn("salt", F.pmod(F.xxhash64("row", "i"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    m = marks.select("k", "h", F.col("around").alias("item_around"), F.col("off").alias("item_off"), "m", "class", salts)
    same = lambda s: (  # noqa: E731 - a window that starts s words before the fingerprint, on both sides
        (F.col("off") >= s)
        & (F.col("item_off") >= s)
        & (F.size("item_around") >= F.col("item_off") - s + F.col("m"))
        & (F.slice("around", F.col("off") - s + 1, F.col("m")) == F.slice("item_around", F.col("item_off") - s + 1, F.col("m")))
    )
    windows = c.join(m, ["k", "h", "salt"]).select("row", "class", "i", "m", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), same)).alias("s"))
    windows = windows.select("row", "class", (F.col("i") - F.col("s")).alias("start"), "m").distinct()
    hit = windows.groupBy("row").agg(F.collect_set(F.struct("start", "m")).alias("x")).select(
        "row", F.size(F.array_distinct(F.flatten(F.transform("x", lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1))))).alias("n_hit")
    )
    which = windows.select("row", "class").distinct().join(items.select("class", "item"), "class").groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("x"), F.max(F.col("item").isNull().cast("int")).alias("unnamed")
    )
    which = which.select("row", (F.size("x") + F.col("unnamed")).alias("n_items"), F.sha2(F.array_join("x", ","), 256).alias("items_sha256"))
    out = d.select("row", *own, "n_words").join(hit, "row", "left").join(which, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *own,
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of ``contamination`` for every document against the whole benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents
), bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bs),
ds AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)
), h AS (SELECT DISTINCT doc_id, i, ds.m, item FROM ds JOIN bs USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they came. Rows go by their own text, whatever their id."""
    hit = _report(docs.select("text", *row_key(docs)), benchmark).filter("contaminated").select("__h1", "__h2").distinct()
    return docs.select("*", *row_key(docs)).join(hit, ["__h1", "__h2"], "left_anti").select(docs.columns)
