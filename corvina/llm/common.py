"""Shared pieces of the corpus operators: scratch tables, splits, small checks."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a cluster
    without it is refused, since its executors share no local disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="corvina-"))
    return "file://" + _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/corvina-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clear_scratch)
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there.

    A lost executor then costs a reread of files that outlive it, never the whole job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave and nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)
        _WRITTEN.remove((t.sparkSession, t._scratch))


def clear_scratch() -> None:
    """Delete the scratch tables that this interpreter wrote and that results may have read until now; a session that has ended deletes none."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        _delete(spark, path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows kept out of every fit: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes, ``__h1`` and ``__h2``, of all columns but maps: only rows equal in those share both, whatever their id."""
    cells = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*cells).alias("__h1"), F.xxhash64(F.lit("row"), *cells).alias("__h2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], max_rows: int, max_chars: int, max_doc_chars: int) -> DataFrame:
    """At most ``max_rows`` labelled rows (doc_id, text, labels) to fit a model on.

    Rows held out, without a label or without an id stay away; a null text counts as
    empty, one of over ``max_doc_chars`` isn't used. The slim label rows are cut first
    (a top-k by hash of the id), so that side's size is bounded before it is broadcast;
    of the texts found, those are taken, in hash order, whose running length stays
    within ``max_chars``; no task ranks more than slim rows. The same rows come at every rerun, however tables are laid out.
    """
    from pyspark.sql import Window

    picked = (
        labels.select(F.col("doc_id").alias("__id"), *[F.col(n).alias(f"__{n}") for n in names])
        .filter(~held_out("__id") & F.col("__id").isNotNull())
        .dropna()
        .distinct()
        .orderBy(F.xxhash64("__id"), *[f"__{n}" for n in names])
        .limit(max_rows)
    )
    # texts are ranked by their hashes and lengths, and fetched once it is known which
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("__h", F.xxhash64("text")).withColumn("__n", F.length("text"))
    found = (
        own.drop("text").filter(F.col("__n") <= max_doc_chars)
        .join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
        .select("doc_id", "__h", "__n", *[F.col(f"__{n}") for n in names])
        .distinct()
    )
    order = Window.orderBy(F.xxhash64("doc_id"), "__h", *[f"__{n}" for n in names]).rowsBetween(Window.unboundedPreceding, 0)
    slim = (
        found.orderBy(F.xxhash64("doc_id"), "__h", *[f"__{n}" for n in names]).limit(max_rows)
        .withColumn("__run", F.sum("__n").over(order))
        .filter(F.col("__run") <= max_chars)
        .select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k"), *[F.col(f"__{n}").alias(n) for n in names])
    )
    got = own.join(F.broadcast(slim), (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__k")))
    return got.select("doc_id", "text", *names).dropDuplicates(["doc_id", "text", *names])


def fit_on_executor(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """``fit(rows)`` run by one task over the bounded ``sample``; only what it returns comes to the driver.

    Rows are sorted first, so the result doesn't depend on their order; a lost executor
    costs a rerun of that task. An empty sample is fitted too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=repr)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])
