"""New files become documents and chunks, batch by batch; each file once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..operators.chunking import chunk_documents, strategy, to_chunk_rows
from ..schema import CHUNK, DOCUMENT, Options
from ..sources.archive import resolve_uploads
from ..sources.epub import epub_chapters, epub_markdown
from ..sources.pdf import pdf_columns

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a store holds; a path that isn't there yet holds nothing, any other failure is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store_files(docs: DataFrame, folder: str) -> DataFrame:
    """(id, stored): each row's ``content`` written to ``folder``/id.suffix; a repeated write replaces the file by itself."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for batch in batches:
            fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            fs.create_dir(base, recursive=True)
            out = []
            for r in batch.to_pylist():
                path, part = f"{base}/{r['id']}.{r['suffix']}", f"{base}/.{r['id']}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(r["content"])
                fs.move(part, path)
                out.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "stored"])

    return docs.select("id", "suffix", "content").mapInArrow(write, "id string, stored string")


def ingest_batch(files: DataFrame, domain: DataFrame, store: str, domain_id: str, options: Options = Options(), embed: Callable[[str], list[float]] | None = None) -> None:
    """Append a batch's documents, chunks and files under ``store``; names that the domain has already are skipped.

    Files come first, then chunks, then documents: a document row marks a finished file.
    A batch that broke off between two of them is replayed whole: files are replaced by
    themselves, and documents whose chunks are there don't add them again.
    """
    spark = files.sparkSession
    got = resolve_uploads(files.select("path", "content"))
    got = got.withColumns({"domain_id": F.lit(domain_id), "source_filename": F.element_at(F.split("path", "/"), -1), "title": F.lit(None).cast("string")})
    done = _existing(spark, f"{store}/document", DOCUMENT).select("domain_id", "source_filename")
    docs = catalog.new_document(got.dropDuplicates(["source_filename"])).join(done, ["domain_id", "source_filename"], "left_anti")
    known = domain.select(F.col("id").alias("domain_id"), F.lit(True).alias("__known"))
    docs = docs.join(known, "domain_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("__known").isNull(), "Domain not found")))
    docs = docs.withColumns({"chunk_strategy": F.lit(None).cast("string"), "structural_variant": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})
    pdf = pdf_columns(docs.filter("source_type = 'PDF' AND error IS NULL").select("id", "content"))
    read = docs.join(pdf, "id", "left").withColumns({
        "markdown": F.when(F.col("source_type") == "EPUB", epub_markdown(F.col("content"))).otherwise(F.coalesce("pdf_markdown", F.lit(""))),
        "pages": F.when(F.col("source_type") == "EPUB", epub_chapters(F.col("content"))).otherwise(F.coalesce("pdf_pages", F.array().cast("array<string>"))),
    })
    read = strategy(read.drop("pdf_markdown", "pdf_pages"), domain, options).persist()
    try:
        # a file that nothing was read from has failed, whatever its kind
        blank = (F.col("markdown") == "") & (F.size(F.filter("pages", lambda p: F.trim(p) != "")) == 0)
        docs = read.withColumn("error", F.coalesce("error", F.when(blank, "No text could be read")))
        good = docs.filter("error IS NULL")
        stored = store_files(good, f"{store}/files")
        stored.write.format("noop").mode("overwrite").save()
        have = _existing(spark, f"{store}/chunk", CHUNK).select(F.col("document_id").alias("id")).distinct()
        chunks = to_chunk_rows(chunk_documents(good.join(have, "id", "left_anti"), options, embed), embed)
        chunks.repartition("domain_id", "document_id").write.mode("append").partitionBy("domain_id").parquet(f"{store}/chunk")
        rows = docs.select(
            "id", "domain_id", "title", F.lit(None).cast("string").alias("author"), "source_filename",
            F.when(F.col("error").isNull(), F.concat(F.lit(f"{store}/files/"), "id", F.lit("."), "suffix")).otherwise(F.col("path")).alias("source_path"), "source_type", "tags",
            F.when(F.col("error").isNull(), "COMPLETED").otherwise("FAILED").alias("ingestion_status"), F.col("error").alias("ingestion_error"),
            F.when(F.col("error").isNull(), F.current_timestamp()).alias("ingested_at"), "chunk_strategy", "structural_variant",
        )
        rows.write.mode("append").parquet(f"{store}/document")
    finally:
        read.unpersist()


def ingest_stream(spark: SparkSession, folder: str, domain: DataFrame, store: str, domain_id: str, options: Options = Options(), embed: Callable[[str], list[float]] | None = None) -> StreamingQuery:
    """Take in what the folder holds now and hasn't been taken before, then stop."""
    return (
        watch(spark, folder).writeStream.foreachBatch(lambda df, _: ingest_batch(df, domain, store, domain_id, options, embed))
        .option("checkpointLocation", f"{store}/_progress").trigger(availableNow=True).start()
    )


def status(spark: SparkSession, store: str) -> DataFrame:
    """(ingestion_status, n) of what has been taken in."""
    return _existing(spark, f"{store}/document", DOCUMENT).groupBy("ingestion_status").agg(F.count(F.lit(1)).alias("n"))
