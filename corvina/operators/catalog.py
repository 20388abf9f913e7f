"""Catalogue changes as pure functions on tables, and the tag hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..schema import KEYS, NotFound, duplicate_keys

Tables = dict[str, DataFrame]


def insert(df: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """``df`` with ``rows``; a key that is there already, or comes twice, is refused."""
    keys = list(KEYS[table])
    if not duplicate_keys(rows, table).isEmpty() or not rows.join(df.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError(f"{table}: {', '.join(keys)} must be unique")
    return df.unionByName(rows, allowMissingColumns=True)


def update(df: DataFrame, row_id: str, **values: object) -> DataFrame:
    """The row of that id with new values; a column keeps its type, order and other rows."""
    def new(name: str) -> Column:
        v = values[name]
        return v if isinstance(v, Column) else F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else F.lit(v)

    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.when(F.col("id") == row_id, new(c).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def find(df: DataFrame, row_id: str) -> DataFrame:
    """That row; an id that isn't there raises."""
    row = df.filter(F.col("id") == row_id)
    if row.isEmpty():
        raise NotFound(row_id)
    return row


def search_names(df: DataFrame, column: str, q: str | None) -> DataFrame:
    return df.filter(tx.contains_ci(F.col(column), q))


def page_of(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def page_facts(total: int, page: int, size: int) -> dict[str, object]:
    pages = max(1, -(-total // size))
    return {"total_pages": pages, "has_next": page + 1 < pages, "has_previous": page > 0}


def delete_domain(t: Tables, domain_id: str) -> Tables:
    """The tables without a domain and all that hangs from it."""
    out = {k: v.filter(F.col("domain_id") != domain_id) for k, v in t.items() if k != "domain"}
    return t | out | {"domain": t["domain"].filter(F.col("id") != domain_id)}


def delete_document(t: Tables, document_id: str) -> Tables:
    return t | {"document": t["document"].filter(F.col("id") != document_id), "chunk": t["chunk"].filter(F.col("document_id") != document_id)}


def set_document_tags(t: Tables, document_id: str, tags: list[str]) -> Tables:
    """New tags on a document and on its chunks, in one snapshot."""
    new = F.array(*[F.lit(x) for x in tags]).cast("array<string>")
    chunk = t["chunk"].withColumn("tag_paths", F.when(F.col("document_id") == document_id, new).otherwise(F.col("tag_paths")))
    return t | {"document": update(t["document"], document_id, tags=new), "chunk": chunk}


def set_status(document: DataFrame, document_id: str, status: str, error: str | None = None, ingested_at: object = None) -> DataFrame:
    """Error and time are overwritten, with null where not given."""
    return update(document, document_id, ingestion_status=status, ingestion_error=error, ingested_at=ingested_at)


def reset_for_ingest(t: Tables, document_id: str) -> Tables:
    return t | {"chunk": t["chunk"].filter(F.col("document_id") != document_id), "document": set_status(t["document"], document_id, "PENDING")}


def new_document(rows: DataFrame) -> DataFrame:
    """Uploads (domain_id, source_filename, title, …) with id, title, suffix type and a pending status."""
    name = tx.trim_ws(F.col("source_filename"))
    return rows.withColumns({
        "id": F.sha2(F.concat_ws("\u0001", "domain_id", name), 256), "title": tx.title_or_filename(F.col("title"), name), "source_filename": name,
        "source_type": F.upper(tx.file_suffix(name)), "ingestion_status": F.lit("PENDING"),
    })


def first_chunk(chunk: DataFrame, document_id: str) -> DataFrame:
    return chunk.filter((F.col("document_id") == document_id) & (F.col("chunk_index") == 0)).select("id")


def descendants(tag: DataFrame, tag_id: str, strict_parity: bool = False) -> DataFrame:
    """Tags below one, of its domain; ``strict_parity`` looks across domains."""
    root = tag.filter(F.col("id") == tag_id).select("path", "domain_id").first()
    if root is None:
        return tag.filter(F.lit(False))
    below = F.startswith(F.col("path"), F.lit(root["path"] + "."))
    return tag.filter(below if strict_parity else below & (F.col("domain_id") == root["domain_id"]))


def missing_ancestors(tag: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for ancestors of ``rows`` (domain_id, path) that neither table has, named after their labels."""
    wanted = rows.select("domain_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    have = tag.select("domain_id", "path").union(rows.select("domain_id", "path"))
    new = wanted.join(have, ["domain_id", "path"], "left_anti")
    return new.select(F.sha2(F.concat_ws("\u0001", "domain_id", "path"), 256).alias("id"), "domain_id", paths.display_name(F.col("path")).alias("name"), F.lit("").alias("description"), "path")


def insert_tags(tag: DataFrame, rows: DataFrame) -> DataFrame:
    return insert(tag, rows.unionByName(missing_ancestors(tag, rows)), "tag")


def delete_tag(tag: DataFrame, tag_id: str) -> DataFrame:
    if not descendants(tag, tag_id).isEmpty():
        raise ValueError("a tag with tags below it stays")
    return tag.filter(F.col("id") != tag_id)


def filter_tags(tag: DataFrame, q: str | None) -> DataFrame:
    """Name or path holds the text, whatever its case."""
    if not q or not q.strip():
        return tag
    low = F.lit(q.lower())
    return tag.filter(F.contains(F.lower("name"), low) | F.contains(F.lower("path"), low))


def tag_tree(tag: DataFrame) -> DataFrame:
    """Tags with depth and a sort key of names from the root; one whose parent isn't there is a root.

    A tag's nearest present ancestors are looked up by exploding its own path, so no level is walked in turn.
    """
    chain = tag.select("id", "domain_id", "path", "name", F.posexplode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("level", "up"))
    known = tag.select("domain_id", F.col("path").alias("up"), F.col("name").alias("up_name"))
    found = chain.join(known, ["domain_id", "up"], "left")
    per = found.groupBy("id", "domain_id", "path", "name").agg(F.array_sort(F.collect_list(F.struct("level", "up_name"))).alias("x"))
    # names from the lowest gap down: above a missing parent the chain is cut
    cut = F.aggregate("x", F.array().cast("array<string>"), lambda s, v: F.when(v["up_name"].isNull(), F.array().cast("array<string>")).otherwise(F.array_append(s, v["up_name"])))
    return per.withColumn("names", cut).select(
        "id", "domain_id", "path", "name", (F.size("names") - 1).alias("depth"), F.when(F.size("names") > 1, paths.parent(F.col("path"))).alias("parent_path"), F.array_join("names", "\u0001").alias("sort_key")
    )


def default_domain(domain: DataFrame) -> DataFrame:
    """The domain that is taken where none is asked for: the first by name."""
    return domain.orderBy("name", "id").limit(1)


def tag_labels(document: DataFrame, tag: DataFrame) -> DataFrame:
    """(id, labels): a document's tag paths as names, or as the path where no tag has it."""
    d = document.select("id", "domain_id", F.posexplode("tags").alias("i", "path"))
    named = d.join(tag.select("domain_id", "path", "name"), ["domain_id", "path"], "left")
    parts = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "path").alias("n")))).alias("x"))
    return document.select("id").join(parts, "id", "left").select("id", F.coalesce(F.transform("x", lambda v: v["n"]), F.array().cast("array<string>")).alias("labels"))
