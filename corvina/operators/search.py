"""Lexical, vector and hybrid search over a chunk table.

Each leg ranks slim rows and keeps its top k before anything wide is touched; metadata,
headlines and contents join only the page that is shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, paths, vectors
from ..schema import NotFound, Options


@dataclass(frozen=True)
class Page:
    """One page of results with the totals that follow from it."""

    results: DataFrame
    total: int
    page: int
    size: int

    @property
    def total_pages(self) -> int:
        return max(1, -(-self.total // self.size))

    @property
    def has_next(self) -> bool:
        return self.page + 1 < self.total_pages

    @property
    def has_previous(self) -> bool:
        return self.page > 0


def scoped(chunk: DataFrame, domain_id: str | None, tags: list[str] | None = None) -> DataFrame:
    """Chunks of one domain, under any of the tags where some are given; the domain filter reaches the scan."""
    if domain_id is not None:
        chunk = chunk.filter(F.col("domain_id") == domain_id)
    return chunk.filter(paths.any_under(F.col("tag_paths"), tags)) if tags else chunk


def top(df: DataFrame, score: str, key: str, k: int, page: int = 0) -> DataFrame:
    """``rank`` 1.. over the best ``k`` rows of a page; ties by key. The window sees those rows only."""
    best = df.orderBy(F.col(score).desc(), key).offset(page * k).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)) + page * k)


def lexical_leg(chunk: DataFrame, query: str | list[str], k: int, page: int = 0) -> DataFrame:
    """(id, score, rank) of the best chunks that hold every lexeme of the query, a text or lexemes."""
    wanted = analysis.query_lexemes(query) if isinstance(query, str) else query
    hits = chunk.filter(analysis.matches(F.col("lexemes"), wanted)).select("id", analysis.rank_cd(F.col("lexemes"), wanted).alias("score"))
    return top(hits, "score", "id", k, page)


def inverted_index(chunk: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(lexeme, id, domain_id, positions), of some lexemes ``only`` or of all; see ``store_index``."""
    lex = F.col("lexemes") if only is None else F.filter("lexemes", lambda x: x["lexeme"].isin(*only))
    x = chunk.select("id", "domain_id", F.explode_outer(lex).alias("x")).filter(F.col("x").isNotNull())
    return x.groupBy(F.col("x.lexeme").alias("lexeme"), "id", "domain_id").agg(F.array_sort(F.collect_list("x.pos")).alias("positions"))


def store_index(index: DataFrame, path: str) -> DataFrame:
    """Write an inverted index sorted by lexeme, once, and read it back: a later ``index_match`` skips row groups by its pushed filter."""
    index.repartitionByRange("lexeme", "id").sortWithinPartitions("lexeme", "id").write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def index_match(index: DataFrame, query: str | list[str]) -> DataFrame:
    """(id, hits) from the inverted index: ids that every lexeme of the query, a text or lexemes, leads to."""
    wanted = analysis.query_lexemes(query) if isinstance(query, str) else query
    return index.filter(F.col("lexeme").isin(*wanted) if wanted else F.lit(False)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).alias("hits")).filter(F.col("n") == len(wanted)).select("id", "hits")


def vector_leg(chunk: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """(id, score, rank) of the nearest chunks by exact cosine."""
    sim = vectors.cosine_similarity(F.col("embedding"), vectors.literal(query_vector))
    return top(chunk.filter(F.col("embedding").isNotNull()).select("id", sim.alias("score")), "score", "id", k)


def search_type(lexical: Column, vector: Column) -> Column:
    return F.when(lexical.isNotNull() & vector.isNotNull(), "BOTH").when(vector.isNotNull(), "EMBEDDING").otherwise("LEXICAL")


def fuse(lexical: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two short (id, rank) lists: (id, score, lex_rank, vec_rank, rank).

    Ties keep the lexical list's order, then the vector list's. The rank's window holds
    the lists' ids only, which are pools of a few dozen; ``fused`` is without it.
    """
    order = Window.orderBy(F.col("score").desc(), F.col("lex_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last())
    return fused(lexical, vector, k).withColumn("rank", F.row_number().over(order))


def fused(lexical: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """(id, score, lex_rank, vec_rank) of two (id, rank) lists of any length, as one aggregation."""
    legs = lexical.select("id", "rank", F.lit(0).alias("leg")).unionByName(vector.select("id", "rank", F.lit(1).alias("leg")))
    return legs.groupBy("id").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("leg") == 0, F.col("rank"))).alias("lex_rank"),
        F.min(F.when(F.col("leg") == 1, F.col("rank"))).alias("vec_rank"),
    )


def hydrate(ranked: DataFrame, chunk: DataFrame, document: DataFrame, query: str) -> DataFrame:
    """Join a page of fused ids to their chunks and documents, with a headline each. Ids that have gone are dropped."""
    page = F.broadcast(ranked)  # at most one page of ids
    c = chunk.select("id", "document_id", "domain_id", "chunk_index", "chunk_strategy", "tag_paths", "content").join(page, "id")
    d = document.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("author").alias("document_author"))
    return d.join(F.broadcast(c), "document_id").select(
        "rank", F.col("id").alias("chunk_id"), "document_id", "domain_id", "chunk_index", "chunk_strategy", "tag_paths",
        analysis.to_headline(F.col("content"), analysis.query_lexemes(query)).alias("headline"), "score", "document_title", "document_author",
        search_type(F.col("lex_rank"), F.col("vec_rank")).alias("search_type"),
    )


def lexical_search(chunk: DataFrame, document: DataFrame, query: str, domain_id: str, tags: list[str] | None = None, size: int = 20, page: int = 0, options: Options = Options()) -> Page:
    """A page of lexical hits. The total is counted apart, unless ``strict_parity`` wants 0 past the end."""
    inside = scoped(chunk, domain_id, tags)
    ranked = lexical_leg(inside, query, size, page).withColumn("lex_rank", F.col("rank")).withColumn("vec_rank", F.lit(None).cast("int"))
    total = inside.filter(analysis.matches(F.col("lexemes"), analysis.query_lexemes(query))).count()
    if options.strict_parity and total <= page * size:
        total = 0
    return Page(hydrate(ranked, chunk, document, query).orderBy("rank"), total, page, size)


def vector_search(chunk: DataFrame, document: DataFrame, query_vector: list[float], domain_id: str, tags: list[str] | None = None, size: int = 20) -> DataFrame:
    """The nearest chunks with a plain excerpt as headline."""
    from ..functions.text import excerpt

    ranked = F.broadcast(vector_leg(scoped(chunk, domain_id, tags), query_vector, size))
    d = document.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("author").alias("document_author"))
    c = chunk.select("id", "document_id", "chunk_index", "content").join(ranked, "id").join(d, "document_id")
    return c.select("rank", F.col("id").alias("chunk_id"), "document_id", "chunk_index", excerpt(F.col("content")).alias("headline"), "score", "document_title", "document_author").orderBy("rank")


def hybrid_search(
    chunk: DataFrame, document: DataFrame, query: str, embed: Callable[[str], list[float]], domain_id: str, tags: list[str] | None = None, size: int = 20, page: int = 0, options: Options = Options()
) -> Page:
    """Both legs' pools fused; a page of them hydrated. The total is the number of fused ids, not a corpus count."""
    inside = scoped(chunk, domain_id, tags)
    fused = fuse(lexical_leg(inside, query, options.pool), vector_leg(inside, embed(query), options.pool), options.rrf_k)
    rows = [(r["id"], r["score"], r["lex_rank"], r["vec_rank"], r["rank"]) for r in fused.collect()]  # twice the pool at most
    shown = [r for r in rows if page * size < r[4] <= (page + 1) * size]
    ranked = chunk.sparkSession.createDataFrame(shown, "id string, score double, lex_rank int, vec_rank int, rank int")
    return Page(hydrate(ranked, chunk, document, query).orderBy("rank"), len(rows), page, size)


def neighbours(chunk: DataFrame) -> DataFrame:
    """Each chunk id with those before and after it in its document, by index plus or minus one."""
    side = lambda by, name: chunk.select(F.col("document_id"), (F.col("chunk_index") + by).alias("chunk_index"), F.col("id").alias(name))
    return chunk.select("id", "document_id", "chunk_index").join(side(1, "previous_id"), ["document_id", "chunk_index"], "left").join(side(-1, "next_id"), ["document_id", "chunk_index"], "left")


def search_page(
    chunk: DataFrame, document: DataFrame, query: str | None, embed: Callable[[str], list[float]], domain_id: str | None, tags: list[str] | None = None, size: int = 20, page: int = 0, options: Options = Options()
) -> Page | None:
    """What a search form asks for: nothing without a query or a domain, and blank tags don't count."""
    if not query or not query.strip() or domain_id is None:
        return None
    wanted = [t.strip() for t in tags or [] if t and t.strip()]
    return hybrid_search(chunk, document, query, embed, domain_id, wanted or None, size, page, options)


def chunk_detail(chunk: DataFrame, document: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk with its document's title and author and the ids before and after it; an id that isn't there raises."""
    here = chunk.filter(F.col("id") == chunk_id).select("id", "document_id", "chunk_index", "content").first()
    if here is None:
        raise NotFound(chunk_id)
    of = chunk.filter((F.col("document_id") == here["document_id"]) & F.col("chunk_index").between(here["chunk_index"] - 1, here["chunk_index"] + 1))
    d = document.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("author").alias("document_author"))
    return neighbours(of).filter(F.col("id") == chunk_id).join(d, "document_id").withColumn("content", F.lit(here["content"]))
